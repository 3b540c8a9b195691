"""One-line texts for records, tendencies and summaries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe(text: Column) -> Column:
    """Control, format and line-separator characters as blanks."""
    return F.regexp_replace(text, r"[\p{Cc}\p{Cf}\u2028\u2029]", " ")


def record(wins: Column, losses: Column, undecided: Column) -> Column:
    """``3-1``, with the undecided behind it where there are any."""
    base = F.concat_ws("-", wins.cast("string"), losses.cast("string"))
    return F.when(undecided > 0, F.concat(base, F.lit(" ("), undecided.cast("string"), F.lit(" undecided)"))).otherwise(base)


def quoted(value: Column) -> Column:
    return F.concat(F.lit('"'), F.regexp_replace(safe(value), r'(["\\])', r"\\$1"), F.lit('"'))


def summary(**fields: Column) -> Column:
    """``key="value"`` pairs in the order given; nulls are left out."""
    return F.concat_ws(" ", *[F.when(v.isNotNull(), F.concat(F.lit(f"{k}="), quoted(v.cast("string")))) for k, v in fields.items()])


def escape_html(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def gender(text: Column) -> Column:
    """Male or Female, in any case and behind the label of a category; any other word is no opinion (null)."""
    word = F.regexp_replace(F.regexp_replace(text, r"(?i)^competition category:", ""), r"(?U)^\s+|\s+$", "")
    return F.when(F.upper(word) == "MALE", "Male").when(F.upper(word) == "FEMALE", "Female")


def gender_to_write(old: Column, text: Column) -> Column:
    """What is stored after a source said ``text``: a word that says nothing leaves what is known."""
    return F.coalesce(gender(text), old)


# How sources are called.
SOURCE_LABELS = {"ntrp": "NTRP", "wtn_singles": "WTN-S", "wtn_doubles": "WTN-D", "tr_dynamic": "TR-Dyn"}


def source_label(source: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in SOURCE_LABELS.items() for x in kv])[source], source)


def fixed(value: Column, places: int) -> Column:
    """A number with so many places, rounded by its exact binary value, halves away from zero.

    33.05 as a double lies below 33.05, so one place gives 33.0; rounding its shortest decimal form would
    give 33.1. From 1024 on the shortest form is rounded.
    """
    size = F.abs(value)

    def exact(bits: int) -> Column:
        """By the value times 2^bits, which is a whole number that a long holds (from 2^(bits - 52) to 2^(63 - bits))."""
        doubled = F.floor(size * float(2**bits)).cast("decimal(20,0)") * F.lit(2 * 10**places).cast("decimal(4,0)") + F.lit(2**bits).cast("decimal(20,0)")
        units = F.call_function("div", doubled, F.lit(2 ** (bits + 1)).cast("decimal(20,0)")).cast("decimal(20,0)")
        return (units / F.lit(10**places).cast("decimal(4,0)")).cast(f"decimal(20,{places})").cast("string")

    rest = F.round(size, places).cast(f"decimal(38,{places})").cast("string")
    text = F.when(size < 4, exact(60)).when(size < 1024, exact(52)).otherwise(rest)
    return F.when(value < 0, F.concat(F.lit("-"), text)).otherwise(text)


def rating_value(value: Column, source: Column) -> Column:
    """One decimal for a level of the rating programme, two for all others."""
    return F.when(source == "ntrp", fixed(value, 1)).otherwise(fixed(value, 2))


def ratings_line(entries: Column) -> Column:
    """``NTRP 4.0C, WTN-S 22.51`` from an array of (source, value, rating_type) in its order."""
    one = lambda e: F.concat(source_label(e["source"]), F.lit(" "), rating_value(e["value"], e["source"]), F.coalesce(e["rating_type"], F.lit("")))
    return F.when(F.coalesce(F.size(entries), F.lit(0)) < 1, "none on file").otherwise(F.array_join(F.transform(entries, one), ", "))


def shown(raw: Column, fallback: Column) -> Column:
    """A name made safe to print; the fallback where nothing of it would be seen."""
    text = safe(raw)
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", fallback).otherwise(text)


def _former(label: Column, retired: Column) -> Column:
    return F.when(retired, F.concat(label, F.lit(" — former"))).otherwise(label)


def membership_text(team: Column, rows: Column) -> Column:
    """One team's memberships: its name, ``(former)``, or the contexts it is a roster of, the season's first, then events in their order.

    ``rows``: array of (event_id, event_name, retired).
    """
    season = F.filter(rows, lambda r: r["event_id"].isNull())
    events = F.filter(rows, lambda r: r["event_id"].isNotNull())
    gone = F.forall(season, lambda r: r["retired"])
    named = F.transform(events, lambda r: _former(F.concat(F.lit("registered for "), F.when(F.trim(F.coalesce(r["event_name"], F.lit(""))) == "", F.concat(F.lit("event #"), r["event_id"].cast("string"))).otherwise(F.concat(F.lit('"'), safe(r["event_name"]), F.lit('"')))), r["retired"]))
    contexts = F.concat(F.when(F.size(season) > 0, F.array(_former(F.lit("season roster"), gone))).otherwise(F.array().cast("array<string>")), named)
    return F.when(F.size(events) == 0, F.when(gone, F.concat(team, F.lit(" (former)"))).otherwise(team)).otherwise(F.concat(team, F.lit(" ("), F.array_join(contexts, "; "), F.lit(")")))


def scope_line(mode: Column, label: Column, event: Column, considered: Column, retained: Column, excluded: Column) -> Column:
    """What a league scope kept and set aside; ``mode`` null: no scope."""
    source = F.when(event.isNull(), "").otherwise(F.concat(F.lit(' (event "'), safe(event), F.lit('")')))
    courts = lambda n: F.concat(n.cast("string"), F.when(n == 1, " court match").otherwise(" court matches"))
    none = F.concat(F.lit("no league scope applied"), source, F.lit(" — every league counts, "), courts(retained))
    return F.when(mode.isNull(), none).otherwise(F.concat(label, source, F.lit(" — "), retained.cast("string"), F.lit(" of "), courts(considered), F.lit(" retained, "), excluded.cast("string"), F.lit(" excluded")))


def roster_line(scope: Column, event: Column, registered: Column, season: Column) -> Column:
    named = F.concat(F.lit('event "'), safe(F.coalesce(event, F.lit(""))), F.lit('"'))
    of_season = F.when(event.isNull(), "season roster — no event named").otherwise(F.concat(F.lit("season roster ("), named, F.lit(") — no registered members")))
    return F.when(scope == "registered", F.concat(F.lit("registered "), registered.cast("string"), F.lit(" for "), named, F.lit(" (season roster: "), season.cast("string"), F.lit(")"))).otherwise(of_season)


def slots_line(entries: Column) -> Column:
    """``S1×3, D2×1`` from an array of (slot, matches) in its order."""
    one = lambda e: F.concat(e["slot"], F.lit("×"), e["matches"].cast("string"))
    return F.when(F.coalesce(F.size(entries), F.lit(0)) < 1, "none").otherwise(F.array_join(F.transform(entries, one), ", "))


def partners_line(entries: Column) -> Column:
    """``Jo Day ×3, Al Ko ×1`` from an array of (name, matches) in its order."""
    one = lambda e: F.concat(safe(e["name"]), F.lit(" ×"), e["matches"].cast("string"))
    return F.when(F.coalesce(F.size(entries), F.lit(0)) < 1, "none").otherwise(F.array_join(F.transform(entries, one), ", "))
