"""Small written forms: event formats, league scopes, dates, counts and parameters of links.

A form that breaks its grammar has the first ``error`` found and no parsed value; nothing is dropped
or repaired silently.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rallyframe.functions.keys import nfkc


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _entries(text: Column) -> Column:
    return F.transform(F.split(text, ",", -1), _trimmed)


def event_format(text: Column) -> Column:
    """``S1:singles,D1:doubles`` as struct(courts: array of (slot, discipline), error)."""
    entries = _entries(text)

    def slot(e: Column) -> Column:
        return _trimmed(F.regexp_extract(e, "(?s)^([^:]*):", 1))

    def kind(e: Column) -> Column:
        return _trimmed(F.regexp_extract(e, "(?s)^[^:]*:(.*)$", 1))

    def broken(e: Column) -> Column:
        return F.when(e == "", "blank entry").when(~e.contains(":"), "missing discipline").when(slot(e) == "", "blank slot").when(~kind(e).isin("singles", "doubles"), "unknown discipline")

    slots = F.transform(entries, slot)
    first = F.get(F.filter(F.transform(entries, broken), lambda x: x.isNotNull()), 0)
    error = F.when(F.coalesce(_trimmed(text), F.lit("")) == "", "empty").otherwise(F.coalesce(first, F.when(F.size(F.array_distinct(slots)) < F.size(slots), "slot given twice")))
    courts = F.transform(entries, lambda e: F.struct(slot(e).alias("slot"), kind(e).alias("discipline")))
    return F.struct(F.when(error.isNull(), courts).alias("courts"), error.alias("error"))


def event_format_text(courts: Column) -> Column:
    return F.array_join(F.transform(courts, lambda c: F.concat(c.slot, F.lit(":"), c.discipline)), ",")


def is_canonical_format(courts: Column) -> Column:
    """Whether stored courts are what reading their own text gives."""
    again = event_format(event_format_text(courts))
    return F.coalesce(again.getField("courts") == F.transform(courts, lambda c: F.struct(c.slot.alias("slot"), c.discipline.alias("discipline"))), F.lit(False))


def league_scope(text: Column) -> Column:
    """``exclude:Mixed,Combo`` or ``only:…`` as struct(mode, prefixes, error); prefixes differ under NFKC and lower case."""
    t = _trimmed(text)
    mode, rest = _trimmed(F.regexp_extract(t, "(?s)^([^:]*):", 1)), F.regexp_extract(t, "(?s)^[^:]*:(.*)$", 1)
    prefixes = _entries(rest)
    folded = F.split(F.lower(nfkc(F.array_join(prefixes, "\n"))), "\n", -1)
    error = (
        F.when(F.coalesce(t, F.lit("")) == "", "empty")
        .when(~t.contains(":"), "missing mode")
        .when(~mode.isin("exclude", "only"), "unknown mode")
        .when(_trimmed(rest) == "", "no prefix")
        .when(F.exists(prefixes, lambda p: p == ""), "blank prefix")
        .when(F.size(F.array_distinct(folded)) < F.size(folded), "prefix given twice")
    )
    return F.struct(F.when(error.isNull(), mode).alias("mode"), F.when(error.isNull(), prefixes).alias("prefixes"), error.alias("error"))


def league_scope_text(mode: Column, prefixes: Column) -> Column:
    """The written form of a scope, which ``league_scope`` reads back."""
    return F.concat(mode, F.lit(":"), F.array_join(prefixes, ","))


def stored_scope(raw: Column) -> Column:
    """A stored scope, ``{"mode": "exclude", "prefixes": ["Mixed"]}``, as struct(mode, prefixes, error); a null is no scope and no error.

    Nothing is repaired: text that is no JSON, an object with other or further members, a member of another
    type, and prefixes that the written form could not have given are errors.
    """
    v = F.try_parse_json(raw)
    kind = F.schema_of_variant(v)
    typed = kind == "OBJECT<mode: STRING, prefixes: ARRAY<STRING>>"
    mode, prefixes = F.try_variant_get(v, "$.mode", "string"), F.when(typed, F.try_variant_get(v, "$.prefixes", "array<string>"))
    again = league_scope(league_scope_text(mode, prefixes))
    same = (again.getField("mode") == mode) & (again.getField("prefixes") == prefixes)
    error = F.when(v.isNull(), "not JSON").when(~typed, "malformed").when(~mode.isin("exclude", "only"), "malformed").when(F.exists(prefixes, lambda p: p == ""), "malformed").when(again.getField("error") == "prefix given twice", "prefix given twice").when(~F.coalesce(same, F.lit(False)), "not canonical")
    error = F.when(raw.isNotNull(), error)
    fine = raw.isNotNull() & error.isNull()
    return F.struct(F.when(fine, mode).alias("mode"), F.when(fine, prefixes).alias("prefixes"), error.alias("error"))


def league_scope_label(mode: Column, prefixes: Column) -> Column:
    quoted = F.array_join(F.transform(prefixes, lambda p: F.concat(F.lit('"'), p, F.lit('"'))), " or ")
    return F.concat(F.when(mode == "exclude", "excluding").otherwise("only"), F.lit(" league contexts starting with "), quoted)


def day_within(text: Column) -> Column:
    """The first M/D/Y date anywhere in a text as YYYY-MM-DD text; two-digit years are of this century."""
    shape = r"(\d{1,2})/(\d{1,2})/(\d{4}|\d{2})"
    month, day, year = (F.regexp_extract(text, shape, k) for k in (1, 2, 3))
    return F.when(year != "", F.concat_ws("-", F.lpad(year, 4, "20"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0")))


def win_loss(text: Column) -> Column:
    """``3-1`` as struct(wins, losses), else null."""
    shape = r"^\s*(\d+)\s*-\s*(\d+)\s*$"
    wins, losses = (F.regexp_extract(text, shape, k).try_cast("int") for k in (1, 2))
    return F.when(wins.isNotNull() & losses.isNotNull(), F.struct(wins.alias("wins"), losses.alias("losses")))


def href_param(href: Column, name: str) -> Column:
    """A parameter of an absolute or relative link: ``+`` is a blank, percent codes are decoded, the raw value stands where they are broken; null without it."""
    link = F.regexp_replace(href, "&amp;", "&")
    raw = F.when(link.rlike(rf"[?&]{name}="), F.regexp_extract(link, rf"[?&]{name}=([^&]*)", 1))
    return F.coalesce(F.try_url_decode(raw), raw)


def history_link(base: Column, year: Column, name: Column) -> Column:
    """The link to a player's match history of a year: all match and league types, in form encoding."""
    return F.concat(base, F.lit("?year="), F.url_encode(year), F.lit("&playername="), F.url_encode(name), F.lit("&mt=0&lt=0&yr=0"))


def url_slug(url: Column) -> Column:
    """A file name for a link: without its scheme, runs of other signs than ASCII letters and digits as one hyphen, at most 120 characters; ``page`` if nothing is left."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(url, r"^https?://", ""), "[^A-Za-z0-9]+", "-"), "^-+|-+$", "")
    return F.lower(F.coalesce(F.nullif(F.substring(bare, 1, 120), F.lit("")), F.lit("page")))
