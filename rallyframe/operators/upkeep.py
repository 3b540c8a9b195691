"""Small writes that are decided by what is stored: notes, aliases, declared names, designations, repairs.

Each takes the stored rows and the requests and gives outcomes, or the new table; a refused request
changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rallyframe.functions.keys import fuzzy_neighbours, name_key
from rallyframe.functions.phrases import gender_to_write

BLANK = r"(?U)^\s*$"


def note_outcomes(notes: DataFrame, members: DataFrame) -> DataFrame:
    """What becomes of each note (note_id, player_id, pair_id or null, note): it needs a text, a pair other than the player, and both on the roster."""
    on = members.select(F.col("player_id").alias("m"), F.lit(True).alias("on")).distinct()
    n = notes.join(on.withColumnsRenamed({"m": "player_id", "on": "on_roster"}), "player_id", "left").join(on.withColumnsRenamed({"m": "pair_id", "on": "pair_on"}), "pair_id", "left")
    refusal = F.when(F.coalesce("note", F.lit("")).rlike(BLANK), "empty").when(F.col("pair_id") == F.col("player_id"), "paired with oneself").when(F.col("on_roster").isNull(), "not on the roster").when(F.col("pair_id").isNotNull() & F.col("pair_on").isNull(), "pair not on the roster")
    return n.select("note_id", "player_id", "pair_id", F.coalesce(refusal, F.lit("recorded")).alias("outcome"))


def visible_notes(notes: DataFrame, roster: DataFrame) -> DataFrame:
    """Notes (team_id, note_id, player_id, pair_id, created_at) whose subject, and pair if there is one, are on a team's roster, latest first: place counts from 1, the larger id first on ties."""
    r = roster.select("team_id", "player_id")
    seen = notes.join(r, "player_id").join(r.withColumnRenamed("player_id", "pair_id").withColumn("pair_on", F.lit(True)), ["team_id", "pair_id"], "left").where("pair_id IS NULL OR pair_on")
    kind = F.when(F.col("pair_id").isNull(), "player").otherwise("pairing")
    # Places are counted in two steps, so that a team's notes are never in one task: times first, then the notes of one time.
    seen = seen.withColumn("kind", kind)
    group, at = ["team_id", "kind"], F.coalesce(F.col("created_at").cast("string"), F.lit(""))
    times = seen.groupBy(*group, "created_at").agg(F.count("*").alias("n"))
    later = F.sum("n").over(Window.partitionBy(*group).orderBy(F.desc("created_at")).rowsBetween(Window.unboundedPreceding, -1))
    times = times.select(*group, at.alias("__at"), F.coalesce(later, F.lit(0)).alias("later"))
    same = Window.partitionBy(*group, "__at").orderBy(F.desc("note_id"))
    placed = seen.withColumn("__at", at).join(times, [*group, "__at"]).withColumn("place", (F.col("later") + F.row_number().over(same)).cast("int"))
    return placed.select(*group, "note_id", "player_id", "pair_id", "place")


def alias_outcomes(requests: DataFrame, canonical: DataFrame, aliases: DataFrame) -> DataFrame:
    """What becomes of each alias (request, id, alias): held by another player (by name or alias), already recorded as an alias of this one, or recorded."""
    r = requests.withColumn("key", name_key(F.col("alias")))
    held = canonical.select("key", "id").union(aliases.select("key", "id")).distinct().withColumnRenamed("id", "holder")
    others = r.join(held, "key").where("holder <> id").groupBy("request").agg(F.min("holder").alias("holder"))
    own = r.join(aliases.select("key", F.col("id")).distinct(), ["key", "id"]).select("request", F.lit(True).alias("own"))
    out = r.join(others, "request", "left").join(own, "request", "left")
    outcome = F.when(F.col("alias").rlike(BLANK), "empty").when(F.col("holder").isNotNull(), "held by another").when(F.col("own"), "already recorded").otherwise("recorded")
    return out.select("request", outcome.alias("outcome"), "holder")


def distinct_outcomes(requests: DataFrame, known: DataFrame, canonical: DataFrame) -> DataFrame:
    """Declarations that a name is a player of its own (request, name, near_name or null): what is created, or why nothing is.

    ``known``: key, id of names and aliases; ``canonical``: key. A pair of names must differ by one or two edits; a
    name that several players hold is ambiguous already. Without a pair the name must have a near one.
    """
    r = requests.withColumn("key", name_key(F.col("name"))).withColumn("other", name_key(F.col("near_name")))
    ids = known.select("key", "id").distinct().groupBy("key").agg(F.count("*").alias("n"))
    near = fuzzy_neighbours(r.select("key").distinct(), canonical.select("key").distinct()).groupBy("key").agg(F.count("*").alias("near"))
    r = r.join(ids, "key", "left").join(ids.withColumnsRenamed({"key": "other", "n": "m"}), "other", "left").join(near, "key", "left")
    n, m, paired = F.coalesce("n", F.lit(0)), F.coalesce("m", F.lit(0)), F.col("near_name").isNotNull()
    apart = F.levenshtein("name", "near_name")
    blank = F.col("name").rlike(BLANK) | (paired & F.col("near_name").rlike(BLANK))
    outcome = (
        F.when(blank, "empty").when(paired & (F.col("key") == F.col("other")), "same name").when(paired & ~apart.between(1, 2), "not near").when((n > 1) | (paired & (m > 1)), "already ambiguous")
        .when((n == 1) & (~paired | (m == 1)), "already on file").when(~paired & F.col("near").isNull(), "not ambiguous").when(n == 1, "already on file").otherwise("created")
    )
    wrote = ~outcome.isin("empty", "same name", "not near", "already ambiguous", "not ambiguous")
    return r.select("request", outcome.alias("outcome"), (wrote & paired & (m == 0)).alias("pair_created"))


def designated(teams: DataFrame, requests: DataFrame) -> DataFrame:
    """Teams (scope, team_id, is_home) with exactly the requested team of each scope as its home team, the others cleared; scopes without a request stay."""
    asked = requests.select("scope", F.col("team_id").alias("wanted"))
    there = asked.join(teams.select("scope", F.col("team_id").alias("wanted")), ["scope", "wanted"], "leftsemi")  # a request for an unknown team clears nothing
    t = teams.join(there, "scope", "left")
    home = F.when(F.col("wanted").isNull(), F.col("is_home")).when(F.col("team_id") == F.col("wanted"), True)
    return t.select("scope", "team_id", home.alias("is_home"))


def redated(rows: DataFrame, keys: list[str], wrong: Column, right: Column, applies: Column) -> DataFrame:
    """Observations of a wrong day moved to the right one where ``applies``; those that would meet an observation of that day are deleted first."""
    there = rows.where(F.col("observed_on") == right).select(*keys).distinct().withColumn("__there", F.lit(True))
    moved = applies & (F.col("observed_on") == wrong)
    joined = rows.join(there, keys, "left")
    return joined.where(~F.coalesce(moved & F.col("__there"), F.lit(False))).withColumn("observed_on", F.when(moved, right).otherwise(F.col("observed_on"))).select(rows.columns)


def rekeyed(rows: DataFrame, name: str = "name") -> DataFrame:
    """All keys dropped and made again from the names; rows without a name have none."""
    return rows.withColumn("name_key", name_key(F.col(name)))


def with_parent(courts: DataFrame, matches: DataFrame) -> DataFrame:
    """Courts with the team match of their source id; null where there is none."""
    return courts.join(matches.select("source_match_id", "team_match_id"), "source_match_id", "left")


def windows(events: DataFrame, today: Column) -> DataFrame:
    """event_id, anchor, since and label of each event's evidence window: twelve months to its first day, or to today if that is unknown."""
    anchor = F.coalesce("starts_on", today)
    return events.select("event_id", F.when(F.col("starts_on").isNull(), "today").otherwise("event").alias("anchored_to"), anchor.alias("anchor"), F.add_months(anchor, -12).alias("since"), F.concat(F.lit("12mo to "), F.date_format(anchor, "yyyy-MM-dd")).alias("label"))


def unverified_windows(claimed: DataFrame) -> DataFrame:
    """Windows (anchor, since, label) whose bound or label does not follow from their anchor; any of them refuses a report."""
    fits = F.col("since").eqNullSafe(F.add_months("anchor", -12)) & F.col("label").eqNullSafe(F.concat(F.lit("12mo to "), F.date_format("anchor", "yyyy-MM-dd")))
    return claimed.where(F.col("anchor").isNull() | ~fits)


# What a player may be asked for.
PLAYS = ("both", "doubles-only")


def plays_outcomes(requests: DataFrame, members: DataFrame) -> DataFrame:
    """What becomes of each request to set how a player plays (request, team_id, plays, outcome and id of the name): request, outcome, player_id and plays.

    Refusals in order: a value that is none, a name that nobody has, one that several may have, a player who is no current member of the team.
    """
    ours = members.select("team_id", F.col("player_id").alias("id"), F.lit(True).alias("__on")).distinct()
    r = requests.join(ours, ["team_id", "id"], "left")
    refusal = (
        F.when(~F.coalesce(F.col("plays").isin(*PLAYS), F.lit(False)), "invalid value").when(F.col("outcome") == "ambiguous", "ambiguous").when(F.col("outcome") != "matched", "unknown player").when(F.col("__on").isNull(), "not on the roster")
    )
    done = refusal.isNull()
    return r.select("request", F.coalesce(refusal, F.lit("set")).alias("outcome"), F.when(done, F.col("id")).alias("player_id"), F.when(done, F.col("plays")).alias("plays"))


def set_plays(players: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Players (player_id, plays and more) after the outcomes; of several for one player the last request stands."""
    last = outcomes.where("outcome = 'set'").groupBy("player_id").agg(F.max_by("plays", "request").alias("__plays"))
    return players.join(last, "player_id", "left").withColumn("plays", F.coalesce("__plays", "plays")).select(players.columns)


def backfilled_genders(players: DataFrame) -> DataFrame:
    """Players whose gender is a word of any source as Male or Female; what says neither stays as it is."""
    return players.withColumn("gender", gender_to_write(F.col("gender"), F.col("gender")))
