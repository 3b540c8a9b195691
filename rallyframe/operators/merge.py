"""Keyed merges on Parquet: the stored and the incoming rows go in, the new table comes out.

Each merge is one shuffle by key with partial aggregation; running it again changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rallyframe.functions.keys import name_key, site_key, time_key


def merge_latest(target: DataFrame, incoming: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key (null is a value of a key): an incoming row replaces the stored one; among incoming rows the last by ``order`` wins."""
    rest = [c for c in target.columns if c not in keys]
    both = target.withColumn("__new", F.lit(0)).unionByName(incoming.select(target.columns).withColumn("__new", F.lit(1)))
    last = F.max_by(F.struct(*rest), F.struct("__new", *order)).alias("m")
    return both.groupBy(*keys).agg(last).select(*keys, "m.*").select(target.columns)


def merge_filled(target: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key; an incoming null never overwrites a stored value."""
    rest = [c for c in target.columns if c not in keys]
    joined = target.alias("t").join(incoming.alias("i"), [F.col(f"t.{k}").eqNullSafe(F.col(f"i.{k}")) for k in keys], "full")
    return joined.select(*[F.coalesce(f"i.{k}", f"t.{k}").alias(k) for k in keys], *[F.coalesce(f"i.{c}", f"t.{c}").alias(c) for c in rest]).select(target.columns)


def merge_fixtures(fixtures: DataFrame) -> DataFrame:
    """One row for each fixture that was reported without a source id.

    A fixture is an unordered pair of teams, a day, a time and a site (each by its key; null is a value):
    two fixtures of one pair on one day stay two. The row keeps the order of teams, time and site of
    its first report (by match_id) and has the counts of its last one, swapped where that had the
    teams the other way round. Its event is the first one reported; ``conflict`` where reports name
    different events, which refuses the later ones.
    """
    swap = F.col("home_team_id") > F.col("visiting_team_id")
    rows = fixtures.select(
        F.least("home_team_id", "visiting_team_id").alias("low"), F.greatest("home_team_id", "visiting_team_id").alias("high"), "played_on", time_key(F.col("scheduled_time")).alias("time_key"), site_key(F.col("site")).alias("site_key"),
        "match_id", swap.alias("swap"), "scheduled_time", "site", "event_id",
        F.when(swap, F.col("visiting_courts_won")).otherwise(F.col("home_courts_won")).alias("a"), F.when(swap, F.col("home_courts_won")).otherwise(F.col("visiting_courts_won")).alias("b"),
    )
    # First by key and event, then by key: what is gathered for a fixture is one entry for each event that it is reported for.
    keys = ["low", "high", "played_on", "time_key", "site_key"]
    told = rows.groupBy(*keys, "event_id").agg(F.min(F.struct("match_id", "swap", "scheduled_time", "site")).alias("first"), F.max(F.struct("match_id", "a", "b")).alias("last"), F.count("*").alias("n"))
    one = told.groupBy(*keys).agg(
        F.min("first").alias("first"), F.min(F.when(F.col("event_id").isNotNull(), F.struct("first.match_id", "event_id"))).alias("named"), F.sum("n").alias("reports"), F.collect_list(F.struct("event_id", "last")).alias("told")
    )
    # A report that names another event than the first one named is refused as a whole.
    one = one.withColumn("event_id", F.col("named.event_id"))
    kept = F.filter("told", lambda x: x["event_id"].isNull() | (x["event_id"] == F.col("event_id")))
    one = one.withColumn("last", F.array_max(F.transform(kept, lambda x: x["last"]))).withColumn("conflict", F.size(kept) < F.size("told"))
    s = F.col("first.swap")
    return one.select(
        F.col("first.match_id").alias("match_id"), "played_on", F.col("first.scheduled_time").alias("scheduled_time"), F.col("first.site").alias("site"), "event_id",
        F.when(s, F.col("high")).otherwise(F.col("low")).alias("home_team_id"), F.when(s, F.col("low")).otherwise(F.col("high")).alias("visiting_team_id"),
        F.when(s, F.col("last.b")).otherwise(F.col("last.a")).alias("home_courts_won"), F.when(s, F.col("last.a")).otherwise(F.col("last.b")).alias("visiting_courts_won"), "reports", "conflict",
    )


def merge_team_matches(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Team matches with a source id, one row for each: an incoming report (the last by ``seen``) replaces teams, day and counts with nulls too; the stored event stays, a missing one is filled in.

    A report that names another event than the stored one is refused as a whole: the stored row stays
    as it is and ``conflict`` is true.
    """
    fresh = ["home_team_id", "visiting_team_id", "played_on", "home_courts_won", "visiting_courts_won"]
    last = incoming.where("source_match_id IS NOT NULL").groupBy("source_match_id").agg(F.max_by(F.struct("event_id", *fresh), "seen").alias("i"))
    both = stored.select("source_match_id", F.struct("event_id", *fresh).alias("s")).join(last, "source_match_id", "full")
    conflict = F.coalesce(F.col("s.event_id") != F.col("i.event_id"), F.lit(False))
    keep = F.col("i").isNull() | conflict
    return both.select("source_match_id", F.coalesce("s.event_id", "i.event_id").alias("event_id"), *[F.when(keep, F.col(f"s.{c}")).otherwise(F.col(f"i.{c}")).alias(c) for c in fresh], conflict.alias("conflict"))


def merge_players(stored: DataFrame, changes: DataFrame, key: str = "player_id") -> DataFrame:
    """Stored rows with the changes (one for each key): each column of ``changes`` is a struct (given, value); what is not given stays, a given null is written.

    A new name brings its key. Changes of unknown players change nothing; they are found by an anti-join.
    """
    told = [c for c in changes.columns if c != key]
    joined = stored.join(changes.select(key, *[F.col(c).alias(f"__{c}") for c in told]), key, "left")

    def value(c: str) -> Column:
        return F.when(F.coalesce(F.col(f"__{c}.given"), F.lit(False)), F.col(f"__{c}.value")).otherwise(F.col(c)) if c in told else F.col(c)

    out = joined.select(*[value(c).alias(c) for c in stored.columns])
    return out.withColumn("name_key", name_key(F.col("name"))) if "name" in told and "name_key" in stored.columns else out


def merge_courts(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Courts after a pull: with a source id the key is (source_match_id, slot), without one (slot, played_on, team_match_id), nulls being values.

    The last report by ``seen`` wins. By source id it also replaces the team match and the day.
    """
    sourced = F.col("source_match_id").isNotNull()
    key = F.when(sourced, F.struct(F.lit("source").alias("mode"), F.col("source_match_id"), F.col("slot"), F.lit(None).cast("date").alias("played_on"), F.lit(None).cast("long").alias("team_match_id"))).otherwise(
        F.struct(F.lit("place").alias("mode"), F.lit(None).cast("string").alias("source_match_id"), F.col("slot"), F.col("played_on"), F.col("team_match_id"))
    )
    columns = ["source_match_id", "slot", "played_on", "team_match_id", "discipline", "winner_side", "score", "league_context"]
    both = stored.select(*columns, F.lit(-1).cast("long").alias("seen")).union(incoming.select(*columns, F.col("seen").cast("long")))
    return both.groupBy(key.alias("k")).agg(F.max_by(F.struct(*columns), "seen").alias("m")).select("m.*")


def retire_absent(memberships: DataFrame, observed: DataFrame) -> DataFrame:
    """Season members of an observed team who are not in its observation are retired; a team without any observed player retires nobody."""
    seen = observed.select("team_id", "player_id").distinct().withColumn("__seen", F.lit(True))
    teams = observed.select("team_id").distinct().withColumn("__team", F.lit(True))
    joined = memberships.join(seen, ["team_id", "player_id"], "left").join(teams, "team_id", "left")
    gone = F.col("event_id").isNull() & F.col("__team").isNotNull() & F.col("__seen").isNull()
    return joined.withColumn("retired", F.col("retired") | gone).select(memberships.columns)


def replace_members(memberships: DataFrame, observed: DataFrame) -> DataFrame:
    """The members of (team_id, event_id) become those of ``observed``: named ones are added or taken back, others retired; groups that are not observed stay as they are."""
    keys = ["player_id", "team_id", "event_id"]
    named = observed.select(*keys).distinct().withColumn("__named", F.lit(True))
    groups = observed.select("team_id", "event_id").distinct().withColumn("__group", F.lit(True))
    joined = memberships.join(named, keys, "full").join(groups, ["team_id", "event_id"], "left")
    return joined.withColumn("retired", F.when(F.col("__named"), False).when(F.col("__group"), True).otherwise(F.col("retired"))).select(memberships.columns)


def compare_counts(before: DataFrame, after: DataFrame, by: str) -> DataFrame:
    """Rows per value of ``by`` on both sides and whether they agree; a value that one side lacks counts 0 there."""
    a, b = before.groupBy(by).agg(F.count("*").alias("rows_before")), after.groupBy(by).agg(F.count("*").alias("rows_after"))
    both = a.join(b, by, "full").fillna(0, ["rows_before", "rows_after"])
    return both.withColumn("same", F.col("rows_before") == F.col("rows_after"))


def keep_first(rows: DataFrame, keys: list[str], id_column: str) -> DataFrame:
    """The row with the smallest id of each key."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), id_column).alias("m")).select(*keys, "m.*").select(rows.columns)


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1")
