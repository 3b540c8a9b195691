"""Identity ladders: source id, then exact key or alias, then near keys. A near hit never merges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallyframe.functions.keys import fuzzy_neighbours


def exact_ids(wanted: DataFrame, canonical: DataFrame, aliases: DataFrame) -> DataFrame:
    """(request, key) joined with the distinct (key, id) of canonical names and aliases."""
    known = canonical.select("key", "id").union(aliases.select("key", "id")).distinct()
    return wanted.join(known, "key")


def ladder(wanted: DataFrame, canonical: DataFrame, aliases: DataFrame, radius: int = 2) -> DataFrame:
    """For each request the outcome: matched (one exact id), ambiguous (several exact ids, or any near key), or new."""
    exact = exact_ids(wanted, canonical, aliases).groupBy("request").agg(F.count_distinct("id").alias("exact"), F.min("id").alias("id"))
    known = canonical.select("key").union(aliases.select("key"))
    near = _near_counts(wanted, known, radius)
    out = wanted.join(exact, "request", "left").join(near, "key", "left")
    n, k = F.coalesce("exact", F.lit(0)), F.coalesce("near", F.lit(0))
    outcome = F.when(n == 1, "matched").when(n > 1, "ambiguous-exact").when(k > 0, "ambiguous-near").otherwise("new")
    return out.select("request", "key", outcome.alias("outcome"), F.when(n == 1, F.col("id")).alias("id"), n.cast("long").alias("exact"), k.cast("long").alias("near"))


def _near_counts(wanted: DataFrame, known: DataFrame, radius: int = 2) -> DataFrame:
    """key and the number of known keys that are 1 to ``radius`` edits away."""
    return fuzzy_neighbours(wanted.select("key").distinct(), known.select("key").distinct(), radius=radius).groupBy("key").agg(F.count("*").alias("near"))


def _by_source_ids(wanted: DataFrame, stored: DataFrame, sources: list[str]) -> DataFrame:
    """request and the stored id that the first source with any hit gives (the smallest, if it has several)."""
    hits = None
    for place, c in enumerate(sources):
        found = wanted.where(F.col(c).isNotNull()).select("request", c).join(stored.groupBy(c).agg(F.min("id").alias("id")), c).select("request", F.lit(place).alias("place"), "id")
        hits = found if hits is None else hits.union(found)
    return hits.groupBy("request").agg(F.min(F.struct("place", "id")).alias("m")).select("request", F.col("m.id").alias("source_id"))


def _exact_id(wanted: DataFrame, known: DataFrame, on: list[str]) -> DataFrame:
    """request, exact (0, 1, or 2 for several ids) and the smallest id of the known names that ``wanted`` has.

    Ids are gathered by name before requests meet them: a name that many share costs each request one row.
    """
    ids = known.groupBy(*on).agg(F.min("id").alias("low"), F.max("id").alias("high"))
    met = wanted.select("request", *on).join(ids, on).groupBy("request").agg(F.min("low").alias("id"), F.max("high").alias("high"))
    return met.select("request", F.when(F.col("high").isNull(), 0).when(F.col("high") == F.col("id"), 1).otherwise(2).alias("exact"), "id")


def player_ladder(wanted: DataFrame, stored: DataFrame, aliases: DataFrame, sources: list[str]) -> DataFrame:
    """request, tier, outcome (matched, ambiguous, created) and id.

    ``wanted``: request, key and the columns ``sources``; ``stored``: id, key and those columns. Source ids
    decide in order, before any name; then exact keys of names and aliases: one id is a match, several
    are ambiguous; then any near canonical name makes it ambiguous; else a player is created. Near names are
    looked for only where neither decides.
    """
    by_id = _by_source_ids(wanted, stored, sources)
    exact = _exact_id(wanted, stored.select("key", "id").union(aliases.select("key", "id")), ["key"])
    asked = wanted.select("request", "key").join(by_id, "request", "left").join(exact, "request", "left")
    there, n = F.col("source_id").isNotNull(), F.coalesce("exact", F.lit(0))
    near = _near_counts(asked.where(~there & (n == 0)), stored).select("key", F.lit(True).alias("near"))
    out = asked.join(near, "key", "left")
    close = F.coalesce("near", F.lit(False))
    tier = F.when(there, "source-id").when(n > 0, "name").when(close, "near").otherwise("none")
    outcome = F.when(there | (n == 1), "matched").when((n > 1) | close, "ambiguous").otherwise("created")
    return out.select("request", tier.alias("tier"), outcome.alias("outcome"), F.when(there, F.col("source_id")).when(n == 1, F.col("id")).alias("id"))


def team_ladder(wanted: DataFrame, teams: DataFrame) -> DataFrame:
    """request, outcome and id: keys of teams are not unique, so several teams of one key are ambiguous, as any near key is."""
    exact = wanted.join(teams.select("key", "id"), "key").groupBy("request").agg(F.count("*").alias("exact"), F.min("id").alias("id"))
    out = wanted.join(exact, "request", "left").join(_near_counts(wanted, teams), "key", "left")
    n = F.coalesce("exact", F.lit(0))
    outcome = F.when(n == 1, "matched").when((n > 1) | (F.coalesce("near", F.lit(0)) > 0), "ambiguous").otherwise("created")
    return out.select("request", outcome.alias("outcome"), F.when(n == 1, F.col("id")).alias("id"))


def roster_ladder(wanted: DataFrame, stored: DataFrame, aliases: DataFrame, members: DataFrame, radius: int = 2) -> DataFrame:
    """request, outcome (matched, ambiguous, unresolved) and id, looking at the current members of the request's team only.

    ``members``: team_id, player_id. The roster bounds the near search: keys are compared within a team, each once,
    and only with those that no exact key decides.
    """
    ours = members.select("team_id", F.col("player_id").alias("id")).distinct()
    names = stored.select("key", "id").join(ours, "id")
    known = names.select("team_id", "key", "id").union(aliases.select("key", "id").join(ours, "id").select("team_id", "key", "id"))
    wanted = wanted.select("request", "team_id", "key")
    asked = wanted.join(_exact_id(wanted, known, ["team_id", "key"]), "request", "left")
    k = F.coalesce("exact", F.lit(0))
    # One hash join on the team and the length of the key within its band.
    n = F.char_length("key")
    bands = asked.where(k == 0).select("team_id", "key").distinct().withColumn("length", F.explode(F.sequence(F.greatest(n - radius, F.lit(0)), n + radius)))
    close = bands.join(names.select("team_id", F.col("key").alias("other"), n.alias("length")).distinct(), ["team_id", "length"]).where(F.levenshtein("key", "other", radius).between(1, radius))
    out = asked.join(close.select("team_id", "key", F.lit(True).alias("near")).distinct(), ["team_id", "key"], "left")
    outcome = F.when(k == 1, "matched").when((k > 1) | F.col("near").isNotNull(), "ambiguous").otherwise("unresolved")
    return out.select("request", outcome.alias("outcome"), F.when(k == 1, F.col("id")).alias("id"))


def routed(targets: DataFrame, prefixes: dict[str, str]) -> DataFrame:
    """``targets`` with route (the column a prefix stands for, or name) and value (the target without its prefix)."""
    route, value = F.lit("name"), F.col("target")
    for prefix, column in prefixes.items():
        hit = F.col("target").startswith(prefix)
        route, value = F.when(hit, column).otherwise(route), F.when(hit, F.substr("target", F.lit(len(prefix) + 1))).otherwise(value)
    return targets.withColumn("route", route).withColumn("value", value)


def roster_members_by_id(targets: DataFrame, stored: DataFrame, members: DataFrame) -> DataFrame:
    """Routed targets by source id: matched (one holder of it is a member), ambiguous (several are), off-roster (none is) or unresolved (nobody holds it)."""
    asked = targets.where("route <> 'name'")
    columns = [r["route"] for r in asked.select("route").distinct().collect()]  # at most one for each prefix
    held = None
    for c in columns:
        one = stored.where(F.col(c).isNotNull()).select(F.lit(c).alias("route"), F.col(c).alias("value"), "id")
        held = one if held is None else held.union(one)
    if held is None:
        return asked.select("request", "route", F.lit("unresolved").alias("outcome"), F.lit(None).cast("long").alias("id"))
    ours = members.select("team_id", F.col("player_id").alias("id"), F.lit(True).alias("ours")).distinct()
    hits = asked.join(held, ["route", "value"]).join(ours, ["team_id", "id"], "left")
    hits = hits.groupBy("request").agg(F.count("ours").alias("inside"), F.min(F.when(F.col("ours"), F.col("id"))).alias("mine"))
    out = asked.join(hits, "request", "left")
    outcome = F.when(F.col("inside").isNull(), "unresolved").when(F.col("inside") > 1, "ambiguous").when(F.col("inside") == 1, "matched").otherwise("off-roster")
    return out.select("request", "route", outcome.alias("outcome"), F.when(F.col("inside") == 1, F.col("mine")).alias("id"))


def unkeyed(rows: DataFrame, key: str = "key") -> bool:
    """Whether any row lacks its key; callers refuse to resolve then."""
    return not rows.where(F.col(key).isNull()).limit(1).isEmpty()
