"""Rating series. Sources are never mixed; a roster uses one source."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def trajectory(ratings: DataFrame) -> DataFrame:
    """Each player's series by source in order of day, then id, with its place from 1."""
    w = Window.partitionBy("player_id", "source").orderBy("observed_on", "rating_id")
    return ratings.select("player_id", "source", "observed_on", "rating_id", "value", F.row_number().over(w).alias("place"))


def latest(ratings: DataFrame) -> DataFrame:
    """The last observation for each player and source; on one day the larger id wins. Partial maxima, no sort."""
    last = F.max(F.struct("observed_on", "rating_id", "value")).alias("m")
    return ratings.groupBy("player_id", "source").agg(last).select("player_id", "source", F.col("m.observed_on").alias("observed_on"), F.col("m.rating_id").alias("rating_id"), F.col("m.value").alias("value"))


def choose_source(roster: DataFrame, last: DataFrame, precedence: list[str]) -> DataFrame:
    """For each team the source that covers most of its players; ties by precedence, then by name."""
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, precedence)), F.col("source")), F.lit(0)), F.lit(len(precedence) + 1))
    covered = roster.join(last, "player_id").groupBy("team_id", "source").agg(F.count("*").alias("covered"))
    best = covered.groupBy("team_id").agg(F.min(F.struct((-F.col("covered")).alias("k"), place.alias("p"), "source")).alias("m"))
    size = roster.groupBy("team_id").agg(F.count("*").alias("roster_size"))
    return size.join(best, "team_id", "left").select("team_id", F.col("m.source").alias("source"), F.coalesce(-F.col("m.k"), F.lit(0)).alias("covered"), "roster_size")


def roster_rank(roster: DataFrame, last: DataFrame, chosen: DataFrame, inverted: list[str]) -> DataFrame:
    """Rank from 0 in the team's chosen source (low values first where inverted), ties by id; all unrated share the number of rated players.

    Counted in two steps, so that a team's players are never in one task: how many have a better value, then the place among those of one value.
    """
    rated = roster.join(chosen.select("team_id", "source"), "team_id").join(last.select("player_id", "source", "value"), ["player_id", "source"], "left")
    rated = rated.withColumn("strength", F.when(F.col("source").isin(inverted), -F.col("value")).otherwise(F.col("value")))
    values = rated.where("strength IS NOT NULL").groupBy("team_id", "strength").agg(F.count("*").alias("n"))
    team = Window.partitionBy("team_id")
    better = F.coalesce(F.sum("n").over(team.orderBy(F.desc("strength")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = values.select("team_id", "strength", better.alias("better"))
    counts = values.groupBy("team_id").agg(F.sum("n").alias("rated"))
    out = rated.join(placed, ["team_id", "strength"], "left").join(counts, "team_id", "left")
    among = F.row_number().over(Window.partitionBy("team_id", "strength").orderBy("player_id")) - 1
    # those without a value are not ordered: their place says nothing
    rank = F.when(F.col("better").isNotNull(), F.col("better") + among).otherwise(F.coalesce("rated", F.lit(0)))
    return out.select("team_id", "player_id", "source", "value", rank.cast("long").alias("rank"))
