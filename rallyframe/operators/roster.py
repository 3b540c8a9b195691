"""Rosters, availability and events by day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _members(memberships: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Current registrations (team_id, event_id, player_id) and season members (team_id, player_id)."""
    now = memberships.where("NOT retired")
    return now.where("event_id IS NOT NULL").select("team_id", "event_id", "player_id").distinct(), now.where("event_id IS NULL").select("team_id", "player_id").distinct()


def resolve_rosters(memberships: DataFrame, entries: DataFrame) -> DataFrame:
    """team_id, event_id, player_id and scope for each entry (team_id, event_id): those registered for the event where there are any, else the season's members; never both."""
    registered, season = _members(memberships)
    teams = entries.select("team_id", "event_id").distinct()
    named = registered.join(teams, ["team_id", "event_id"], "leftsemi").select("team_id", "event_id", "player_id", F.lit("registered").alias("scope"))
    fallback = teams.join(registered.select("team_id", "event_id").distinct(), ["team_id", "event_id"], "leftanti").join(season, "team_id")
    return named.union(fallback.select("team_id", "event_id", "player_id", F.lit("season")))


def absent(memberships: DataFrame, entries: DataFrame) -> DataFrame:
    """Current season members of entries with registrations who are not registered."""
    registered, season = _members(memberships)
    known = entries.select("team_id", "event_id").distinct().join(registered.select("team_id", "event_id").distinct(), ["team_id", "event_id"], "leftsemi")
    return known.join(season, "team_id").join(registered, ["team_id", "event_id", "player_id"], "leftanti").select("team_id", "event_id", "player_id")


def season_only(memberships: DataFrame) -> DataFrame:
    """Current season rows of players without any current registration."""
    now = memberships.where("NOT retired")
    return now.where("event_id IS NULL").join(now.where("event_id IS NOT NULL").select("player_id").distinct(), "player_id", "leftanti").select("team_id", "player_id", "event_id")


def registered_teams(memberships: DataFrame, entries: DataFrame) -> DataFrame:
    """The teams of each event's field: those with any registration for it, retired ones too; all its entries if there is none."""
    any_ = memberships.where("event_id IS NOT NULL").select("team_id", "event_id").distinct()
    rest = entries.select("team_id", "event_id").distinct().join(any_.select("event_id").distinct(), "event_id", "leftanti").select("team_id", "event_id")
    return any_.union(rest)


def days_of(events: DataFrame) -> DataFrame:
    """One row for each event and day, both ends included; none if an end is missing or the ends are reversed."""
    spans = F.when(F.col("ends_on") >= F.col("starts_on"), F.sequence("starts_on", "ends_on", F.expr("INTERVAL 1 DAY")))
    return events.select("event_id", F.explode(spans).alias("day"))


def availability_grid(roster: DataFrame, events: DataFrame, answers: DataFrame) -> DataFrame:
    """Each member of an event's roster on each of its days; no answer is a null status."""
    grid = roster.join(days_of(events), "event_id")
    return grid.join(answers, ["player_id", "day"], "left")


def eligibility_ledger(grid: DataFrame) -> DataFrame:
    """Counts by answer for each team and day; only ``available`` is eligible."""
    status = F.col("status")
    return grid.groupBy("team_id", "event_id", "day").agg(
        F.count(F.when(status == "available", 1)).alias("available"), F.count(F.when(status == "unavailable", 1)).alias("unavailable"),
        F.count(F.when(status == "uncertain", 1)).alias("uncertain"), F.count(F.when(status.isNull(), 1)).alias("unrecorded"),
    )


def covering_events(days: DataFrame, events: DataFrame) -> DataFrame:
    """For each day the number of events that cover it and, if it is one, which. An equi-join on exploded days."""
    found = days_of(events).groupBy("day").agg(F.count("*").alias("n"), F.min("event_id").alias("event_id"))
    out = days.join(found, "day", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.select("day", F.col("n").cast("long").alias("events"), F.when(F.col("n") == 1, F.col("event_id")).alias("event_id"), F.when(F.col("n") == 0, "none").when(F.col("n") == 1, "one").otherwise("ambiguous").alias("outcome"))


def own_team_rows(rows: DataFrame, team_matches: DataFrame, roster: DataFrame, home_label: str = "home") -> DataFrame:
    """Rows of matches (match_id, player_id, side) of roster players (team_id, player_id) with ``ours``: null where their team did not play in the match, else whether they stood on its side."""
    played = rows.join(roster.select("team_id", "player_id"), "player_id").join(team_matches.select("match_id", "home_team_id", "visiting_team_id"), "match_id", "left")
    at_home = F.when(F.col("team_id") == F.col("home_team_id"), True).when(F.col("team_id") == F.col("visiting_team_id"), False)
    return played.withColumn("ours", (F.col("side") == home_label) == at_home).drop("home_team_id", "visiting_team_id")


def own_team_matches(rows: DataFrame, team_matches: DataFrame, roster: DataFrame) -> DataFrame:
    """Members' matches, and whether their own team played in them; ``our_side`` is the team's label there."""
    played = rows.join(roster.select("team_id", "player_id"), "player_id").join(team_matches.select("match_id", "home_team_id", "visiting_team_id"), "match_id", "left")
    side = F.when(F.col("team_id") == F.col("home_team_id"), "home").when(F.col("team_id") == F.col("visiting_team_id"), "visiting")
    return played.select("team_id", "match_id", side.alias("our_side")).distinct()


def excluded_counts(own: DataFrame) -> DataFrame:
    return own.groupBy("team_id").agg(F.count("*").alias("observed"), F.count("our_side").alias("kept"), F.count(F.when(F.col("our_side").isNull(), 1)).alias("excluded_other_team"))
