"""From parsed pages to courts, participants, members and matches; a pull is taken or refused as a whole.

A page is one subject's view: the subject and the partner stand on ``home``, the opponents on
``visiting``, and a won match is won by ``home``. A page with any broken row gives nothing but its refusal, so no
page is stored in part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rallyframe.operators.identity import player_ladder
from rallyframe.operators.merge import merge_courts, merge_latest, merge_team_matches


def refused_pages(history: DataFrame) -> DataFrame:
    """url and the distinct errors of each page that has any; they are gathered from all rows, so no filter reads the pages twice."""
    return history.groupBy("url").agg(F.array_sort(F.collect_set("error")).alias("errors")).where(F.size("errors") > 0)


def accepted(history: DataFrame) -> DataFrame:
    return history.join(refused_pages(history).select("url"), "url", "leftanti")


def courts(history: DataFrame) -> DataFrame:
    """One row for each court: source_match_id, slot, discipline, winner_side, score, league_context, played_on."""
    score = F.array_join(F.transform("sets", lambda s: F.concat_ws("-", s.winner.cast("string"), s.loser.cast("string"))), " ")
    return accepted(history).select(
        "url", "source_match_id", "slot", "discipline", F.when(F.col("result") == "W", "home").otherwise("visiting").alias("winner_side"), F.nullif(score, F.lit("")).alias("score"), "league_context", F.to_date("played_on").alias("played_on")
    )


def participants(history: DataFrame, subjects: DataFrame) -> DataFrame:
    """source_match_id, slot, name and side of everyone named; ``subjects`` has the url and name of each page's player."""
    rows = accepted(history).join(subjects.select("url", "name"), "url")
    ours = F.transform(F.array_compact(F.array("name", F.when(F.col("discipline") == "doubles", F.col("partner")))), lambda n: F.struct(n.alias("name"), F.lit("home").alias("side")))
    theirs = F.transform("opponents", lambda n: F.struct(n.alias("name"), F.lit("visiting").alias("side")))
    return rows.select("url", "source_match_id", "slot", F.inline(F.concat(ours, theirs)))


def result_counts(result: Column) -> Column:
    """(home, visiting) of a result such as ``3-2``; nulls of anything else."""
    shaped = F.coalesce(result.rlike(r"\A[0-9]+\s*-\s*[0-9]+\z"), F.lit(False))
    count = lambda k: F.when(shaped, F.trim(F.split(result, "-").getItem(k)).try_cast("int"))
    return F.struct(count(0).alias("home"), count(1).alias("visiting"))


def refused_subjects(names: DataFrame, by: str) -> DataFrame:
    """``by`` and the ambiguous names (context: name) of each subject that has any; such a pull is refused as a whole."""
    said = F.concat(F.col("context"), F.lit(": "), F.col("name"))
    return names.where("outcome = 'ambiguous'").groupBy(by).agg(F.array_join(F.array_sort(F.collect_set(said)), "; ").alias("ambiguous"))


def team_pulls(state: dict[str, DataFrame], snapshots: DataFrame, roster: DataFrame, schedule: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """The state after a pull of each team of ``snapshots``, and team_id, outcome, ambiguous and trusted.

    ``state``: teams (team_id, roster_observed_at, roster_observed_url and more), memberships (player_id, team_id,
    event_id, retired) and team_matches as ``merge_team_matches`` has them. ``snapshots``: team_id, url and observed_at (null for a
    replayed file). ``roster``: team_id, name, outcome, player_id. ``schedule``: team_id, source_match_id, opponent,
    outcome, opponent_id, played_on, result, seen.

    A team with an ambiguous name on its roster or schedule changes nothing at all. A snapshot is trusted if it
    is observed, newer than the one applied last and from the same page. Trusted ones take members back and retire
    absent ones; others only add members that the team never had. An observed snapshot that is not stale
    becomes the team's baseline.
    """
    named = roster.select("team_id", F.lit("roster").alias("context"), "name", "outcome").union(schedule.select("team_id", F.lit("schedule").alias("context"), F.col("opponent"), "outcome"))
    held = state["teams"].select("team_id", "roster_observed_at", "roster_observed_url")
    judged = snapshots.join(held, "team_id").join(refused_subjects(named, "team_id"), "team_id", "left")
    fresh = F.col("observed_at").isNotNull() & (F.col("roster_observed_at").isNull() | (F.col("observed_at") > F.col("roster_observed_at")))
    trusted = F.coalesce(fresh & (F.col("roster_observed_url") == F.col("url")), F.lit(False))
    judged = judged.select("team_id", "url", "observed_at", "ambiguous", fresh.alias("fresh"), trusted.alias("trusted"))
    taken = judged.where("ambiguous IS NULL")

    moved = taken.where("fresh").select("team_id", F.col("observed_at").alias("__at"), F.col("url").alias("__url"))
    teams = state["teams"].join(moved, "team_id", "left")
    told = {"roster_observed_at": F.coalesce("__at", "roster_observed_at"), "roster_observed_url": F.coalesce("__url", "roster_observed_url")}
    teams = teams.select(*[told.get(c, F.col(c)).alias(c) for c in state["teams"].columns])

    observed = roster.join(taken.select("team_id", "trusted"), "team_id").select("team_id", "player_id", "trusted").distinct()
    members = state["memberships"]
    season = members.where("event_id IS NULL")
    back = observed.where("trusted").select("team_id", "player_id", F.lit(True).alias("__back"))
    sure = observed.where("trusted").select("team_id").distinct().withColumn("__sure", F.lit(True))
    kept = season.join(back, ["team_id", "player_id"], "left").join(sure, "team_id", "left")
    kept = kept.withColumn("retired", F.when(F.col("__back"), False).when(F.col("__sure"), True).otherwise(F.col("retired"))).select(members.columns)
    event = members.schema["event_id"].dataType
    new = observed.join(season.select("team_id", "player_id"), ["team_id", "player_id"], "leftanti").select("player_id", "team_id", F.lit(None).cast(event).alias("event_id"), F.lit(False).alias("retired"))
    memberships = members.where("event_id IS NOT NULL").unionByName(kept).unionByName(new.select(members.columns))

    counts = result_counts(F.col("result"))
    played = schedule.join(taken.select("team_id"), "team_id").select(
        "source_match_id", F.lit(None).cast(state["team_matches"].schema["event_id"].dataType).alias("event_id"), F.col("team_id").alias("home_team_id"), F.col("opponent_id").alias("visiting_team_id"), "played_on",
        counts["home"].alias("home_courts_won"), counts["visiting"].alias("visiting_courts_won"), "seen",
    )
    matches = merge_team_matches(state["team_matches"], played).select(state["team_matches"].columns)
    after = {"teams": teams, "memberships": memberships, "team_matches": matches}
    return after, judged.select("team_id", F.when(F.col("ambiguous").isNull(), "pulled").otherwise("refused").alias("outcome"), "ambiguous", F.when(F.col("ambiguous").isNull(), F.col("trusted")).alias("trusted"))


def player_pulls(state: dict[str, DataFrame], pulled: DataFrame, seats: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """The state after pulls of match histories, and url, outcome and ambiguous of each page.

    ``state``: courts as ``merge_courts`` has them and court_players (source_match_id, slot, player_id, side). ``pulled``: url, seen and the
    courts' columns; ``seats``: url, source_match_id, slot, name, outcome, player_id, side. A page with an
    ambiguous name changes nothing. Players are only added or change sides: a page names those it knows.
    """
    refused = refused_subjects(seats.withColumn("context", F.lit("court")), "url")
    ours = pulled.join(refused.select("url"), "url", "leftanti")
    courts = merge_courts(state["courts"], ours).select(state["courts"].columns)
    keys = ["source_match_id", "slot", "player_id"]
    sat = seats.join(refused.select("url"), "url", "leftanti").join(ours.select("url", "source_match_id", "slot", "seen"), ["url", "source_match_id", "slot"])
    players = merge_latest(state["court_players"], sat.select(*keys, "side", "seen").groupBy(*keys).agg(F.max_by("side", "seen").alias("side")), keys, ["side"])
    pages = pulled.select("url").distinct().join(refused, "url", "left")
    return {"courts": courts, "court_players": players}, pages.select("url", F.when(F.col("ambiguous").isNull(), "pulled").otherwise("refused").alias("outcome"), "ambiguous")


def archived_profiles(profiles: DataFrame, players: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Players after saved profile pages, and request, outcome and id of each.

    ``profiles``: request, key, name, tennis_id, age_range, gender; ``players``: id, key, tennis_id, age_range, gender. A page
    of this kind is taken by its id alone: one that meets a player by name whose stored id is another or none is
    refused (``name-only``), since two people can share a name. Ambiguous names are refused too; what nobody
    has is ``created`` and left to the caller. A null on the page overwrites nothing.
    """
    found = player_ladder(profiles.select("request", "key", "tennis_id"), players.select("id", "key", "tennis_id"), aliases, ["tennis_id"])
    held = players.select("id", F.col("tennis_id").alias("__held"))
    said = profiles.join(found.select("request", "outcome", "id"), "request").join(held, "id", "left")
    refused = (F.col("outcome") == "matched") & ~F.col("__held").eqNullSafe(F.col("tennis_id"))
    said = said.withColumn("outcome", F.when(refused, "name-only").otherwise(F.col("outcome")))
    told = said.where("outcome = 'matched'").groupBy("id").agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("request"))).alias(f"__{c}") for c in ("age_range", "gender")])
    after = players.join(told, "id", "left")
    after = after.select(*[(F.coalesce(f"__{c}", c) if c in ("age_range", "gender") else F.col(c)).alias(c) for c in players.columns])
    return after, said.select("request", "outcome", F.when(F.col("outcome") == "matched", F.col("id")).alias("id"))
