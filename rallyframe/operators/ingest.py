"""What an ingest has to decide before it writes: candidates, refusals, dispositions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rallyframe.functions.keys import NULL_KEY, site_key, time_key


def fixture_candidates(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """For each incoming fixture (request, played_on, home_team_id, visiting_team_id, scheduled_time, site) the stored match it means.

    Candidates have the same day and unordered pair of teams. Exact: time and site both agree (both
    null, or equal by key). Lenient: each is null on a side, or equal by key. One exact candidate
    decides; without any, one lenient candidate does; several in the deciding tier are ambiguous; none
    is new.
    """
    def keyed(df: DataFrame, *ids: str) -> DataFrame:
        return df.select(*ids, "played_on", F.least("home_team_id", "visiting_team_id").alias("low"), F.greatest("home_team_id", "visiting_team_id").alias("high"), time_key(F.col("scheduled_time")).alias(f"{ids[0]}_time"), site_key(F.col("site")).alias(f"{ids[0]}_site"))

    found = keyed(incoming, "request").join(keyed(stored, "match_id"), ["played_on", "low", "high"], "left")
    there, exact, lenient = F.col("match_id").isNotNull(), F.lit(True), F.lit(True)
    for part in ("time", "site"):
        wanted, has = F.col(f"request_{part}"), F.col(f"match_id_{part}")
        exact, lenient = exact & (wanted == has), lenient & ((wanted == has) | (wanted == NULL_KEY) | (has == NULL_KEY))
    n = found.groupBy("request").agg(F.count(F.when(there & exact, 1)).alias("exact"), F.count(F.when(there & lenient, 1)).alias("lenient"), F.min(F.when(there & exact, F.col("match_id"))).alias("e"), F.min(F.when(there & lenient, F.col("match_id"))).alias("l"))
    deciding = F.when(F.col("exact") > 0, F.col("exact")).otherwise(F.col("lenient"))
    return n.select("request", "exact", "lenient", F.when(deciding == 1, F.coalesce("e", "l")).alias("match_id"), F.when(deciding == 0, "new").when(deciding == 1, "matched").otherwise("ambiguous").alias("outcome"))


def scorecard_outcomes(cards: DataFrame, seats: DataFrame, events: DataFrame, stored: DataFrame) -> DataFrame:
    """What becomes of each scorecard: accepted, or the first of the eight refusals it runs into.

    ``cards``: card, played_on, scheduled_time, site, home_team_id, visiting_team_id, event_name (null: none), slot_twice,
    teams_known. ``seats``: card, slot, player_id and whether its name was resolved on the side's roster
    (on_roster), one row for each time a name stands on a court. ``events``: event_name, event_id. ``stored``:
    the team matches. A refused card changes nothing.
    """
    wrong = seats.groupBy("card").agg(F.bool_or(~F.col("on_roster")).alias("unresolved"))
    twice = seats.groupBy("card", "slot", "player_id").agg(F.count("*").alias("n")).where("n > 1").select("card", F.lit(True).alias("twice")).distinct()
    parents = fixture_candidates(cards.withColumnRenamed("card", "request"), stored).select(F.col("request").alias("card"), "match_id", F.col("outcome").alias("parent"))
    held = stored.select("match_id", F.col("event_id").alias("held_event"))
    all_ = cards.join(events.select("event_name", "event_id"), "event_name", "left").join(wrong, "card", "left").join(twice, "card", "left").join(parents, "card", "left").join(held, "match_id", "left")
    refusal = (
        F.when(F.col("slot_twice"), "duplicate-slots").when(~F.col("teams_known"), "unknown-team").when(F.col("home_team_id") == F.col("visiting_team_id"), "same-team")
        .when(F.col("event_name").isNotNull() & F.col("event_id").isNull(), "unknown-event").when(F.coalesce("unresolved", F.lit(False)), "unresolved-players").when(F.coalesce("twice", F.lit(False)), "duplicate-players")
        .when(F.col("parent") == "ambiguous", "ambiguous-parent-match").when(F.col("held_event") != F.col("event_id"), "conflicting-parent-event")
    )
    return all_.select("card", F.coalesce(refusal, F.lit("accepted")).alias("outcome"))


def orphaned_availability(answers: DataFrame, starts_on: Column, ends_on: Column) -> DataFrame:
    """Recorded answers that a new range of their event would leave outside; any of them refuses the change."""
    return answers.where((F.col("day") < starts_on) | (F.col("day") > ends_on))


def answer_outcomes(attempts: DataFrame, members: DataFrame, events: DataFrame) -> DataFrame:
    """What becomes of each answer (attempt, player_id, day): only members may answer, and one event must cover the day.

    An event is taken apart into its days, so that days meet by an equi-join.
    """
    days = attempts.select("day").distinct()
    open_days = events.where("starts_on <= ends_on").select("event_id", F.explode(F.sequence("starts_on", "ends_on")).alias("day"))
    covered = days.join(open_days, "day", "left")
    covered = covered.groupBy("day").agg(F.count("event_id").alias("events"), F.min("event_id").alias("event_id"))
    known = members.select("player_id").distinct().withColumn("__member", F.lit(True))
    out = attempts.join(known, "player_id", "left").join(covered, "day", "left")
    outcome = F.when(F.col("__member").isNull(), "not a member").when(F.col("events") == 0, "no event").when(F.col("events") > 1, "ambiguous event").otherwise("recorded")
    return out.select("attempt", "player_id", "day", outcome.alias("outcome"), F.when(outcome == "recorded", F.col("event_id")).alias("event_id"))


# What marks a failure of the attempt rather than of the request.
RETRYABLE_STATUSES = (408, 425, 429)  # and 500 to 599
RETRYABLE_CODES = ("ECONNRESET", "ECONNREFUSED", "ETIMEDOUT", "EAI_AGAIN", "EPIPE", "SQLITE_LOCKED", "SQLITE_LOCKED_SHAREDCACHE")
RETRYABLE_CODE_PREFIX = "SQLITE_BUSY"
RETRYABLE_NAMES = ("TimeoutError", "AbortError")
PERMANENT_KINDS = ("ParseError", "AmbiguousIdentityError")
CAUSE_DEPTH = 16


def disposition(chain: Column) -> Column:
    """Whether a failure is worth another try: the first link of its chain of causes that says so, of the first 16.

    ``chain``: array of struct(kind, status, name, code). A ``FetchError`` speaks by its status alone; other
    links by their kind, name or code.
    """

    def link(e: Column) -> Column:
        s = e["status"]
        whole = s.isNotNull() & (s == F.floor(s)) & (F.abs(s) < 1e15)
        by_status = F.when(~whole, "unclassified").when(s.isin(*RETRYABLE_STATUSES) | s.between(500, 599), "retryable").otherwise("permanent")
        return F.when(e["kind"] == "FetchError", by_status).when(e["kind"].isin(*PERMANENT_KINDS), "permanent").when(e["name"].isin(*RETRYABLE_NAMES) | e["code"].isin(*RETRYABLE_CODES) | e["code"].startswith(RETRYABLE_CODE_PREFIX), "retryable")

    said = F.filter(F.transform(F.slice(chain, 1, CAUSE_DEPTH), link), lambda v: v.isNotNull())
    return F.coalesce(F.get(said, F.lit(0)), F.lit("unclassified"))


def skip_counts(failures: DataFrame, by: str) -> DataFrame:
    """How many of each subject's failures are retryable, permanent and unclassified."""
    return failures.groupBy(by).agg(*[F.count(F.when(F.col("disposition") == d, 1)).alias(d) for d in ("retryable", "permanent", "unclassified")])


def seasons(newest: Column, oldest: Column, cap: int = 10) -> Column:
    """Years from the newest to the oldest; null if reversed, or if there are more than ``cap``."""
    return F.when((newest >= oldest) & (newest - oldest < cap), F.sequence(newest, oldest, F.lit(-1)))


def provenance(ratings: DataFrame) -> DataFrame:
    """Per player: first and last day and the distinct sources of its series."""
    return ratings.groupBy("player_id").agg(F.min("observed_on").alias("first_day"), F.max("observed_on").alias("last_day"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


def evidence_volumes(rows: DataFrame, team_matches: DataFrame, roster: DataFrame) -> DataFrame:
    """Per team: court rows of its members, those of matches of other teams, and those on the opposing side of its own."""
    played = rows.select("match_id", "player_id", "side").join(roster.select("team_id", "player_id"), "player_id").join(team_matches.select("match_id", "home_team_id", "visiting_team_id"), "match_id", "left")
    ours = F.when(F.col("team_id") == F.col("home_team_id"), "home").when(F.col("team_id") == F.col("visiting_team_id"), "visiting")
    theirs = F.when(F.col("side") == "O", "home").otherwise("visiting")
    return played.groupBy("team_id").agg(F.count("*").alias("observed"), F.count(F.when(ours.isNull(), 1)).alias("excluded_other_team"), F.count(F.when(ours != theirs, 1)).alias("excluded_opposing_side"))
