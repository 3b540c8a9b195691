"""Scorecards written as a whole: the team match, its courts and who played on them.

A refused card changes nothing (``scorecard_outcomes`` says why). An accepted one finds its team match or
brings a new one, replaces each court that it names together with all players of that court, and leaves
courts that it does not name alone. Cards are applied in order of ``card``, as if one came after the other: only
cards of one day and pair of teams can meet, so the n-th such card of each pair is applied in the n-th round,
all pairs at once. There are as many rounds as the busiest pair of one day has cards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rallyframe.operators.ingest import fixture_candidates, scorecard_outcomes
from rallyframe.sources.store import Store, written

TABLES = ("team_matches", "courts", "court_players")


def apply_cards(state: dict[str, DataFrame], cards: DataFrame, courts: DataFrame, seats: DataFrame, events: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """The new state and the outcomes (card, outcome, match_id) of cards of which no two have a day and pair of teams in common.

    ``state``: team_matches (match_id, event_id, home_team_id, visiting_team_id, played_on, scheduled_time, site and more),
    courts (match_id, slot, discipline, winner_side, score, played_on) and court_players (match_id, slot, player_id, side).
    ``cards`` as ``scorecard_outcomes`` takes them, with ``new_id``, the id of a team match that the card may bring; ``courts``
    (card, slot, discipline, winner_side, score) and ``seats`` (card, slot, player_id, side, on_roster) say what is on them.
    """
    matches = state["team_matches"]
    outcomes = scorecard_outcomes(cards, seats.select("card", "slot", "player_id", "on_roster"), events, matches)
    parents = fixture_candidates(cards.withColumnRenamed("card", "request"), matches).select(F.col("request").alias("card"), F.col("match_id").alias("parent"))
    outcomes = written(outcomes, "card-outcomes")  # four tables are made of it
    named = cards.join(outcomes, "card").join(parents, "card", "left").join(events.select("event_name", F.col("event_id").alias("named_event")), "event_name", "left")
    taken = named.where("outcome = 'accepted'").select("card", F.coalesce("parent", "new_id").alias("match_id"), "parent", "named_event", "played_on", "home_team_id", "visiting_team_id", "scheduled_time", "site")
    taken = written(taken, "card-targets")

    # A found match keeps what it has and is told what it lacks.
    told = taken.where("parent IS NOT NULL").select("match_id", F.col("named_event").alias("__event"), F.col("scheduled_time").alias("__time"), F.col("site").alias("__site"))
    kept = matches.join(told, "match_id", "left")
    filled = {"event_id": F.coalesce("event_id", "__event"), "scheduled_time": F.coalesce("scheduled_time", "__time"), "site": F.coalesce("site", "__site")}
    kept = kept.select(*[filled.get(c, F.col(c)).alias(c) for c in matches.columns])
    new = taken.where("parent IS NULL").withColumnRenamed("named_event", "event_id")
    new = new.select(*[(F.col(c) if c in new.columns else F.lit(None)).cast(matches.schema[c].dataType).alias(c) for c in matches.columns])

    played = courts.join(taken.select("card", "match_id", "played_on"), "card")
    named_courts = played.select("match_id", "slot").distinct()
    columns = state["courts"].columns
    all_courts = state["courts"].join(named_courts, ["match_id", "slot"], "leftanti").unionByName(played.select(*columns))
    sat = seats.join(taken.select("card", "match_id"), "card").select(*state["court_players"].columns)
    players = state["court_players"].join(named_courts, ["match_id", "slot"], "leftanti").unionByName(sat)
    after = {"team_matches": kept.unionByName(new), "courts": all_courts, "court_players": players}
    return after, outcomes.join(taken.select("card", "match_id"), "card", "left")


def ingest_cards(store: Store, cards: DataFrame, courts: DataFrame, seats: DataFrame, events: DataFrame) -> DataFrame:
    """Apply the cards to the store, one commit for each round; returns card, outcome and match_id of all."""
    pair = Window.partitionBy("played_on", F.least("home_team_id", "visiting_team_id"), F.greatest("home_team_id", "visiting_team_id")).orderBy("card")
    dealt = written(cards.withColumn("__round", F.row_number().over(pair)), "cards-dealt")
    courts, seats = written(courts, "cards-courts"), written(seats, "cards-seats")
    rounds = dealt.agg(F.max("__round")).first()[0] or 0
    done = None
    for k in range(1, rounds + 1):
        base = store.version()
        now = dealt.where(F.col("__round") == k).drop("__round")
        ours = now.select("card")
        after, said = apply_cards(store.tables(base), now, courts.join(ours, "card", "leftsemi"), seats.join(ours, "card", "leftsemi"), events)
        version = store.commit({**after, f"outcomes_{k}": said}, base)
        said = store.tables(version)[f"outcomes_{k}"]
        done = said if done is None else done.union(said)
    if done is None:
        return cards.select("card", F.lit("accepted").alias("outcome"), F.lit(None).cast("long").alias("match_id")).where("false")
    return done
