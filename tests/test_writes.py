"""What is written as a whole: the store, scorecards, pulls of teams and players, saved profiles."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from rallyframe.operators import cards, identity, pull
from rallyframe.sources.store import Conflict, Store, shared_folder

DAY = datetime.date(2026, 5, 1)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_a_commit_is_seen_as_a_whole_or_not_at_all(spark):
    store = Store(spark, shared_folder(spark, "t"))
    assert store.version() == 0 and store.tables() == {}
    one, two = spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([(2,)], "a int")
    base = store.commit({"x": one, "y": one})
    held = store.tables()

    class Broken(Exception):
        pass

    def fails(_):
        raise Broken

    bad = two.select(F.udf(fails, "int")("a").alias("a"))
    with pytest.raises(Exception, match="Broken"):
        store.commit({"x": two, "y": bad})  # fails between its two tables
    assert store.version() == base and rows(store.read("x")) == [(1,)] and rows(store.read("y")) == [(1,)]
    store.commit({"x": two}, base)
    assert rows(store.read("x")) == [(2,)] and rows(store.read("y")) == [(1,)] and rows(held["x"]) == [(1,)]
    with pytest.raises(Conflict):
        store.commit({"y": two}, base)  # made from a state that is gone
    assert rows(store.read("y")) == [(1,)]
    assert store.vacuum(1) > 0 and rows(store.read("x")) == [(2,)] and rows(store.read("y")) == [(1,)]


MATCHES = "match_id long, event_id int, home_team_id int, visiting_team_id int, played_on date, scheduled_time string, site string, home_courts_won long"
CARDS = "card long, new_id long, played_on date, scheduled_time string, site string, home_team_id int, visiting_team_id int, event_name string, slot_twice boolean, teams_known boolean"
COURTS = "match_id long, slot string, discipline string, winner_side string, score string, played_on date"


def one_after_the_other(state, cards_, courts, seats, events):
    """The same by a loop over the cards; times and sites are compared as they are."""
    matches = {m[0]: list(m) for m in state[0]}
    on = {(c[0], c[1]): c for c in state[1]}
    sat = {(p[0], p[1], p[2]): p[3] for p in state[2]}
    said = {}
    for card, new, day, time, site, home, away, event, twice, known in sorted(cards_):
        mine = [x for x in seats if x[0] == card]
        found = [m for m in matches.values() if m[4] == day and {m[2], m[3]} == {home, away}]
        exact = [m for m in found if m[5] == time and m[6] == site]
        loose = exact or [m for m in found if (m[5] is None or time is None or m[5] == time) and (m[6] is None or site is None or m[6] == site)]
        refusal = (
            "duplicate-slots" if twice else "unknown-team" if not known else "same-team" if home == away else "unknown-event" if event and event not in events else "unresolved-players" if any(not x[4] for x in mine)
            else "duplicate-players" if len({(x[1], x[2]) for x in mine}) < len(mine) else "ambiguous-parent-match" if len(loose) > 1 else "conflicting-parent-event" if loose and event and loose[0][1] not in (None, events[event]) else None
        )
        if refusal:
            said[card] = (refusal, None)
            continue
        if loose:
            m = loose[0]
            m[1], m[5], m[6] = m[1] if m[1] is not None else events.get(event), m[5] or time, m[6] or site
        else:
            m = matches[new] = [new, events.get(event), home, away, day, time, site, None]
        said[card] = ("accepted", m[0])
        for c, slot, discipline, winner, score in courts:
            if c == card:
                on[m[0], slot] = (m[0], slot, discipline, winner, score, day)
                sat = {k: v for k, v in sat.items() if k[:2] != (m[0], slot)}
        for c, slot, player, side, _ in mine:
            sat[m[0], slot, player] = side
    return matches, on, sat, said


def test_cards_equal_a_loop_over_them(spark):
    rng = random.Random(7)
    when = lambda: rng.choice((None, "9:00", "17:00"))
    where = lambda: rng.choice((None, "north", "south"))
    teams = [(1, 2), (2, 1), (3, 4), (5, 6), (6, 5)]
    stored = [(k, rng.choice((None, 1, 2)), *rng.choice(teams), DAY + datetime.timedelta(rng.randint(0, 2)), when(), where(), rng.randint(0, 5)) for k in range(12)]
    on = [(k, slot, "singles", "home", "6-0", stored[k][4]) for k in range(12) for slot in ("S1", "S2")]
    sat = [(k, slot, 100 + k, "home") for k in range(12) for slot in ("S1", "S2")]
    cards_, courts, seats = [], [], []
    for c in range(50, 74):
        home, away = rng.choice(teams) if rng.random() < 0.95 else (1, 1)
        cards_.append((c, 1000 + c, DAY + datetime.timedelta(rng.randint(0, 2)), when(), where(), home, away, rng.choice((None, None, "cup", "open", "no")), rng.random() < 0.05, rng.random() < 0.95))
        for slot in rng.sample(("S1", "S2", "D1"), rng.randint(1, 3)):
            courts.append((c, slot, "singles", rng.choice((None, "home")), f"6-{c % 5}"))
            for _ in range(rng.randint(0, 2)):
                seats.append((c, slot, rng.randint(1, 40), rng.choice(("home", "visiting")), rng.random() < 0.97))
    state = {"team_matches": spark.createDataFrame(stored, MATCHES), "courts": spark.createDataFrame(on, COURTS), "court_players": spark.createDataFrame(sat, "match_id long, slot string, player_id long, side string")}
    store = Store(spark, shared_folder(spark, "t"))
    store.commit(state)
    events = {"cup": 1, "open": 2}
    said = cards.ingest_cards(
        store, spark.createDataFrame(cards_, CARDS), spark.createDataFrame(courts, "card long, slot string, discipline string, winner_side string, score string"),
        spark.createDataFrame(seats, "card long, slot string, player_id long, side string, on_roster boolean"), spark.createDataFrame(list(events.items()), "event_name string, event_id int"),
    )
    matches, courts_, sat_, want = one_after_the_other((stored, on, sat), cards_, courts, seats, events)
    assert {r["card"]: (r["outcome"], r["match_id"]) for r in said.collect()} == want
    assert len({w[0] for w in want.values()}) >= 6 and sum(w[0] == "accepted" for w in want.values()) > 5
    assert rows(store.read("team_matches")) == sorted(map(tuple, matches.values()), key=str)
    assert rows(store.read("courts")) == sorted(courts_.values(), key=str)
    assert rows(store.read("court_players")) == sorted(((*k, v) for k, v in sat_.items()), key=str)
    empty = cards.ingest_cards(store, spark.createDataFrame([], CARDS), store.read("courts"), store.read("court_players"), spark.createDataFrame([], "event_name string, event_id int"))
    assert empty.collect() == [] and empty.columns == ["card", "outcome", "match_id"]


def test_result_counts(spark):
    said = {"3-2": (3, 2), "0 - 5": (0, 5), "bye": (None, None), "3-2 x": (None, None), "": (None, None), None: (None, None), "-1": (None, None), "3-2\n": (None, None)}
    got = spark.createDataFrame([(k,) for k in said], "r string").select("r", pull.result_counts(F.col("r")).alias("c")).collect()
    assert {r["r"]: tuple(r["c"]) for r in got} == said


def test_a_team_pull_is_refused_as_a_whole(spark):
    day = lambda k: DAY + datetime.timedelta(k)
    teams = [(1, "a", day(1), "u1"), (2, "b", day(1), "u2"), (3, "c", None, None), (4, "d", day(5), "u4"), (5, "e", day(1), "old"), (6, "f", day(1), "u6")]
    members = [(10 * t + k, t, None, k == 1) for t in range(1, 7) for k in (1, 2, 3)] + [(12, 1, 7, False)]
    state = {
        "teams": spark.createDataFrame(teams, "team_id int, name string, roster_observed_at date, roster_observed_url string"), "memberships": spark.createDataFrame(members, "player_id long, team_id int, event_id int, retired boolean"),
        "team_matches": spark.createDataFrame([("m1", 9, 1, 2, DAY, 3, 2)], "source_match_id string, event_id int, home_team_id int, visiting_team_id int, played_on date, home_courts_won int, visiting_courts_won int"),
    }
    snapshots = spark.createDataFrame([(t, f"u{t}", None if t == 6 else day(3)) for t in range(1, 7)], "team_id int, url string, observed_at date")
    # each roster names player 1 (retired) and 2, and a new one; team 2 has an ambiguous name, not 3
    roster = spark.createDataFrame([(t, f"n{k}", "ambiguous" if (t, k) == (2, 9) else "matched", 10 * t + k) for t in range(1, 7) for k in (1, 2, 9)], "team_id int, name string, outcome string, player_id long")
    schedule = spark.createDataFrame([(1, "m1", "x", "matched", 4, day(2), "bye", 1), (2, "m2", "x", "matched", 4, day(2), "3-2", 1), (3, "m3", "x", "matched", 4, day(2), "3-2", 1)], "team_id int, source_match_id string, opponent string, outcome string, opponent_id int, played_on date, result string, seen long")
    after, said = pull.team_pulls(state, snapshots, roster, schedule)
    assert {r["team_id"]: (r["outcome"], r["ambiguous"], r["trusted"]) for r in said.collect()} == {1: ("pulled", None, True), 2: ("refused", "roster: n9", None), 3: ("pulled", None, False), 4: ("pulled", None, False), 5: ("pulled", None, False), 6: ("pulled", None, False)}
    got = {}
    for p, t, e, retired in after["memberships"].collect():
        if e is None:
            got.setdefault(t, {})[p - 10 * t] = retired
    kept = {1: True, 2: False, 3: False}
    assert got == {1: {1: False, 2: False, 3: True, 9: False}, 2: kept} | {t: kept | {9: False} for t in (3, 4, 5, 6)}
    assert {r["team_id"]: (r["roster_observed_at"], r["roster_observed_url"]) for r in after["teams"].collect()} == {1: (day(3), "u1"), 2: (day(1), "u2"), 3: (day(3), "u3"), 4: (day(5), "u4"), 5: (day(3), "u5"), 6: (day(1), "u6")}
    assert rows(after["team_matches"]) == [("m1", 9, 1, 4, day(2), None, None), ("m3", None, 3, 4, day(2), 3, 2)]


def test_a_player_pull_is_refused_as_a_whole(spark):
    columns = "source_match_id string, slot string, discipline string, winner_side string, score string, league_context string, played_on date, team_match_id long"
    state = {"courts": spark.createDataFrame([("m1", "S1", "singles", "home", "6-0", None, DAY, None)], columns), "court_players": spark.createDataFrame([("m1", "S1", 1, "home")], "source_match_id string, slot string, player_id long, side string")}
    pulled = spark.createDataFrame([("a", 1, "m1", "S1", "singles", "visiting", "6-1", "L", DAY, None), ("b", 2, "m2", "S1", "singles", "home", "6-2", "L", DAY, None)], "url string, seen long, " + columns)
    seats = spark.createDataFrame([("a", "m1", "S1", "x", "matched", 1, "visiting"), ("a", "m1", "S1", "y", "created", 2, "home"), ("b", "m2", "S1", "x", "matched", 1, "home"), ("b", "m2", "S1", "z", "ambiguous", None, "visiting")], "url string, source_match_id string, slot string, name string, outcome string, player_id long, side string")
    after, said = pull.player_pulls(state, pulled, seats)
    assert rows(said) == [("a", "pulled", None), ("b", "refused", "court: z")]
    assert rows(after["courts"].select("source_match_id", "score")) == [("m1", "6-1")]
    assert rows(after["court_players"]) == [("m1", "S1", 1, "visiting"), ("m1", "S1", 2, "home")]


def test_saved_profiles_are_taken_by_their_id_only(spark):
    players = spark.createDataFrame([(1, "ann co", "t1", "18+", None), (2, "bo day", None, "18+", "F"), (3, "cy eve", "t3", None, None), (4, "dee foy", "t4", None, None), (5, "dee foy", "t5", None, None)], "id long, key string, tennis_id string, age_range string, gender string")
    pages = [(1, "anything", "x", "t1", None, "F"), (2, "bo day", "x", "t9", "40+", "M"), (3, "cy eve", "x", "t8", "40+", None), (4, "dee foy", "x", "t7", None, None), (5, "quite other", "x", "t6", None, None), (6, "x", "x", "t1", "55+", None)]
    after, said = pull.archived_profiles(spark.createDataFrame(pages, "request long, key string, name string, tennis_id string, age_range string, gender string"), players, players.select("key", "id").limit(0))
    assert rows(said) == [(1, "matched", 1), (2, "name-only", None), (3, "name-only", None), (4, "ambiguous", None), (5, "created", None), (6, "matched", 1)]
    assert {r["id"]: (r["age_range"], r["gender"]) for r in after.collect()} == {1: ("55+", "F"), 2: ("18+", "F"), 3: (None, None), 4: (None, None), 5: (None, None)}


def test_long_targets_are_taken_whole(spark):
    long = "id:" + "x" * 5000
    df = spark.createDataFrame([(1, long + "a"), (2, long + "b"), (3, "Jo")], "request long, target string")
    got = {r["request"]: (r["route"], r["value"]) for r in identity.routed(df, {"id:": "uaid"}).collect()}
    assert got == {1: ("uaid", long[3:] + "a"), 2: ("uaid", long[3:] + "b"), 3: ("name", "Jo")}


def test_cards_are_made_once_however_many_tables_they_change(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def on_roster(card):
        seen.add(1)
        return True

    state = {"team_matches": spark.createDataFrame([], MATCHES), "courts": spark.createDataFrame([], COURTS), "court_players": spark.createDataFrame([], "match_id long, slot string, player_id long, side string")}
    store = Store(spark, shared_folder(spark, "t"))
    store.commit(state)
    made = spark.createDataFrame([(1, 11, DAY, None, None, 1, 2, None, False, True)], CARDS)
    courts = spark.createDataFrame([(1, "S1", "singles", "home", "6-0")], "card long, slot string, discipline string, winner_side string, score string")
    seats = spark.createDataFrame([(1, "S1", 7, "home"), (1, "S1", 8, "visiting")], "card long, slot string, player_id long, side string").withColumn("on_roster", on_roster("card"))
    said = cards.ingest_cards(store, made, courts, seats, spark.createDataFrame([], "event_name string, event_id int"))
    assert [tuple(r) for r in said.collect()] == [(1, "accepted", 11)] and store.read("court_players").count() == 2
    assert seen.value == 2
