from datetime import date
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from rallyframe.functions import keys
from rallyframe.operators import identity, lineup, merge, ratings, roster, scope


def test_latest_rating_breaks_day_ties_by_id_and_trajectory_is_ordered(spark):
    df = spark.createDataFrame([(1, 7, "x", 3.0, date(2026, 1, 2)), (3, 7, "x", 5.0, date(2026, 1, 2)), (2, 7, "x", 4.0, date(2026, 1, 1))], "rating_id long, player_id long, source string, value double, observed_on date")
    assert [r["value"] for r in ratings.latest(df).collect()] == [5.0]
    assert [r["rating_id"] for r in ratings.trajectory(df).orderBy("place").collect()] == [2, 1, 3]


def test_source_choice_and_inverted_ranks(spark):
    members = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 4)], "team_id int, player_id long")
    last = spark.createDataFrame([(1, "a", 5.0), (2, "a", 3.0), (1, "b", 1.0), (2, "b", 9.0)], "player_id long, source string, value double")
    chosen = ratings.choose_source(members, last, ["b", "a"])
    assert {r["team_id"]: (r["source"], r["covered"]) for r in chosen.collect()} == {1: ("b", 2), 2: (None, 0)}
    got = {r["player_id"]: r["rank"] for r in ratings.roster_rank(members, last, chosen, ["b"]).collect()}
    assert got == {1: 0, 2: 1, 3: 2, 4: 0}


def test_scope_keeps_unknown_contexts_under_both_modes(spark):
    df = spark.createDataFrame([("MIXED 18",), ("Adult",), (None,)], "league_context string")
    for text, want in (("exclude:Mixed", ["Adult", None]), ("only:mixed", ["MIXED 18", None])):
        got = df.where(scope.retains(F.col("league_context"), *scope.parse_scope(text))).collect()
        assert [r[0] for r in got] == want
    wide = spark.createDataFrame([("ＭＩＸＥＤ 18",), ("Ａdult",)], "league_context string")
    assert [r[0] for r in wide.where(scope.retains(F.col("league_context"), *scope.parse_scope("only:mixed"))).collect()] == ["ＭＩＸＥＤ 18"]
    for bad in ("Mixed", "exclude:", "exclude:a,A", "exclude:a,Ａ", "drop:x"):
        with pytest.raises(ValueError):
            scope.parse_scope(bad)


def test_days_of_reversed_or_open_events_are_none(spark):
    df = spark.createDataFrame([(1, date(2026, 1, 1), date(2026, 1, 3)), (2, date(2026, 1, 3), date(2026, 1, 1)), (3, None, date(2026, 1, 1))], "event_id int, starts_on date, ends_on date")
    assert roster.days_of(df).groupBy("event_id").count().collect() == [(1, 3)]


def test_rosters_fall_back_by_entry(spark):
    rows = [(1, 1, None, False), (2, 1, None, False), (1, 1, 5, False), (3, 2, None, False), (4, 2, None, True), (5, 3, 6, True), (6, 3, None, False), (7, 1, 9, False)]
    df = spark.createDataFrame(rows, "player_id long, team_id int, event_id int, retired boolean")
    entries = spark.createDataFrame([(1, 5), (1, 6), (2, 5), (3, 6), (4, 6)], "team_id int, event_id int")
    got = {(r["team_id"], r["event_id"], r["player_id"]): r["scope"] for r in roster.resolve_rosters(df, entries).collect()}
    assert got == {(1, 5, 1): "registered", (1, 6, 1): "season", (1, 6, 2): "season", (2, 5, 3): "season", (3, 6, 6): "season"}
    assert [tuple(r) for r in roster.absent(df, entries).collect()] == [(1, 5, 2)]
    field = sorted(map(tuple, roster.registered_teams(df, entries.union(spark.createDataFrame([(2, 7), (4, 7)], entries.schema))).collect()))
    assert field == [(1, 5), (1, 9), (2, 7), (3, 6), (4, 7)]  # event 6 has a (retired) registration, event 7 none


def test_own_team_rows(spark):
    rows = spark.createDataFrame([(1, 10, "h"), (1, 11, "v"), (2, 10, "v"), (3, 10, "h")], "match_id long, player_id long, side string")
    matches = spark.createDataFrame([(1, 7, 8), (2, 8, 7), (3, 1, 2)], "match_id long, home_team_id int, visiting_team_id int")
    members = spark.createDataFrame([(7, 10), (7, 11)], "team_id int, player_id long")
    got = {(r["match_id"], r["player_id"]): r["ours"] for r in roster.own_team_rows(rows, matches, members, "h").collect()}
    assert got == {(1, 10): True, (1, 11): False, (2, 10): True, (3, 10): None}


def test_fuzzy_join_equals_brute_force(spark):
    names = ["anna bell", "ana bell", "anna bel", "hanna bell", "bob", "rob", "bo", "b", "", "xanna belly", "nnaa bell", "annabell"]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            old, row[0] = row[0], i + 1
            for j, y in enumerate(b):
                old, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, old + (x != y))
        return row[-1]

    df = spark.createDataFrame([(n,) for n in names], "key string")
    got = {(r["key"], r["other_key"]): r["edits"] for r in keys.fuzzy_neighbours(df, df).collect()}
    assert got == {(a, b): d for a in names for b in names if 1 <= (d := distance(a, b)) <= 2}


def test_ladder_never_merges_a_near_key(spark):
    wanted = spark.createDataFrame([("a", "jo day"), ("b", "jo dai"), ("c", "sam"), ("d", "zzzzzz")], "request string, key string")
    canonical = spark.createDataFrame([("jo day", 1), ("sam", 2)], "key string, id long")
    aliases = spark.createDataFrame([("sam", 3)], "key string, id long")
    got = {r["request"]: (r["outcome"], r["id"]) for r in identity.ladder(wanted, canonical, aliases).collect()}
    assert got == {"a": ("matched", 1), "b": ("ambiguous-near", None), "c": ("ambiguous-exact", None), "d": ("new", None)}


def test_name_key_drops_invisible_characters_first(spark):
    df = spark.createDataFrame([("​  Ａnna­ ",), ("anna",), (None,)], "n string")
    assert [r[0] for r in df.select(keys.name_key(F.col("n"))).collect()] == ["anna", "anna", None]


TIMES = {
    "6:05 PM": "clock:18:05", "12:00 am": "clock:00:00", " 9 : 00  a.m. ": "clock:09:00", "09:00am": "clock:09:00", "9:00 P.M": "clock:21:00", "13:05 pm": "clock:13:05",
    "9:00": "raw:900", "23:59": "raw:2359", "9:00:00 am": "raw:90000am", "9:00 amx": "raw:900amx", "TBD": "raw:tbd", " - ": "lit:-", "": "lit:", None: keys.NULL_KEY,
}
SITES = {"St. Mary's": "raw:stmarys", "st marys": "raw:stmarys", "St Mary": "raw:stmary", "--  !": "lit:-- !", None: keys.NULL_KEY, "null": "raw:null"}


@pytest.mark.parametrize("key,cases", [(keys.time_key, TIMES), (keys.site_key, SITES)])
def test_time_and_site_keys(spark, key, cases):
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    assert {r["t"]: r["k"] for r in df.select("t", key(F.col("t")).alias("k")).collect()} == cases


def test_name_key_leaves_the_invisible_characters_of_other_scripts(spark):
    names = {"a\u0007b": "ab", "a\tb": "a\tb", "\u202eJo\ufe0f": "jo", "\u1100\u3164": "\u1100\u1160", "\u1820\u180e\u1820": "\u1820\u180e\u1820", "\u034fJosé": "josé", "\ufeff x": "x"}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r["n"]: r["k"] for r in df.select("n", keys.name_key(F.col("n")).alias("k")).collect()} == names


def test_merges_are_idempotent_and_swap_reversed_fixtures(spark):
    t = spark.createDataFrame([(1, "a", 1)], "k int, v string, i int")
    n = spark.createDataFrame([(1, "b", 2), (None, "c", 1), (None, "d", 3)], "k int, v string, i int")
    once = merge.merge_latest(t, n, ["k"], ["i"])
    twice = merge.merge_latest(once, n, ["k"], ["i"])
    assert sorted(map(tuple, once.collect()), key=str) == sorted(map(tuple, twice.collect()), key=str) == [(1, "b", 2), (None, "d", 3)]
    filled = merge.merge_filled(t, spark.createDataFrame([(1, None, 5)], t.schema), ["k"])
    assert [tuple(r) for r in filled.collect()] == [(1, "a", 5)]


FIXTURE = "match_id long, home_team_id int, visiting_team_id int, played_on date, scheduled_time string, site string, event_id int, home_courts_won long, visiting_courts_won long"


def test_fixtures_merge_by_pair_day_time_and_site(spark):
    day = date(2026, 1, 1)
    f = spark.createDataFrame(
        [
            (1, 9, 2, day, "9:00 AM", "St. Mary's", None, 3, 1), (2, 2, 9, day, "09:00am", "st marys", 5, 2, 4),  # one fixture, reversed
            (3, 9, 2, day, "5:00 PM", "St. Mary's", None, 0, 4),  # the same pair later on that day
            (4, 9, 2, None, None, None, 5, 1, 1), (5, 9, 2, None, None, None, 6, 9, 9),  # another event: refused
        ],
        FIXTURE,
    )
    got = {r["match_id"]: r for r in merge.merge_fixtures(f).collect()}
    assert set(got) == {1, 3, 4}
    assert (got[1]["home_team_id"], got[1]["home_courts_won"], got[1]["visiting_courts_won"], got[1]["event_id"], got[1]["scheduled_time"], got[1]["reports"], got[1]["conflict"]) == (9, 4, 2, 5, "9:00 AM", 2, False)
    assert (got[3]["home_courts_won"], got[3]["reports"]) == (0, 1)
    assert (got[4]["home_courts_won"], got[4]["event_id"], got[4]["conflict"]) == (1, 5, True)


def test_merges_by_source_id_and_presence(spark):
    row = "source_match_id string, event_id int, home_team_id int, visiting_team_id int, played_on date, home_courts_won long, visiting_courts_won long"
    stored = spark.createDataFrame([("a", 1, 1, 2, None, 3, 1), ("b", None, 1, 2, None, 3, 1), ("c", 2, 1, 2, None, 3, 1)], row)
    fresh = spark.createDataFrame([("a", None, 2, 1, None, None, 0, 1), ("b", 7, 1, 2, None, 0, 0, 1), ("b", 8, 1, 2, None, 5, 0, 2), ("c", 9, 5, 6, None, 9, 9, 1), ("d", None, 1, 3, None, 1, 1, 1), (None, 1, 1, 1, None, 1, 1, 1)], row + ", seen long")
    got = {r["source_match_id"]: (r["event_id"], r["home_team_id"], r["home_courts_won"], r["conflict"]) for r in merge.merge_team_matches(stored, fresh).collect()}
    assert got == {"a": (1, 2, None, False), "b": (8, 1, 5, False), "c": (2, 1, 3, True), "d": (None, 1, 1, False)}
    players = spark.createDataFrame([(1, "Jo", "x", "jo"), (2, "Al", "y", "al")], "player_id long, name string, age_range string, name_key string")
    change = spark.createDataFrame([(1, (True, "Jo Ann "), (True, None)), (3, (True, "No"), (False, None))], "player_id long, name struct<given: boolean, value: string>, age_range struct<given: boolean, value: string>")
    assert sorted(map(tuple, merge.merge_players(players, change).collect())) == [(1, "Jo Ann ", None, "jo ann"), (2, "Al", "y", "al")]


def test_source_ids_decide_before_names(spark):
    stored = spark.createDataFrame([(1, "jo day", "u1", None), (2, "jo day", None, "w2"), (3, "sam", "u3", "w2")], "id long, key string, a string, b string")
    aliases = spark.createDataFrame([("joey", 1)], "key string, id long")
    wanted = spark.createDataFrame([("p", "sam", "u1", "w2"), ("q", "zzz", "nobody", "w2"), ("r", "joey", None, None), ("s", "jo day", None, None), ("t", "samm", None, None), ("u", "entirely new", None, None)], "request string, key string, a string, b string")
    got = {r["request"]: (r["tier"], r["outcome"], r["id"]) for r in identity.player_ladder(wanted, stored, aliases, ["a", "b"]).collect()}
    assert got == {"p": ("source-id", "matched", 1), "q": ("source-id", "matched", 2), "r": ("name", "matched", 1), "s": ("name", "ambiguous", None), "t": ("near", "ambiguous", None), "u": ("none", "created", None)}
    members = spark.createDataFrame([(7, 1), (7, 1), (7, 3), (8, 2)], "team_id int, player_id long")
    asked = wanted.select("request", "key", F.when(F.col("request") == "s", 8).otherwise(7).alias("team_id"))
    got = {r["request"]: (r["outcome"], r["id"]) for r in identity.roster_ladder(asked, stored, aliases, members).collect()}
    assert got == {"p": ("matched", 3), "q": ("unresolved", None), "r": ("matched", 1), "s": ("matched", 2), "t": ("ambiguous", None), "u": ("unresolved", None)}


def test_retire_absent_leaves_unobserved_teams_alone(spark):
    m = spark.createDataFrame([(1, 1, None, False), (2, 1, None, False), (2, 1, 4, False), (3, 2, None, False)], "player_id long, team_id int, event_id int, retired boolean")
    seen = spark.createDataFrame([(1, 1)], "player_id long, team_id int")
    got = {(r["player_id"], r["event_id"]): r["retired"] for r in merge.retire_absent(m, seen).collect()}
    assert got == {(1, None): False, (2, None): True, (2, 4): False, (3, None): False}


def _lineup(spark, slots, ranks, singles, pairs):
    make = spark.createDataFrame
    got = lineup.predicted_lineup(
        make(slots, "team_id int, slot string, discipline string, place int"), make(ranks, "team_id int, player_id long, rank long"), make(singles, "team_id int, player_id long, matches long"),
        make(pairs, "team_id int, low_id long, high_id long, slot string, matches long"),
    )
    return {r["slot"]: (r["player_ids"], r["basis"]) for r in got.collect()}


SLOTS = [(1, "S1", "singles", 1), (1, "D1", "doubles", 2), (1, "D2", "doubles", 3)]


def test_contested_slot_goes_to_the_better_pair_and_the_other_moves_on(spark):
    ranks = [(1, p, p) for p in range(1, 8)]
    pairs = [(1, 2, 3, "D1", 3), (1, 4, 5, "D1", 5), (1, 4, 5, "D2", 1), (1, 6, 7, "D2", 1)]
    got = _lineup(spark, SLOTS, ranks, [(1, 1, 4)], pairs)
    assert got == {"S1": ([1], "history"), "D1": ([2, 3], "history"), "D2": ([4, 5], "history")}


def test_leftovers_go_by_rank_and_a_court_may_stay_short(spark):
    got = _lineup(spark, SLOTS, [(1, p, p) for p in range(1, 5)], [], [(1, 1, 2, "D2", 1)])
    assert got == {"S1": ([1], "rating"), "D1": ([2, 3], "rating"), "D2": ([4], "rating")}
    got = _lineup(spark, SLOTS, [(1, 1, 0)], [], [])
    assert got == {"S1": ([1], "rating"), "D1": ([], "rating"), "D2": ([], "rating")}


def test_most_matches_win_across_slots(spark):
    ranks = [(1, p, p) for p in range(1, 8)]
    pairs = [(1, 2, 3, "D1", 2), (1, 3, 4, "D2", 9)]
    got = _lineup(spark, SLOTS, ranks, [(1, 1, 4)], pairs)
    assert got["D2"] == ([3, 4], "history") and got["D1"] == ([2, 5], "rating")


ELIGIBLE = "team_id int, event_id int, day date, player_id long, strength double, singles int, doubles_only boolean"
COURTS = [(9, "S1", "singles", 0), (9, "D1", "doubles", 1), (9, "D2", "doubles", 2)]


def _ways(spark, players, pairs=()):
    e = spark.createDataFrame([(1, 9, date(2026, 1, 1), *p) for p in players], ELIGIBLE)
    known = spark.createDataFrame(list(pairs), "team_id int, low_id long, high_id long, matches long")
    return lineup.day_scenarios(e, known, spark.createDataFrame(COURTS, "event_id int, slot string, discipline string, place int")).collect()


def _courts(spark, players, pairs=()):
    return {(s, [c[1] for c in COURTS].index(r["slot"]) + 1): (r["player_ids"], r["doubles_only_override"]) for r in _ways(spark, players, pairs) for s in r["strategies"].split(",")}


def test_sitting_and_unfilled_seats(spark):
    rows = _ways(spark, [(k, 10.0 - k, 0, False) for k in range(1, 5)], [(1, 2, 3, 6)])
    assert {(tuple(r["sitting"]), r["unfilled_seats"]) for r in rows} == {((4,), 2)}
    assert {(r["slot"], tuple(r["player_ids"]), r["filled"], r["shared_matches"]) for r in rows} == {("S1", (1,), True, None), ("D1", (2, 3), True, 6), ("D2", (), False, None)}


def test_doubles_only_is_avoided_at_singles_unless_nobody_else_is_there(spark):
    got = _courts(spark, [(1, 9.0, 5, True), (2, 8.0, 0, False), (3, None, 0, False), (4, 1.0, 2, True)])
    assert got["strength-first", 1] == ([2], False) and got["history-first", 1] == ([2], False)
    assert got["strength-first", 2][0] == [1, 4] and got["strength-first", 3][0] == []
    got = _courts(spark, [(1, 9.0, 5, True)])
    assert got["balanced", 1] == ([1], True) and got["balanced", 2][0] == []


def test_history_first_keeps_the_pair_that_played_most(spark):
    players = [(1, 9.0, 0, False), (2, 8.0, 7, False), (3, 7.0, 0, False), (4, 6.0, 0, False), (5, None, 0, False)]
    got = _courts(spark, players, [(1, 3, 5, 2), (1, 1, 4, 1)])
    assert got["history-first", 1][0] == [2] and got["history-first", 2][0] == [3, 5] and got["history-first", 3][0] == [1, 4]


def test_balanced_is_the_brute_force_minimum_and_equal_ways_merge(spark):
    values = {1: 9.0, 2: 7.5, 3: 7.0, 4: 4.0, 5: 1.0}
    rows = _ways(spark, [(p, v, 0, False) for p, v in values.items()])
    best = min(abs(sum(values[p] for p in a) - sum(values[p] for p in (2, 3, 4, 5) if p not in a)) for a in combinations((2, 3, 4, 5), 2))
    mine = [r["strength"] for r in rows if "balanced" in r["strategies"] and r["discipline"] == "doubles"]
    assert abs(mine[0] - mine[1]) == pytest.approx(best)
    assert {s for r in rows for s in r["strategies"].split(",")} == {"strength-first", "history-first", "balanced"}


def test_ladders_take_names_that_many_share_once_for_each_request(spark):
    """A name with 3000 ids asked for by 3000 requests makes no row for each of their pairs."""
    stored = spark.range(3000).selectExpr("id", "'same name' AS key", "concat('u', id) AS a", "1 AS team_id")
    wanted = spark.range(3000).selectExpr("id AS request", "'same name' AS key", "CASE WHEN id % 10 = 0 THEN concat('u', id) END AS a", "1 AS team_id")
    aliases, members = stored.select("key", "id").limit(0), stored.selectExpr("team_id", "id AS player_id")
    for got in (identity.player_ladder(wanted, stored, aliases, ["a"]), identity.roster_ladder(wanted, stored, aliases, members)):
        assert {(r["outcome"], r["n"]) for r in got.groupBy("outcome").agg(F.count("*").alias("n")).collect()} <= {("matched", 300), ("ambiguous", 2700), ("ambiguous", 3000)}
    one = identity._exact_id(wanted, stored.select("key", "id"), ["key"])
    assert one.where("exact = 2 AND id = 0").count() == 3000


def test_player_ladder_looks_for_near_names_only_where_nothing_decides(spark, monkeypatch):
    asked = {}
    near = identity._near_counts
    monkeypatch.setattr(identity, "_near_counts", lambda wanted, known: asked.update(keys=[r["key"] for r in wanted.where("key IS NOT NULL").select("key").collect()]) or near(wanted, known))
    stored = spark.createDataFrame([(1, "jo day", "x"), (2, "jo may", None), (3, "al", None)], "id long, key string, a string")
    wanted = spark.createDataFrame([(1, "jo ray", "x"), (2, "jo may", None), (3, "jo dax", None), (4, None, None)], "request long, key string, a string")
    got = {r["request"]: (r["tier"], r["outcome"], r["id"]) for r in identity.player_ladder(wanted, stored, stored.select("key", "id").limit(0), ["a"]).collect()}
    assert got == {1: ("source-id", "matched", 1), 2: ("name", "matched", 2), 3: ("near", "ambiguous", None), 4: ("none", "created", None)}
    assert asked["keys"] == ["jo dax"]
