"""The lineup queries against plain loops over the collected relations."""

from collections import Counter, defaultdict

import pytest

from rallyframe.operators import lineup, ratings
from rallyframe.plans import bind, catalog, lineups

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def known(spark):
    """Rosters, own rows, ranks and courts by team, as plain Python."""
    rosters, rows, ranks = defaultdict(set), defaultdict(list), {}
    for r in lineups._roster(spark, SF).collect():
        rosters[r["team_id"]].add(r["player_id"])
    sides = {r["match_id"]: (r["home_team_id"], r["visiting_team_id"]) for r in bind.team_matches(spark, SF).collect()}
    team_of = {p: t for t, ps in rosters.items() for p in ps}
    for r in bind.match_players(spark, SF).collect():
        t = team_of.get(r["player_id"])
        if t is not None and t in sides.get(r["match_id"], ()):
            rows[t].append((r["match_id"], r["slot"], r["discipline"], r["player_id"], r["side"], (r["side"] == lineups.HOME) == (sides[r["match_id"]][0] == t)))
    for r in lineups._ranks(spark, SF).collect():
        ranks[r["player_id"]] = r["rank"]
    return rosters, rows, ranks


def pairs_of(rows):
    """(low, high) -> Counter of slots, of players on one side of a court that is not singles."""
    stood = defaultdict(list)
    for match, slot, discipline, player, side, _ in rows:
        if discipline != "singles":
            stood[match, side, slot].append(player)
    out = defaultdict(Counter)
    for (_, _, slot), who in stood.items():
        for a in who:
            for b in who:
                if a < b:
                    out[a, b][slot] += 1
    return out


def plain_prediction(slots, roster, rows, rank):
    """(slot, players, basis, support), court by court."""
    singles = Counter(p for _, _, d, p, _, _ in rows if d == "singles")
    pairs = {k: v for k, v in pairs_of(rows).items() if sum(v.values()) >= 2}
    free, placed = set(roster), {}
    for slot, kind in slots:
        if kind == "singles" and free:
            best = sorted(free, key=lambda p: (-singles[p], rank[p], p))[0]
            placed[slot] = ([best], "history" if singles[best] else "rating", singles[best])
            free.remove(best)
    doubles = [s for s, k in slots if k != "singles"]
    strength = lambda k: (rank[k[0]] + rank[k[1]], -sum(pairs[k].values()), k)
    while True:
        proposals = []
        for slot in doubles:
            if slot in placed:
                continue
            wish = []
            for k in pairs:
                if not set(k) <= free:
                    continue
                open_ = [s for s in doubles if s not in placed and pairs[k][s] > 0]
                if open_ and sorted(open_, key=lambda s: (-pairs[k][s], doubles.index(s)))[0] == slot:
                    wish.append(k)
            if wish:
                proposals.append((slot, sorted(wish, key=strength)[0]))
        if not proposals:
            break
        slot, k = sorted(proposals, key=lambda x: (-sum(pairs[x[1]].values()), strength(x[1]), doubles.index(x[0])))[0]
        placed[slot] = (list(k), "history", sum(pairs[k].values()))
        free -= set(k)
    for k in sorted(pairs, key=strength):
        rest = [s for s in doubles if s not in placed]
        if rest and set(k) <= free:
            placed[rest[0]] = (list(k), "history", sum(pairs[k].values()))
            free -= set(k)
    for slot in doubles:
        if slot not in placed:
            who = sorted(free, key=lambda p: (rank[p], p))[:2]
            placed[slot] = (who, "rating", 0)
            free -= set(who)
    return {s: placed.get(s, ([], "rating", 0)) for s, _ in slots}, free


def test_predicted_lineups_equal_a_plain_loop(spark, known):
    rosters, rows, ranks = known
    slots = defaultdict(list)
    for r in lineups._plan_slots(spark, SF).orderBy("team_id", "place").collect():
        slots[r["team_id"]].append((r["slot"], r["discipline"]))
    got, left = defaultdict(dict), defaultdict(set)
    for r in lineups.predicted_lineup(spark, SF).collect():
        got[r["team_id"]][r["slot"]] = (r["player_ids"], r["basis"], r["support"])
        assert r["confidence"] == ("high" if r["support"] >= 5 else "medium" if r["support"] >= 2 else "low")
    for r in lineups.lineup_unplaced(spark, SF).collect():
        left[r["team_id"]].add(r["player_id"])
    able = {t for t in rosters if rows[t]}
    assert set(got) == able and able
    for t in able:
        want, free = plain_prediction(slots[t], rosters[t], rows[t], ranks)
        assert got[t] == want and left[t] == free, t


def test_day_scenarios_use_own_side_evidence_only(spark, known):
    rosters, rows, _ = known
    together = {}
    for t, rs in rows.items():
        for k, v in pairs_of([r for r in rs if r[5] and r[2] == "doubles"]).items():
            together[t, k] = sum(v.values())
    last = ratings.latest(bind.ratings(spark, SF))
    members = lineups._roster(spark, SF).select("team_id", "player_id")
    source = {r["team_id"]: r["source"] for r in ratings.choose_source(members, last, catalog.PRECEDENCE).collect()}
    value = {(r["player_id"], r["source"]): r["value"] for r in last.collect()}

    def strength(t, p):
        v = value.get((p, source[t]))
        return None if v is None else -v if source[t] in catalog.INVERTED else v

    free = defaultdict(set)
    for r in catalog._grid(spark, SF).where("status = 'available'").collect():
        free[r["team_id"], r["event_id"], r["day"]].add(r["player_id"])
    seen = 0
    for r in lineups.day_scenarios(spark, SF).collect():
        seen += 1
        t, who = r["team_id"], r["player_ids"]
        assert set(who) | set(r["sitting"]) <= free[t, r["event_id"], r["day"]]
        assert r["filled"] == (len(who) == (1 if r["discipline"] == "singles" else 2)) and (r["filled"] or not who)
        if len(who) == 2:
            assert r["shared_matches"] == together.get((t, tuple(sorted(who))), 0)
        rated = [strength(t, p) for p in who if strength(t, p) is not None]
        assert r["strength"] == (pytest.approx(sum(rated)) if rated else None)
    assert seen


def test_plan_status(spark):
    entries = spark.createDataFrame([(1, 5), (2, 5), (3, 6), (4, 7)], "team_id int, event_id int")
    roster = spark.createDataFrame([(1, 5, 10, "season"), (2, 5, 11, "season"), (3, 6, 12, "registered")], "team_id int, event_id int, player_id long, scope string")
    rows = spark.createDataFrame([(1, 100, "S1", "singles", 10, "h", True), (1, 101, "S1", "singles", 10, "h", None), (3, 102, "S1", "singles", 12, "h", False)], "team_id int, match_id long, slot string, discipline string, player_id long, side string, ours boolean")
    formats = spark.createDataFrame([(5, None), (6, 0), (7, 3)], "event_id int, courts long")
    got = {r["team_id"]: (r["status"], r["roster_size"], r["observed"], r["excluded_other_team"], r["slot_source"]) for r in lineup.plan_status(entries, roster, rows.where("ours IS NOT NULL"), rows, formats).collect()}
    assert got == {1: ("predicted", 1, 1, 1, "observed"), 2: ("no history", 1, 0, 0, "observed"), 3: ("empty format", 1, 1, 0, "event-format"), 4: ("no roster", 0, 0, 0, "event-format")}


def test_lineup_texts(spark):
    from rallyframe.operators import printed

    predicted = spark.createDataFrame(
        [(1, "S1", 1, "singles", [10], "history", 1, "low"), (1, "D12345", 2, "doubles", [11, 12], "rating", 0, "low"), (1, "D2", 3, "doubles", [13, 14], "history", 6, "high"), (1, "D3", 4, "doubles", [], "rating", 0, "low"), (2, "S1", 1, "singles", [20], "history", 3, "medium")],
        "team_id int, slot string, place long, discipline string, player_ids array<long>, basis string, support long, confidence string",
    )
    players = spark.createDataFrame([(10, "Jo"), (11, "Ann Lee"), (12, "Bo​X"), (13, "Cy"), (14, "Dee"), (15, "Eve"), (16, "Fay"), (20, "Z")], "player_id long, name string")
    status = spark.createDataFrame(
        [(1, 5, "predicted", 7, "registered", "event-format", 1, 2, "The Cup"), (2, 6, "predicted", 1, "season", "observed", 9, 0, "Other"), (3, 6, "no roster", 0, None, "observed", 0, 0, "Other")],
        "team_id int, event_id int, status string, roster_size long, roster_source string, slot_source string, observed long, excluded_other_team long, event_name string",
    )
    unplaced = spark.createDataFrame([(1, 16, 1), (1, 15, 4)], "team_id int, player_id long, court_matches long")
    ranks = spark.createDataFrame([(1, 10, "wtn_singles", 3.0), (1, 16, "wtn_singles", None), (1, 15, "wtn_singles", None), (2, 20, None, None)], "team_id int, player_id long, source string, value double")
    sizes = spark.createDataFrame([(1, 7, 9), (2, 0, 1)], "team_id int, registered long, season long")
    got = {r["team_id"]: r["text"].split("\n") for r in printed.lineup_texts(predicted, spark.createDataFrame([(1, "Aces"), (2, "Bees"), (3, "C")], "team_id int, team_name string"), players, status, unplaced, ranks, sizes).collect()}
    assert set(got) == {1, 2}
    assert got[1] == [
        "PREDICTED LINEUP — Aces", "  This is a guess, not a lineup card. Based on 1 observed court match across a roster of 7.", "",
        "  S1   Jo       conf: low     1 singles match", "  D12345 Ann Lee  conf: low     placed by rating — no shared history", "       Bo X", "  D2   Cy       conf: high    6 matches together", "       Dee", "  D3   (unfilled — roster exhausted)", "",
        "  not placed: Eve (4 court matches), Fay (1 court match)", "  ratings: ranked within WTN-S; unrated: Eve, Fay", '  courts: 4, from the format of event "The Cup"', '  roster: registered 7 for event "The Cup" (season roster: 9)', "  excluded: 2 court matches these players played for other teams",
    ]
    assert got[2][-3:] == ["  ratings: none on file — every tie fell through to a stable ordering, not to strength", "  courts: 1, from this team's observed match history (not the event format)", "  roster: season roster — no event named"]


def test_what_a_group_is_given_is_bounded_by_its_courts(spark):
    """A large roster: the choice is that of a plain loop over all, and few rows reach it."""
    import random

    rng = random.Random(12)
    n = 120
    slots = [("S1", "singles"), ("D1", "doubles"), ("D2", "doubles")]
    rank = {p: rng.randint(0, 60) for p in range(n)}
    rows, match = [], 0
    for _ in range(2500):
        match += 1
        slot = rng.choice(("S1", "D1", "D2", "D9"))
        for p in rng.sample(range(n), 1 if slot == "S1" else 2):
            rows.append((match, slot, "singles" if slot == "S1" else "doubles", p, "h", True))
    own = spark.createDataFrame([(1, *r) for r in rows], "team_id int, match_id long, slot string, discipline string, player_id long, side string, ours boolean")
    slot_rows = spark.createDataFrame([(1, s, k, i + 1) for i, (s, k) in enumerate(slots)], "team_id int, slot string, discipline string, place long")
    ranks = spark.createDataFrame([(1, p, r) for p, r in rank.items()], "team_id int, player_id long, rank long")
    singles, pairs = lineup.own_singles(own), lineup.own_pairs(own)
    want, _ = plain_prediction(slots, set(rank), rows, rank)
    got = {r["slot"]: (r["player_ids"], r["basis"], r["support"]) for r in lineup.predicted_lineup(slot_rows, ranks, singles, pairs).collect()}
    assert got == want
    kept_ranks, _, kept = lineup._reachable(slot_rows, ranks, singles, pairs)
    assert kept_ranks.count() < n and kept.count() < pairs.count() / 2
    assert len(lineup.first_pairs(pairs.groupBy("team_id", "low_id", "high_id").agg({"matches": "sum"}).withColumnRenamed("sum(matches)", "m"), ["team_id"], ["m"], 1).collect()) <= 3


def test_evidence_of_printed_lineups_is_made_once(spark, monkeypatch):
    from rallyframe.plans import texts

    calls = []
    for name in ("_roster", "_played", "_status", "_plan_slots", "_ranks"):
        made = getattr(lineups, name)
        monkeypatch.setattr(lineups, name, lambda *a, _f=made, _n=name: calls.append(_n) or _f(*a))
    texts.lineup_texts(spark, SF)
    assert sorted(calls) == ["_plan_slots", "_played", "_ranks", "_roster", "_status"]
