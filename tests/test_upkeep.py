from datetime import date

from pyspark.sql import functions as F

from rallyframe.functions import keys
from rallyframe.operators import upkeep
from rallyframe.sources import renderings, widgets


def rows(df, key, *columns):
    return {r[key]: tuple(r[c] for c in columns) for r in df.collect()}


def test_notes(spark):
    members = spark.createDataFrame([(1, 10), (1, 11), (2, 12), (2, 10)], "team_id int, player_id long")
    notes = spark.createDataFrame([(1, 10, None, "x", 5), (2, 10, 10, "x", 5), (3, 10, 11, "x", 6), (4, 99, None, "x", 7), (5, 10, 99, "x", 8), (6, 10, None, " \t", 9), (7, 10, None, "y", 5), (8, 10, 12, "z", 1)], "note_id long, player_id long, pair_id long, note string, created_at int")
    said = rows(upkeep.note_outcomes(notes, members), "note_id", "outcome")
    assert [said[k][0] for k in range(1, 9)] == ["recorded", "paired with oneself", "recorded", "not on the roster", "pair not on the roster", "empty", "recorded", "recorded"]
    seen = {(r["team_id"], r["kind"], r["place"]): r["note_id"] for r in upkeep.visible_notes(notes.where("note_id IN (1, 3, 4, 5, 7, 8)"), members).collect()}
    assert seen == {(1, "player", 1): 7, (1, "player", 2): 1, (2, "player", 1): 7, (2, "player", 2): 1, (1, "pairing", 1): 3, (2, "pairing", 1): 8}


def test_aliases_and_declared_names(spark):
    names = spark.createDataFrame([("jo day", 1), ("al roe", 2), ("sam", 3)], "key string, id long")
    aliases = spark.createDataFrame([("joey", 1), ("sam", 4)], "key string, id long")
    asked = spark.createDataFrame([(1, 1, "Joey"), (2, 1, "AL ROE"), (3, 1, "Jo​ Day"), (4, 2, " "), (5, 2, "Alf")], "request int, id long, alias string")
    assert rows(upkeep.alias_outcomes(asked, names, aliases), "request", "outcome") == {1: ("already recorded",), 2: ("held by another",), 3: ("recorded",), 4: ("empty",), 5: ("recorded",)}
    told = [(1, "jo dai", None), (2, "nobody near", None), (3, "jo day", None), (4, "sam", None), (5, "jo day", "Jo Day"), (6, "al roes", "al roez"), (7, "al roe", "al roex"), (8, "jo dai", "far away"), (9, " ", None)]
    out = upkeep.distinct_outcomes(spark.createDataFrame(told, "request int, name string, near_name string"), names.union(aliases), names.select("key"))
    assert rows(out, "request", "outcome", "pair_created") == {
        1: ("created", False), 2: ("not ambiguous", False), 3: ("already on file", False), 4: ("already ambiguous", False), 5: ("same name", False), 6: ("created", True), 7: ("already on file", True), 8: ("not near", False), 9: ("empty", False),
    }


def test_repairs_and_windows(spark):
    d = lambda k: date(2026, 8, k)
    r = spark.createDataFrame([(1, "w", d(10)), (1, "w", d(5)), (2, "w", d(10)), (3, "x", d(10)), (4, None, d(10))], "player_id int, source string, observed_on date")
    got = upkeep.redated(r, ["player_id", "source"], F.lit(d(10)), F.lit(d(5)), F.col("source") == "w")
    assert sorted(map(tuple, got.collect()), key=str) == [(1, "w", d(5)), (2, "w", d(5)), (3, "x", d(10)), (4, None, d(10))]
    teams = spark.createDataFrame([("a", 1, True), ("a", 2, None), ("b", 3, True), ("c", 4, True)], "scope string, team_id int, is_home boolean")
    asked = spark.createDataFrame([("a", 2), ("b", 9)], "scope string, team_id int")
    assert rows(upkeep.designated(teams, asked), "team_id", "is_home") == {1: (None,), 2: (True,), 3: (True,), 4: (True,)}
    e = spark.createDataFrame([(1, date(2024, 2, 29)), (2, None)], "event_id int, starts_on date")
    w = upkeep.windows(e, F.lit(d(1)))
    assert rows(w, "event_id", "anchored_to", "since", "label") == {1: ("event", date(2023, 2, 28), "12mo to 2024-02-29"), 2: ("today", date(2025, 8, 1), "12mo to 2026-08-01")}
    assert upkeep.unverified_windows(w).isEmpty() and upkeep.unverified_windows(w.withColumn("label", F.lit("12mo"))).count() == 2
    texts = {"2026": True, "0999": False, "20267": False, " 2026": False, None: False, "２０２６": False}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert rows(df.select("t", keys.is_season(F.col("t")).alias("s")), "t", "s") == {k: (v,) for k, v in texts.items()}


HEAD = "<tr>" + "".join(f"<th>{h}</th>" for h in ("Match Date", "League", "Team", "Court", "Partner", "Opponent(s)", "W/L", "Result", "Match", "Rating")) + "</tr>"


def both(desktop, mobile):
    lines = "".join("<tr>" + "".join(f"<td>{c}</td>" for c in (day, league, "Net", slot, "", "Al<br>(3.5)", "W", f"<a href='/matchresults.aspx?mid={mid}'>6-4<br>6-3</a>", "S", "3.5")) + "</tr>" for day, league, slot, mid in desktop)
    return f"<div class='large'><table>{HEAD}{lines}</table></div><div class='small'>{''.join(mobile)}</div>"


def block(day, slot, mid, teams=2):
    links = "".join(f"<a href=\"/teamprofile.aspx?t={k}\">Team {k}<br>Sec</a>" for k in range(teams))
    return f"<div class='a container496'><table><tr><th>{day}</th><th>{slot}</th></tr></table>{links}<a href='/matchresults.aspx?x=1&amp;mid={mid}'>r</a></div>"


def test_renderings_must_agree(spark):
    day, court = "6/1/2026", ("6/1/2026", "Adult", "S1", "7")
    entry = "<div class='container496'><table><tr><td>6/1/2026</td><td>D2</td><td>Tournament<br>Open</td></tr></table></div>"
    pages = {
        "good": both([court, (day, "Tournament", "D2", "")], [block(day, "S1", 7), entry]), "count": both([court], []), "day": both([court], [block("6/2/2026", "S1", 7)]), "slot": both([court], [block(day, "S2", 7)]), "id": both([court], [block(day, "S1", 8)]),
        "teams": both([court], [block(day, "S1", 7, 1)]), "entry": both([(day, "Tournament", "D1", "")], [entry]), "noentry": both([(day, "Tournament", "D1", "")], [block(day, "D1", 7)]),
    }
    df = spark.createDataFrame(list(pages.items()), "url string, html string")
    got = {r["url"]: (r["place"], r["opponent_team"], r["opponent_section"], r["error"]) for r in renderings.agreed_history(df).collect()}
    assert got["good"] == (0, "Team 1", "Sec", None)
    assert {u: g[3] for u, g in got.items() if u != "good"} == {
        "count": "table has 1 matches, mobile blocks are 0", "day": "renderings disagree on the day", "slot": "renderings disagree on the slot", "id": "renderings disagree on the match", "teams": "block does not name two teams", "entry": "renderings disagree on the slot", "noentry": "tournament block names teams",
    }


def test_captured_profile(spark):
    def page(context, level="", name="Jo Day"):
        return f"<x data-element-name='fullName'><div class='readonly-text__text'><h3>{name}</h3></div></x><x data-element-name='nameGenderAddress'><div>{context}</div></x>{level}<x data-element-name='other'><h3>Not me</h3></x>"

    level = "<x data-element-name='ntrpSummary'><b class='readonly-text__text'>{}</b><i class='readonly-text__subtext'>12/31/2025 Year End</i></x>"
    docs = {
        "p?uaid=5": page("<p>Male | Tulsa, OK | Section: Mid</p>", level.format("4.5 c")), "p#uaid=6": page("<p>Section: Mid</p><p>Competition Category: Female | District: Ok</p>", level.format("5.0")), "p": page("<p>Male</p>"), "p?uaid=7": page("<p>Section: Mid</p>"), "p?uaid=8": page("<p>Male</p>", level.format("4.5 X")),
        "p?uaid=9": page("<p>Male</p>", level.format("none")), "q?uaid=1": page("<p>Male</p>", name=" "), "r?uaid=2": "<p>",
    }
    got = {r["url"]: r for r in widgets.captured_profile(spark.createDataFrame(list(docs.items()), "url string, html string")).collect()}
    r = got["p?uaid=5"]
    assert (r["name"], r["uaid"], r["gender"], r["location"], r["section"], r["district"], tuple(r["ntrp"]), r["error"]) == ("Jo Day", "5", "Male", "Tulsa, OK", "Mid", None, (4.5, "C", "2025-12-31"), None)
    r = got["p#uaid=6"]
    assert (r["gender"], r["location"], r["district"], tuple(r["ntrp"]), r["error"]) == ("Female", None, "Ok", (5.0, None, "2025-12-31"), None)
    assert {u: got[u]["error"] for u in docs if got[u]["error"]} == {"p": "no uaid", "p?uaid=7": "no identity line", "p?uaid=8": "unknown rating type", "q?uaid=1": "no name", "r?uaid=2": "no name"}
    assert got["p?uaid=9"]["ntrp"] is None
