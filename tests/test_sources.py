import json

import pytest
from pyspark.sql import functions as F

from rallyframe.functions import markup
from rallyframe.operators import pull
from rallyframe.plans import catalog, dossier
from rallyframe.sources import payloads, renderings, tables
from rallyframe.streaming import observations

SMALL = "/root/testdata/sf0.001"
HEAD = "<tr>" + "".join(f"<th>{h}</th>" for h in ("Match Date", "League", "Team", "Court", "Partner", "Opponent(s)", "W/L", "Result", "Match", "Rating")) + "</tr>"


def page(*rows):
    return "<table><tr><td>other</td></tr></table><TABLE class='x'>" + HEAD + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in rows) + "</TABLE>"


LINK = "<a href='/matchresults.aspx?year=2026&mid=77'>6-4</a><br>3-6<br>1-0"


def test_match_history(spark):
    good = ("6/1/2026", "Adult 40+<br>3.5", "Net&nbsp;Gains<br>Sec", "D2", "Jo Day<br>(3.4)", "A B<br>(3.1)<br>C D<br>(3.2)", "W", LINK, "3.51", "(3.40)")
    default = ("6/2/2026", "Adult", "T", "S1", "", "Default", "W", LINK, "S", "-----")
    bad = ("6/2/2026", "Adult", "T", "R16", "", "A B", "W", LINK, "", "")
    docs = spark.createDataFrame([("u1", page(good, default, bad)), ("u2", "<p>No table</p>"), ("u3", page())], "url string, html string")
    got = {(r["url"], r["place"]): r for r in tables.match_history(docs).collect()}
    r = got["u1", 0]
    assert r["error"] is None and (r["played_on"], r["league_context"], r["team_name"], r["discipline"], r["partner"], r["opponents"], r["source_match_id"]) == ("2026-06-01", "Adult 40+ 3.5", "Net Gains", "doubles", "Jo Day", ["A B", "C D"], "77")
    assert [tuple(x) for x in r["sets"]] == [(6, 4, False), (3, 6, False), (1, 0, True)] and (r["match_rating"], r["resulting_rating"]) == (3.51, 3.4)
    d = got["u1", 1]
    assert d["error"] is None and d["defaulted"] and d["self_rated"] and d["resulting_rating"] is None
    assert got["u1", 2]["error"] == "unknown slot" and got["u2", None]["error"] == "table not found" and len(got) == 4


def test_scorecards(spark):
    def court(**kw):
        return {"slot": " d1 ", "discipline": "doubles", "homePlayers": ["a", "b"], "visitingPlayers": ["c", "d"], "winnerSide": "home"} | kw

    def card(*courts, **kw):
        return json.dumps({"playedOn": "2026-02-28", "homeTeam": "h", "visitingTeam": "v", "courts": courts} | kw)

    rows = [card(court()), card(court(), court(slot="D1")), card(court(defaulted=True)), card(court(discipline="singles", slot="S1")), card(court(), playedOn="2026-02-30"), "{", card()]
    got = [(r["payload"], r["refusals"]) for r in payloads.scorecards(spark.createDataFrame([(x,) for x in rows], "payload string")).collect()]
    said = {k: sorted({y for p, x in got if p == rows[k] for y in x}) for k in range(len(rows))}
    assert said[0] == [] and said[1] == ["slot given twice"] and said[2] == said[3] == ["wrong number of home players", "wrong number of visiting players"] and said[4] == ["not a day"]
    assert "no courts" in said[5] and said[6] == ["no courts"]


def test_session_credentials(spark):
    html = "<input type=hidden name='__VIEWSTATE' value='x'><noscript><input name=q value='" + "a" * 64 + "'></noscript><meta http-equiv='origin-trial' content='" + "b" * 70 + "'><input type='submit' name='_token' value='Go'><input name='q' value='plain'>"
    got = markup.session_credentials(spark.createDataFrame([(1, html)], "page_id long, html string")).collect()
    assert sorted(r["signal"] for r in got) == ["name", "shape"]


def test_directory_names_do_not_collide(spark):
    names = [(1, "X"), (2, "X 3"), (3, "X!"), (4, "Net Gains!"), (5, "net gains"), (6, "!!"), (7, "net-gains-5"), (8, "net gains"), (9, "y 1"), (10, "y 2")]
    got = dossier.directory_names(spark.createDataFrame(names, "team_id int, team_name string")).orderBy("team_id").collect()
    assert [r["directory"] for r in got] == ["x", "x-3", "x-3-2", "net-gains", "net-gains-5", "team-6", "net-gains-5-7", "net-gains-8", "y-1", "y-2"]


def _drain(spark, df, name, mode):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return spark.sql(f"SELECT * FROM {name}").collect()


def test_snapshot_trust(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [(1, "u", "2026-01-01 00:00:00"), (1, "u", "2026-01-02 00:00:00"), (1, "v", "2026-01-03 00:00:00"), (1, "v", "2026-01-03 00:00:00"), (1, "v", "2026-01-04 00:00:00")]
    spark.createDataFrame(rows, "team_id long, url string, t string").select("team_id", "url", F.to_timestamp("t").alias("observed_at")).coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("team_id long, url string, observed_at timestamp").parquet(src)
    got = sorted((r["observed_at"], r["verdict"]) for r in _drain(spark, observations.snapshot_verdicts(stream), "verdicts", "append"))
    assert [v for _, v in got] == ["baseline", "trusted", "moved", "stale", "trusted"]


def test_merge_into_is_idempotent_and_writes_only_its_buckets(spark, tmp_path):
    path = str(tmp_path / "t")
    merge = observations.merge_into(path, ["k"], ["i"], buckets=8)
    a = spark.createDataFrame([(k, 1, "a") for k in range(40)], "k int, i int, v string")
    b = spark.createDataFrame([(1, 2, "b"), (99, 1, "c")], a.schema)
    merge(a, 0)
    before = {str(f): f.stat().st_mtime_ns for f in (tmp_path / "t").rglob("*.parquet")}
    for _ in range(2):
        merge(b, 1)
        got = {r["k"]: r["v"] for r in spark.read.parquet(path).collect()}
        assert got == {**{k: "a" for k in range(40)}, 1: "b", 99: "c"}
    after = {str(f): f.stat().st_mtime_ns for f in (tmp_path / "t").rglob("*.parquet")}
    kept = [f for f in before if after.get(f) == before[f]]
    assert len(before) - len(kept) <= 2  # the buckets of two keys
    merge(b.where("false"), 2)
    spark.createDataFrame([(2, 5, "z")], a.schema).write.parquet(str(tmp_path / "in"))
    q = spark.readStream.schema(a.schema).parquet(str(tmp_path / "in"))
    run = q.writeStream.foreachBatch(merge).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert {r["k"]: r["v"] for r in spark.read.parquet(path).collect()}[2] == "z"


def test_pulled_courts(spark):
    doubles = ("6/1/2026", "Adult 40+", "Net Gains", "D2", "Jo Day<br>(3.4)", "A B<br>(3.1)<br>C D<br>(3.2)", "L", LINK, "3.51", "(3.40)")
    default = ("6/2/2026", "Adult", "T", "S1", "", "Default", "W", "<a href='?mid=78'>x</a>", "S", "-----")
    docs = spark.createDataFrame([("u1", page(doubles, default)), ("u2", page(doubles, (*doubles[:3], "R9", *doubles[4:])))], "url string, html string")
    history = tables.match_history(docs)
    got = sorted(tuple(r) for r in pull.courts(history).select("url", "source_match_id", "slot", "winner_side", "score", F.col("played_on").cast("string")).collect())
    assert got == [("u1", "77", "D2", "visiting", "6-4 3-6 1-0", "2026-06-01"), ("u1", "78", "S1", "home", None, "2026-06-02")]
    subjects = spark.createDataFrame([("u1", "Me"), ("u2", "You")], "url string, name string")
    got = sorted((r["source_match_id"], r["side"], r["name"]) for r in pull.participants(history, subjects).collect())
    assert got == [("77", "home", "Jo Day"), ("77", "home", "Me"), ("77", "visiting", "A B"), ("77", "visiting", "C D"), ("78", "home", "Me")]
    assert [tuple(r) for r in pull.refused_pages(history).collect()] == [("u2", ["unknown slot"])]


def test_guarded_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "a", 2.0)], "k int, v string, extra double").write.parquet(path)
    assert tables.scan(spark, path, "k int, v string").columns == ["k", "v"]
    for wanted in ("k int, missing string", "k string"):
        with pytest.raises(ValueError, match="missing|int"):
            tables.scan(spark, path, wanted)
    with pytest.raises(ValueError, match="does not exist"):
        tables.scan(spark, str(tmp_path / "nowhere"), "k int")


def test_pages_are_archived_before_they_are_parsed(spark, tmp_path):
    pages = spark.createDataFrame([("u1", "<p>é</p>", 200), ("u2", None, 404)], "url string, html string, http_status int")
    kept = tables.archived(pages, str(tmp_path / "bronze"), "2026-01-02 03:04:05")
    assert {(r["url"], r["bytes"], r["http_status"], str(r["fetched_at"])) for r in kept.collect()} == {("u1", 9, 200, "2026-01-02 03:04:05"), ("u2", 0, 404, "2026-01-02 03:04:05")}
    with pytest.raises(Exception, match="already exists"):
        tables.archived(pages, str(tmp_path / "bronze"), "2026-01-02 03:04:05")


def test_images_by_name_size_and_first_bytes(spark, tmp_path):
    for name, data in {"a.png": b"\x89PNG\r\n\x1a\nxx", "b.jpg": b"\xff\xd8\xff\xe0", "c.png": b"GIF89a..", "d.gif": b"\x89PNG\r\n\x1a\n", "e.JPEG": b"\xff\xd8\xff\xe0" + b"x" * 100}.items():
        (tmp_path / name).write_bytes(data)
    got = {r["path"].rpartition("/")[2] for r in payloads.images(spark, str(tmp_path), most_bytes=50).collect()}
    assert got == {"a.png", "b.jpg"}


def _parses(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("(?is)<table")


def test_pages_are_read_once(spark):
    pages = spark.createDataFrame([("a", page(("6/1/2026", "L", "T", "S1", "", "A", "W", LINK, "3.5", "3.4"))), ("b", "<p>none</p>"), ("c", None)], "url string, html string")
    rows = tables.match_history(pages)
    assert _parses(rows) == 1 and _parses(rows.where("error IS NOT NULL")) == 1
    assert sorted((r["url"], r["place"], r["error"]) for r in rows.collect()) == [("a", 0, None), ("b", None, "table not found"), ("c", None, "table not found")]


def test_refusals_read_the_pages_once(spark):
    pages = spark.createDataFrame([("a", page(("x", "L", "T", "S1", "", "A", "W", LINK, "3.5", "3.4"))), ("b", "<p>none</p>"), ("c", page())], "url string, html string")
    refused = pull.refused_pages(tables.match_history(pages))
    assert _parses(refused) == 1 and {r["url"]: r["errors"] for r in refused.collect()} == {"a": ["unparseable date"], "b": ["table not found"]}
    assert _parses(catalog.QUERIES["pulled_courts"](spark, "/root/testdata/sf0.001")) == 0  # the sound rows were written once


def test_both_renderings_are_read_once_and_not_shuffled(spark):
    block = "<div class='container496'><table><tr><th>6/1/2026</th><th>S1</th></tr></table><a href='/teamprofile.aspx?t=1'>T</a><a href='/teamprofile.aspx?t=2'>R<br>Sec</a><a href='/matchresults.aspx?mid=77'>x</a></div>"
    row = ("6/1/2026", "L", "T", "S1", "", "A", "W", LINK, "3.5", "3.4")
    pages = spark.createDataFrame([("a", page(row) + block), ("b", page(row)), ("c", block + block), ("d", "")], "url string, html string")
    agreed = renderings.agreed_history(pages)
    plan = agreed._jdf.queryExecution().executedPlan().toString()
    assert _parses(agreed) == 1 and "Exchange" not in plan and "Join" not in plan
    got = {r["url"]: (r["place"], r["opponent_team"], r["error"]) for r in agreed.collect()}
    assert got == {"a": (0, "R", None), "b": (None, None, "table has 1 matches, mobile blocks are 0"), "c": (None, None, "table has 0 matches, mobile blocks are 2")}


def _sound_rows(spark):
    """url and id of each row of all histories that breaks no rule, and whether it is a default."""
    return {(r["url"], r["source_match_id"]): r["defaulted"] for r in catalog.QUERIES["match_history_rows"](spark, SMALL).where("error IS NULL").collect()}


def test_pulled_courts_has_every_sound_row(spark):
    sound = _sound_rows(spark)
    got = catalog.QUERIES["pulled_courts"](spark, SMALL).collect()
    assert sorted((r["url"], r["source_match_id"]) for r in got) == sorted(sound) and {k[1][-1] for k in sound} == set("0123456789")


def test_pulled_participants_has_everyone_of_every_sound_row(spark):
    sound = _sound_rows(spark)
    seats = {}
    for r in catalog.QUERIES["pulled_participants"](spark, SMALL).collect():
        seats.setdefault((r["url"], r["source_match_id"]), []).append((r["slot"][0], r["side"]))
    assert set(seats) == set(sound)
    for row, there in seats.items():
        slot = there[0][0]
        others = [] if sound[row] else ["visiting"] if slot == "S" else ["home", "visiting", "visiting"]
        assert sorted(side for _, side in there) == sorted(["home", *others])
