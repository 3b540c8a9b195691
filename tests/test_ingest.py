import pytest
from pyspark.sql import functions as F

from rallyframe.functions import phrases
from rallyframe.operators import ingest


@pytest.mark.parametrize("newest,oldest,want", [(2026, 2024, [2026, 2025, 2024]), (2026, 2026, [2026]), (2024, 2026, None), (2026, 2000, None)])
def test_seasons(spark, newest, oldest, want):
    assert spark.createDataFrame([(newest, oldest)], "a int, b int").select(ingest.seasons(F.col("a"), F.col("b"))).first()[0] == want


def test_exact_fixture_beats_lenient_and_several_are_ambiguous(spark):
    schema = "{} string, played_on string, home_team_id int, visiting_team_id int, scheduled_time string, site string"
    asked = [("a", "d", 1, 2, "9:00 am", "X!"), ("b", "d", 2, 1, None, None), ("c", "d", 1, 2, "8:00", None), ("n", "e", 1, 2, "9:00 am", None), ("o", "d", 1, 2, "9:00 AM", "y"), ("p", "d", 3, 4, "9:00 am", None)]
    stored = [("m1", "d", 2, 1, "09:00 A.M.", "x"), ("m2", "d", 1, 2, None, "y"), ("m3", "d", 1, 2, None, None), ("m4", "d", 4, 3, "9:00 am", "z")]
    got = ingest.fixture_candidates(spark.createDataFrame(asked, schema.format("request")), spark.createDataFrame(stored, schema.format("match_id"))).collect()
    assert {r["request"]: (r["outcome"], r["match_id"]) for r in got} == {"a": ("matched", "m1"), "b": ("matched", "m3"), "c": ("ambiguous", None), "n": ("new", None), "o": ("ambiguous", None), "p": ("matched", "m4")}


def test_dispositions(spark):
    chains = {
        "retryable": [[("FetchError", 408.0, None, None)], [("FetchError", 425.0, None, None)], [("FetchError", 599.0, None, None)], [("E", None, "AbortError", None)], [("E", None, None, "x"), ("E", None, None, "SQLITE_BUSY_RECOVERY")], [("E", None, None, "SQLITE_LOCKED")]],
        "permanent": [[("FetchError", 200.0, None, None)], [("FetchError", 302.0, None, None)], [("FetchError", 600.0, None, None)], [("E", None, None, None), ("AmbiguousIdentityError", None, None, None)], [("ParseError", None, "TimeoutError", None)]],
        "unclassified": [[], [("FetchError", None, None, "ECONNRESET")], [("FetchError", float("nan"), None, None)], [("FetchError", 500.5, None, None)], [("E", None, None, "ENOTFOUND")], [("E", None, None, "SQLITE_LOCKED_VTAB")], [("E", None, None, None)] * 16 + [("E", None, None, "EPIPE")]],
    }
    rows = [(want, c) for want, cs in chains.items() for c in cs] + [("unclassified", None)]
    df = spark.createDataFrame(rows, "want string, c array<struct<kind: string, status: double, name: string, code: string>>")
    assert df.withColumn("got", ingest.disposition(F.col("c"))).where("got <> want").collect() == []


def test_gender_is_no_opinion_unless_it_is_one_of_two_words(spark):
    said = {"male": "Male", "FEMALE ": "Female", "Competition category: Female": "Female", "M": None, "women": None, "": None, None: None, "Male Female": None}
    df = spark.createDataFrame([(t,) for t in said], "t string")
    assert {r["t"]: r["g"] for r in df.select("t", phrases.gender(F.col("t")).alias("g")).collect()} == said


def test_phrases(spark):
    df = spark.createDataFrame([('a​"b\n', 3, 1, 2)], "t string, w int, l int, u int")
    got = df.select(phrases.record(F.col("w"), F.col("l"), F.col("u")), phrases.summary(x=F.col("t"), y=F.lit(None)), phrases.escape_html(F.lit("<a&'>"))).first()
    assert tuple(got) == ("3-1 (2 undecided)", 'x="a \\"b "', "&lt;a&amp;&#39;&gt;")


def test_numbers_are_rounded_by_their_exact_value(spark):
    cases = {33.05: "33.0", 3.25: "3.3", 3.35: "3.4", 0.05: "0.1", 4.0: "4.0", -3.25: "-3.3", 1e6 + 0.25: "1000000.3", 0.0: "0.0"}
    df = spark.createDataFrame([(v,) for v in cases], "v double")
    assert {r["v"]: r["t"] for r in df.select("v", phrases.fixed(F.col("v"), 1).alias("t")).collect()} == cases
    assert df.select(phrases.rating_value(F.lit(22.505), F.lit("wtn_singles"))).first()[0] == "22.50"
    assert df.select(phrases.rating_value(F.lit(4.0), F.lit("ntrp"))).first()[0] == "4.0"


def test_membership_texts(spark):
    rows = [
        ("a", [(None, None, False)]), ("b", [(None, None, True)]), ("c", [(None, None, True), (1, "Cup", False), (2, " ", True)]), ("d", [(1, "Cup", False)]),
    ]
    df = spark.createDataFrame(rows, "team string, rows array<struct<event_id: int, event_name: string, retired: boolean>>")
    got = {r["team"]: r["t"] for r in df.select("team", phrases.membership_text(F.col("team"), F.col("rows")).alias("t")).collect()}
    assert got == {"a": "a", "b": "b (former)", "c": 'c (season roster — former; registered for "Cup"; registered for event #2 — former)', "d": 'd (registered for "Cup")'}
