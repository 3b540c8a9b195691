"""As-of joins, frames, grouping sets, quantile sketches, event-time windows, the paced source and ordered lists."""

import datetime
import math
import random

import pytest

from rallyframe.operators import timeline
from rallyframe.sources import lists
from rallyframe.sources.store import shared_folder
from rallyframe.streaming import paced, windows

DAY = datetime.date(2026, 3, 1)


def day(k):
    return DAY + datetime.timedelta(k)


def test_as_of_equals_a_search_for_each_row(spark):
    rng = random.Random(3)
    right = [(rng.choice((1, 1, 1, 2, None)), day(rng.randint(0, 300)) if rng.random() < 0.95 else None, k, rng.choice((1.5, 2.5, None))) for k in range(200)]
    left = [(k, rng.choice((1, 1, 2, 3, None)), day(rng.randint(-20, 320)) if rng.random() < 0.95 else None) for k in range(150)] + [(7, 1, day(50))] * 3
    got = timeline.as_of(spark.createDataFrame(left, "m long, p int, d date"), spark.createDataFrame(right, "p int, o date, id long, v double"), "p", "d", "o", ["id"], ["v", "id"], bucket_days=9)
    want = []
    for m, p, d in left:
        known = [(o, i, v) for q, o, i, v in right if p is not None and q == p and o is not None and d is not None and o <= d]
        last = max(known, key=lambda x: x[:2]) if known else (None, None, None)
        want.append((m, p, d, last[2], last[1]))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert timeline.as_of(spark.createDataFrame([], "m long, p int, d date"), spark.createDataFrame(right, "p int, o date, id long, v double"), "p", "d", "o", ["id"], ["v"]).count() == 0


def test_form_counts_the_days_before(spark):
    rng = random.Random(4)
    rows = [(rng.randint(1, 3), day(rng.randint(0, 250)) if rng.random() < 0.9 else None, rng.choice(("O", "F", None)), rng.choice("OF")) for _ in range(300)]
    got = timeline.form(spark.createDataFrame(rows, "player_id long, played_on date, winner_side string, side string"), 90)
    want = set()
    for p, d in {(r[0], r[1]) for r in rows if r[1]}:
        span = [r for r in rows if r[0] == p and r[1] and d - datetime.timedelta(90) <= r[1] < d]
        today = [r for r in rows if r[0] == p and r[1] == d]
        earlier = [r[1] for r in rows if r[0] == p and r[1] and r[1] < d]
        want.add((p, d, len(today), sum(r[2] == r[3] for r in today), len(span), sum(r[2] == r[3] for r in span), (d - max(earlier)).days if earlier else None))
    assert set(map(tuple, got.collect())) == want


def test_sketches_keep_their_error_and_merge(spark):
    rng = random.Random(5)
    rows = [(g, part, v) for g in (1, 2) for part in range(4) for v in (round(rng.choice((1, -1, 1)) * rng.lognormvariate(2, 3), rng.choice((0, 4))) for _ in range(700))] + [(1, 0, None), (2, 1, float("nan")), (3, 0, 0.0)]
    df = spark.createDataFrame(rows, "g int, part int, v double")
    qs = [0.0, 0.1, 0.5, 0.77, 0.99, 1.0]
    for error in (0.01, 0.2):
        whole = timeline.quantile_sketch(df, ["g"], "v", error)
        merged = timeline.merge_sketches(timeline.quantile_sketch(df, ["g", "part"], "v", error), ["g"])
        assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, merged.collect()))
        got = {(r["g"], r["q"]): (r["n"], r["value"]) for r in timeline.sketch_quantiles(merged, ["g"], qs, error).collect()}
        assert len(got) == 3 * len(qs)
        for g in (1, 2, 3):
            values = sorted(v for h, _, v in rows if h == g and v is not None and not math.isnan(v))
            for q in qs:
                n, said = got[g, q]
                true = values[max(math.ceil(q * len(values)), 1) - 1]
                assert n == len(values) and abs(said - true) <= error * abs(true) + 1e-12


def stream_of(spark, batches, run, name):
    """Each batch as one file and one trigger; rows of the query's output."""
    path = shared_folder(spark, "stream").removeprefix("file://")
    for k, rows in enumerate(batches):
        spark.createDataFrame([(datetime.datetime(2026, 3, 1) + datetime.timedelta(minutes=m), u, v) for m, u, v in rows], "ts timestamp, u string, value double").coalesce(1).write.mode("append").parquet(f"{path}/b{k}")
    events = spark.readStream.schema("ts timestamp, u string, value double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)
    q = run(events).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    start = lambda t: int((t - datetime.datetime(2026, 3, 1)).total_seconds() // 60)
    return sorted((start(r["begins"]), start(r["ends"]), r["u"], r["n"]) for r in spark.table(name).collect())


# minutes; the mark is ten minutes behind the latest event of the triggers before, and drops rows from the next trigger on
LATE = [[(5, "a", 1.0), (12, "a", 2.0)], [(25, "a", 3.0)], [(24, "c", 3.0)], [(16, "a", 4.0), (8, "a", 5.0)], [(70, "b", 6.0)], [(200, "b", 7.0)]]


def test_rows_beyond_the_watermark_are_dropped_and_late_ones_count(spark):
    got = stream_of(spark, LATE, lambda e: windows.tumbling(e, "10 minutes", ["u"], late="10 minutes"), "tumbled")
    # 16 is late but its window is open; 8 belongs to a window that closed when the mark reached 15
    assert [r for r in got if r[0] < 100] == [(0, 10, "a", 1), (10, 20, "a", 2), (20, 30, "a", 1), (20, 30, "c", 1), (70, 80, "b", 1)]
    slid = stream_of(spark, LATE, lambda e: windows.sliding(e, "10 minutes", "5 minutes", ["u"], late="10 minutes"), "slid")
    assert (0, 10, "a", 1) in slid and (15, 25, "a", 1) in slid and (10, 20, "a", 2) in slid and (5, 15, "a", 2) in slid
    met = stream_of(spark, LATE, lambda e: windows.sessions(e, "10 minutes", ["u"], late="10 minutes"), "met")
    assert [r for r in met if r[0] < 100] == [(5, 35, "a", 5), (24, 34, "c", 1), (70, 80, "b", 1)]
    batch = spark.createDataFrame([(datetime.datetime(2026, 3, 1, 0, m), u, v) for rows in LATE[:4] for m, u, v in rows], "ts timestamp, u string, value double")
    assert sum(r["n"] for r in windows.tumbling(batch, "10 minutes", ["u"]).collect()) == 6


def test_the_paced_source_keeps_its_slots_and_replays(spark):
    path = shared_folder(spark, "requests")
    spark.createDataFrame([(k, f"u{k}") for k in range(11)], "seq long, url string").repartition(3).write.parquet(path)
    out, check = shared_folder(spark, "out"), shared_folder(spark, "check")

    def run(stop):
        sizes, seen = [], []

        def taken(batch, epoch):
            rows = sorted(r["seq"] for r in batch.collect())
            if stop is not None and epoch == stop:
                raise RuntimeError("stopped before the commit")
            sizes.append((epoch, rows))
            seen.extend(rows)

        q = paced.paced(spark, path, interval_ms=6100, spacing_ms=1500).writeStream.foreachBatch(taken).option("checkpointLocation", check).trigger(processingTime="300 milliseconds").start()
        try:
            for _ in range(150):
                if q.exception() is not None or sum(len(r) for _, r in sizes) >= 11 - 4 * (sizes[0][0] if sizes else 0):
                    break
                q.awaitTermination(0.3)
        except Exception:
            pass
        q.stop()
        return sizes

    first = run(1)
    assert first == [(0, [0, 1, 2, 3])]
    second = run(None)
    assert second[0] == (1, [4, 5, 6, 7]) and sum((r for _, r in second), []) == list(range(4, 11)) and all(len(r) <= 4 for _, r in second)
    with pytest.raises(ValueError):
        paced.PacedReader({"path": out, "interval_ms": "1000"})


def test_reviews_hold_where_blocks_of_a_file_meet(spark):
    rng = random.Random(9)
    text = []
    for k in range(400):
        text += rng.choice((["# reviewed: a place"], ["# Reviewed[Synthetic]: made"], ["# other"], [""], []))
        text.append(rng.choice((f"word{k}", f"Ann Co {k}x", "Ann  Co", f"  Jo Day {k} ", f"é è{k}y", f"a{k}@b.org")))
    path = shared_folder(spark, "list")
    spark.createDataFrame([("\n".join(text),)], "value string").coalesce(1).write.text(path)
    want, before = [], None
    for raw in text:
        line = raw.strip()
        if line and not line.startswith("#"):
            said = (before or "").partition(":")
            kind = {"# reviewed[synthetic]": "synthetic", "# reviewed": "plain"}.get(said[0].lower())
            want.append((line, kind, said[2].strip() if kind else None))
        before = line
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300b")
    try:
        listed = lists.lines(spark, path)
        assert listed.select("block").distinct().count() > 10
        got = lists.vocabulary(listed, ["Ann Co"]).collect()
        assert sorted(map(str, ((r["entry"], r["review"], r["reason"]) for r in got))) == sorted(map(str, want))
        assert lists.stand_ins(listed).count() == len(want)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
    errors = {(r["entry"], r["review"]): r["error"] for r in got}
    for (entry, review), error in errors.items():
        if entry == "Ann  Co":
            assert error == "duplicate"
        elif "@" in entry:
            assert error == ("not synthetic" if review == "synthetic" else "personal data")
        elif entry.startswith("word"):
            assert error == ("not synthetic" if review == "synthetic" else None)
        elif review is None:
            assert error == "needs a review"
        elif entry.startswith("Ann Co"):
            assert error == ("not synthetic" if review == "synthetic" else None)


def test_grouping_sets(spark):
    rows = spark.createDataFrame([(1, "S", "O", "O"), (1, "D", "O", "F"), (2, "S", None, "F"), (None, "S", "F", "F")], "t int, c string, winner_side string, side string")
    got = {(r["t"], r["c"], r["level"]): (r["matches"], r["wins"], r["losses"]) for r in timeline.grouped_records(rows, [["t", "c"], ["c"], []], ["t", "c"]).collect()}
    assert got == {(1, "S", 0): (1, 1, 0), (1, "D", 0): (1, 0, 1), (2, "S", 0): (1, 0, 0), (None, "S", 0): (1, 1, 0), (None, "S", 2): (3, 2, 0), (None, "D", 2): (1, 0, 1), (None, None, 3): (4, 2, 1)}
