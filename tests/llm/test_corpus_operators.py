"""Mixing, near duplicates, decontamination, media, WARC and the pipeline, against brute force."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rallyframe.llm import decontaminate, graph, media, mixing, neardup, warc
from rallyframe.llm.common import scratch_path

SF = "/root/testdata/sf0.001"


def edf(counts):
    """Earliest deadline first over one round, slot by slot."""
    total, done, out = sum(counts), [0] * len(counts), []
    for slot in range(total):
        ready = [(-(-(d + 1) * total // c), i) for i, (d, c) in enumerate(zip(done, counts)) if d < c and d * total // c <= slot]
        i = min(ready)[1]
        out.append(i)
        done[i] += 1
    return out


def test_schedule_equals_slot_by_slot_simulation_and_stays_within_one_block(spark):
    rng = random.Random(4)
    for _ in range(6):
        shape = [(c, rng.randint(1, 3)) for c in sorted(rng.sample(range(1, 13), rng.randint(1, 5)))]
        counts = [c for c, k in shape for _ in range(k)]  # members of a class follow each other
        row = spark.createDataFrame([(shape, sum(counts))], "s array<struct<c:long,k:long>>, t long").select(mixing._earliest_deadline_first(F.col("s"), F.col("t")).alias("o")).first()["o"]
        served = Counter()
        order = []
        for i in row:
            c, k = shape[i]
            order.append(sum(k for _, k in shape[:i]) + served[i] % k)
            served[i] += 1
        assert order == edf(counts)
        done = Counter()
        for k, i in enumerate(order):
            done[i] += 1
            assert all(abs(done[s] - (k + 1) * c / sum(counts)) < 1 for s, c in enumerate(counts))


def rounds_by_hand(blocks, weights):
    """Slots of a mix, round by round: in a round the sources that have blocks give their weight or what is left."""
    left, slots = dict(blocks), []
    while any(left.values()):
        order = sorted((s for s in left if left[s]), key=lambda s: (min(weights[s], left[s]), left[s] < weights[s] or None is s, s))
        counts = {s: min(weights[s], left[s]) for s in order}
        slots.append(counts)
        for s in order:
            left[s] -= counts[s]
    return slots


@pytest.mark.parametrize("many", (7, 1000, 5000))
def test_any_number_of_sources_is_mixed(spark, many):
    rng = random.Random(many)
    sizes = {f"s{k}": rng.choice((1, 2, 3, 7, 30 if many < 100 else 5)) for k in range(many)}
    weights = {f"s{k}": 1 + k % 3 for k in range(6)}
    df = spark.createDataFrame([(i, s) for s, n in sizes.items() for i in range(n)], "doc_id long, source string")
    got = mixing.mix_sources(df, weights, 2, block_rows=1).collect()
    total = sum(sizes.values())
    assert sorted(r["mix_slot"] for r in got) == list(range(total)) and all(r["mix_position"] == r["mix_slot"] for r in got)
    order = [r["source"] for r in sorted(got, key=lambda r: r["mix_slot"])]
    at = 0
    for counts in rounds_by_hand(sizes, {s: weights.get(s, 2) for s in sizes}):
        slots = sum(counts.values())
        now = order[at : at + slots]
        assert Counter(now) == counts
        if slots < 300 or at == 0:
            done = Counter()
            for k, s in enumerate(now):
                done[s] += 1
                assert abs(done[s] - (k + 1) * counts[s] / slots) < 1
        at += slots


def test_copies_of_one_row_do_not_fill_a_bucket(spark):
    n = 30_000
    df = spark.range(n).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("doc_id"), F.lit("a").alias("source"), F.create_map(F.lit("k"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id"))).alias("m"))
    sources = spark.createDataFrame([("sa", n)], "src string, n long")
    dealt, sized = mixing._dealt(df, sources, F.concat(F.lit("s"), "source"), df.columns, "doc_id")
    sizes = [r["count"] for r in dealt.groupBy("src", "bucket").count().collect()]
    assert sorted(r["m"] for r in sized.collect()) == sorted(sizes)
    assert sum(sizes) == n and max(sizes) < 2000  # without dealing one bucket has 10000
    got = mixing.mix_sources(df)
    assert got.select("mix_position").distinct().count() == n and got.agg(F.max("mix_position")).first()[0] == n - 1
    assert got.where("doc_id = 0").count() == n // 3 and got.schema["m"].dataType == df.schema["m"].dataType


def test_mixing_places_every_row_once(spark):
    sizes = {"a": 700, "b": 150, "c": 33, None: 40, "": 1}
    rows = [(i, s, "m", "h") for s, n in sizes.items() for i in range(n)] + [(None, "a", "m", "h")] * 3
    df = spark.createDataFrame(rows, "doc_id long, source string, mix_slot string, src string")
    got = mixing.mix_sources(df, {"a": 4, "b": 2}, 1, block_rows=8).collect()
    assert sorted(r["mix_position"] for r in got) == list(range(len(rows)))
    slots = defaultdict(set)
    for r in got:
        slots[r["mix_slot"]].add((r["source"], r["mix_block"]))
    assert all(len(v) == 1 for v in slots.values()) and sorted(slots) == list(range(len(slots)))
    # the slots of full rounds repeat the schedule of the weights
    first = [next(iter(slots[k]))[0] for k in range(9)]
    assert Counter(first) == {"a": 4, "b": 2, "c": 1, None: 1, "": 1}
    seen = defaultdict(int)
    for k in range(len(slots)):
        (s, b), = slots[k]
        assert b == seen[s]
        seen[s] += 1
    assert mixing.mix_sources(df.where("false"), {}, 1).count() == 0
    with pytest.raises(ValueError):
        mixing.mix_sources(df, {"a": 0})


def test_mixing_is_native(spark):
    plan = mixing.op1_mixing(spark, SF)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|MapIn", plan)


def sets_of(texts, shingle):
    out = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out[i] = {tuple(w[k : k + shingle]) for k in range(len(w) - shingle + 1)} if len(w) >= shingle else {tuple(w)} if w else set()
    return out


def brute_components(sets, per_cent):
    comp = {i: i for i in sets}
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and comp[a] != comp[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= per_cent * (len(sets[a]) + len(sets[b]) - both):
                    lo, hi = sorted((comp[a], comp[b]))
                    comp = {i: lo if c == hi else c for i, c in comp.items()}
    return comp


def near_texts():
    rng = random.Random(9)
    vocab = [f"w{k}" for k in range(400)]
    texts = {}
    for base in range(8):
        words = [rng.choice(vocab) for _ in range(rng.choice((20, 90, 200)))]
        for copy in range(rng.choice((1, 2, 25))):
            w = list(words)
            for _ in range(rng.randint(0, 6)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            texts[base * 100 + copy] = rng.choice((" ", "\n", "  ")).join(w)
            if rng.random() < 0.3:
                words = w  # a chain of copies of copies
    texts |= {900: None, 901: "", 902: " \t ", 903: "one", 904: "ONE", 905: "one two", 906: "é É", 907: "é é", 908: "long " * 50_000, 909: "long " * 60_000}
    return texts


@pytest.mark.parametrize("shingle,per_cent,rows,bands,block,again_above", [(5, 80, 5, 30, 4, None), (3, 85, 6, 24, 3, 2)])
def test_near_duplicates_equal_brute_force(spark, shingle, per_cent, rows, bands, block, again_above):
    texts = near_texts()
    data = [(i, t, "x", 1) for i, t in texts.items()] + [(3, texts.get(3, "z"), "x", 1), (None, "one", "x", 1)]
    df = spark.createDataFrame([*data, data[0]], "doc_id long, text string, component string, n int")
    got = neardup.near_duplicates(df, shingle, per_cent, rows, bands, block, again_above).collect()
    assert len(got) == len(data) + 1
    sets = sets_of(texts | {3: texts.get(3, "z")}, shingle)
    want = brute_components(sets, per_cent)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]], want[r["doc_id"]] == r["doc_id"]), r
    assert neardup.near_duplicates(df.where("false"), shingle, per_cent, rows, bands).count() == 0


def test_near_duplicates_with_several_texts_under_one_id(spark):
    rng = random.Random(12)
    vocab = [f"w{k}" for k in range(300)]
    texts = [[rng.choice(vocab) for _ in range(100)] for _ in range(6)]
    near = [[*t[:50], "x", *t[51:]] for t in texts]
    # 1 holds texts 0 and 1, 9 holds 1 and 2, 3 holds 4 twice; 5, 6, 8, 10 hold near copies
    held = [(1, texts[0]), (1, texts[1]), (5, near[0]), (6, near[1]), (9, texts[1]), (9, texts[2]), (8, near[2]), (3, texts[4]), (3, texts[4]), (10, near[4]), (2, texts[5]), (2, texts[3]), (11, ["z"])]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in held], "doc_id long, text string")
    want = {1: 1, 5: 1, 6: 1, 9: 1, 8: 1, 3: 3, 10: 3, 2: 2, 11: 11}
    for block, again_above in ((500, None),):
        got = neardup.near_duplicates(df, 3, 85, 6, 24, block, again_above).collect()
        assert sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got) == sorted((i, max(1, len(t) - 2), want[i], want[i] == i) for i, t in held)


def test_near_duplicates_in_a_crowded_bucket(spark):
    rng = random.Random(2)
    vocab = [f"w{k}" for k in range(5000)]
    base = [rng.choice(vocab) for _ in range(150)]
    texts = {}
    for i in range(120):  # about as alike as asked, some more, some less
        w = list(base)
        for p in rng.sample(range(150), rng.choice((1, 4, 8, 12))):
            w[p] = rng.choice(vocab)
        texts[i] = " ".join(w)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = brute_components(sets_of(texts, 3), 85)
    for block, again_above in ((10, None), (10, 20)):
        got = neardup.near_duplicates(df, 3, 85, 6, 24, block, again_above).collect()
        assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_scratch_tables_go(spark):
    import os

    def size():
        base = scratch_path(spark, "x").rpartition("/")[0].removeprefix("file://")
        return set(os.listdir(base)) if os.path.isdir(base) else set()

    rng = random.Random(5)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(40):  # enough that buckets stay open and are keyed again
        w = list(base)
        for p in rng.sample(range(60), 2):
            w[p] = f"x{i}{p}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for again_above in (None, 5):
        before = size()
        assert neardup.near_duplicates(df, 3, 85, 6, 24, 500, again_above).count() == 40
        assert {n.rpartition("-")[0] for n in size() - before} == {"classes", "edges"}  # what the result reads


def test_sketch_agreement_estimates_similarity():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 62, 1300, dtype=np.uint64)
    for n in (3, 40, 1000):
        a, b = np.unique(base[:n]), np.unique(base[n // 4 : n + n // 4])
        both = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        sk = neardup.sketches(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), 512)
        assert (sk < np.iinfo(np.uint64).max).all()
        assert abs((sk[0] == sk[1]).mean() - both) < 0.12


def test_components_of_a_long_path_and_a_star(spark):
    rng = random.Random(1)
    path = list(range(0, 300))
    edges = [(a, b) for a, b in zip(path, path[1:])] + [(1000, k) for k in range(1001, 1200)] + [(5000, 5000)]
    rng.shuffle(edges)
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(1, 300)} | {k: 1000 for k in range(1001, 1200)}


def edited(rng, words, vocab, k):
    w = list(words)
    for _ in range(k):
        p, kind = rng.randrange(len(w)), rng.random()
        if kind < 0.34:
            w[p] = rng.choice(vocab)
        elif kind < 0.67:
            del w[p]
        else:
            w.insert(p, rng.choice(vocab))
    return w


def plain_infix_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item):
        old, row[0] = row[0], i + 1
        for j, y in enumerate(text):
            old, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, old + (x != y))
    return min(row)


def test_infix_distance():
    rng = np.random.default_rng(3)
    for _ in range(300):
        a, b = rng.integers(0, 4, rng.integers(1, 80)).astype(np.uint64), rng.integers(0, 4, rng.integers(0, 60)).astype(np.uint64)
        assert decontaminate.infix_distance(a, b) == plain_infix_distance(a.tolist(), b.tolist())


def test_leaks_equal_brute_force(spark):
    rng = random.Random(8)
    vocab = [f"v{k}" for k in range(60)] + ["the", "of", "and"] * 5
    items = {k: [rng.choice(vocab) for _ in range(rng.choice((5, 6, 9, 14, 30, 70)))] for k in range(30)}
    texts = {900: None, 901: "", 902: "the of and " * 30_000}
    for d in range(150):
        body = [rng.choice(vocab) for _ in range(rng.randint(0, 120))]
        if d % 2:
            w = items[rng.randrange(30)]
            body[rng.randint(0, len(body)) :] += edited(rng, w, vocab, rng.randint(0, len(w) // 4))
        texts[d] = rng.choice((" ", "\n", ", ")).join(body)
    docs = spark.createDataFrame([*((i, t, 1, 2) for i, t in texts.items()), (1, texts[1], 1, 2)], "doc_id long, text string, item_id int, edits int")
    bench = spark.createDataFrame([*((k, " ".join(w).upper()) for k, w in items.items()), (98, None), (99, ""), (97, "too short")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in decontaminate.find_leaks(docs, bench).collect()}
    want = {}
    for i, t in texts.items():
        if i == 902:
            continue
        words = re.findall(r"\w+", (t or "").lower())
        for k, w in items.items():
            d = plain_infix_distance(w, words)
            if d <= int(0.2 * len(w)):
                want[i, k] = d
    assert {k for k, d in got.items() if d > 0} <= set(want) and all(want[k] == d for k, d in got.items())
    assert all(k in got for k, d in want.items() if d == 0) and len(got) >= 0.97 * len(want)
    blocks = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, bench, block_items=7).collect()}
    assert len(blocks ^ set(got)) <= 0.05 * len(want)
    kept = decontaminate.without_leaks(docs, bench)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.select("doc_id").collect()} == set(texts) - {i for i, _ in got}
    assert decontaminate.find_leaks(docs, bench.where("false")).count() == 0 and decontaminate.find_leaks(docs.where("false"), bench).count() == 0


def test_recall_at_the_largest_distance():
    rng = random.Random(3)
    vocab = [f"v{k}" for k in range(300)] + ["the"] * 40
    items = [[rng.choice(vocab) for _ in range(n)] for n in (12, 20, 35, 50, 80) for _ in range(12)]
    index = decontaminate.ItemIndex(list(range(len(items))), [" ".join(w) for w in items])
    texts = [" ".join(rng.choices(vocab, k=80) + edited(rng, w, vocab, len(w) // 5) + rng.choices(vocab, k=80)) for w in items for _ in range(3)]
    got = {(r, i) for r, i, _ in index.leaks(decontaminate.words_of(pa.array(texts)))}
    assert sum((k, k // 3) in got for k in range(len(texts))) >= 0.97 * len(texts)


def only(rng, words, vocab, k, kind):
    """k edits of one kind, or mixed ones."""
    w = list(words)
    if kind == "insert":
        for _ in range(k):
            w.insert(rng.randrange(len(w)), rng.choice(vocab))
    elif kind == "delete":
        for p in sorted(rng.sample(range(len(w)), k), reverse=True):
            del w[p]
    elif kind == "replace":
        for p in rng.sample(range(len(w)), k):
            w[p] = rng.choice(vocab)
    else:
        w = edited(rng, w, vocab, k)
    return w


@pytest.mark.parametrize("size", (5, 40, 80, 150, 300, 600, 1500))
@pytest.mark.parametrize("kind", ("insert", "delete", "mixed"))
def test_recall_at_the_largest_distance_by_size(size, kind):
    rng = random.Random(f"{size}{kind}")
    vocab = [f"v{k}" for k in range(3000)] + ["the"] * 400
    items = [[rng.choice(vocab) for _ in range(size)] for _ in range(6)]
    index = decontaminate.ItemIndex(list(range(len(items))), [" ".join(w) for w in items])
    texts = [" ".join(rng.choices(vocab, k=rng.randint(0, 400)) + only(rng, w, vocab, size * k // 20, kind) + rng.choices(vocab, k=200)) for w in items for k in (0, 1, 4)]
    got = {(r, i) for r, i, _ in index.leaks(decontaminate.words_of(pa.array(texts)))}
    assert got == {(r, r // 3) for r in range(len(texts))}


@pytest.mark.parametrize("size", (5, 40, 80, 150, 300, 600, 1500))
@pytest.mark.parametrize("kind", ("insert", "delete", "replace", "mixed"))
def test_keys_alone_reach_their_recall(size, kind):
    """Without the count, all leaks at the largest distance but at most one in twenty are found."""
    rng = random.Random(f"keys{size}{kind}")
    vocab = [f"v{k}" for k in range(3000)] + ["the"] * 400
    items = [[rng.choice(vocab) for _ in range(size)] for _ in range(20)]
    index = decontaminate.ItemIndex(list(range(len(items))), [" ".join(w) for w in items], exact=False)
    texts = [" ".join(rng.choices(vocab, k=rng.randint(0, 300)) + only(rng, w, vocab, size // 5, kind) + rng.choices(vocab, k=100)) for w in items]
    got = {(r, i) for r, i, _ in index.leaks(decontaminate.words_of(pa.array(texts)))}
    assert len(got) >= 0.95 * len(texts) and got <= {(r, r) for r in range(len(texts))}


def test_blocks_that_are_held_serve_the_next_batch(spark, monkeypatch):
    bench = spark.createDataFrame([(k, f"a{k} b{k} c{k} d{k} e{k}") for k in range(12)], "item_id long, text string")
    blocks = decontaminate.item_blocks(bench, block_items=1)
    decontaminate._index.cache_clear()
    batch = pa.record_batch([pa.array(["x a3 b3 c3 d3 e3", "nothing of them"])], names=["text"])
    for _ in range(3):
        assert [(i.ids[f[1]], f[0]) for i, found in decontaminate._leaks(batch, blocks) for f in found] == [(3, 0)]
    read = decontaminate._index.cache_info()
    assert read.hits == 2 * min(len(blocks), decontaminate.HELD) and read.misses == 3 * len(blocks) - read.hits


def test_documents_with_long_items_go_whatever_the_blocks(spark):
    rng = random.Random(31)
    vocab = [f"v{k}" for k in range(2000)]
    items = {k: [rng.choice(vocab) for _ in range(n)] for k, n in enumerate((5, 150, 600, 900))}
    texts = {10 * k + j: rng.choices(vocab, k=100) + only(rng, w, vocab, len(w) // 5, kind) + rng.choices(vocab, k=50) for k, w in items.items() for j, kind in enumerate(("insert", "delete", "mixed"))}
    texts |= {100 + k: rng.choices(vocab, k=700) for k in range(5)}
    docs = spark.createDataFrame([(i, " ".join(t), i) for i, t in texts.items()], "doc_id long, text string, uri long")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()] * 3, "item_id long, text string")
    want = {(10 * k + j, k) for k in items for j in range(3)}
    for options in ({"block_items": 1}, {"block_bytes": 2000}):
        assert {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, bench, **options).collect()} == want
        kept = decontaminate.without_leaks(docs, bench, **options)
        assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {100 + k for k in range(5)}
    assert len(decontaminate.item_blocks(bench, block_items=1)) > 1


def test_counting_finds_every_leak_that_brute_force_finds(monkeypatch):
    rng = random.Random(4)
    vocab = [f"v{k}" for k in range(40)] + ["the", "of"] * 5
    items = [[rng.choice(vocab) for _ in range(rng.choice((5, 6, 9, 14, 30, 70)))] for _ in range(40)]
    texts = []
    for w in items * 3:
        k = int(0.2 * len(w))
        texts.append(rng.choices(vocab, k=rng.randint(0, 60)) + edited(rng, w, vocab, k) + rng.choices(vocab, k=rng.randint(0, 60)) + edited(rng, rng.choice(items), vocab, 1))
    index = decontaminate.ItemIndex(list(range(len(items))), [" ".join(w) for w in items])
    want = {(r, i): d for r, t in enumerate(texts) for i, w in enumerate(items) if (d := plain_infix_distance(w, t)) <= int(0.2 * len(w))}
    column = pa.array([" ".join(t) for t in texts])
    assert {(r, i): d for r, i, d in index.leaks(decontaminate.words_of(column))} == want
    counted = index._counted
    monkeypatch.setattr(index, "_counted", lambda c, flat, base: counted(c, flat, base, limit=50))  # many small steps
    assert {(r, i): d for r, i, d in index.leaks(decontaminate.words_of(column))} == want


def test_words_of_unspaced_scripts_and_punctuation():
    texts = ["", "我们在家，看书。abc中de", "ที่นี่ดี x", "e\u0301te\u0301«naïve»\u00a0Straße…fin", "カー12ガ", "한국어 말", "中", "\u0e48中", "😀 ok"]
    want = [[], [*"我们在家看书", "abc", "中", "de"], ["ที่", "นี่", "ดี", "x"], ["e\u0301te\u0301", "naïve", "straße", "fin"], [*"カー", "12", *"ガ"], ["한국어", "말"], ["中"], ["\u0e48", "中"], ["😀", "ok"]]
    for slice_of in (texts, texts[::-1]):
        offsets = np.cumsum([0] + [len(t.lower().encode()) for t in slice_of])
        starts, ends = decontaminate.word_spans(np.frombuffer("".join(slice_of).lower().encode(), np.uint8), offsets)
        low = "".join(slice_of).lower().encode()
        assert [low[a:b].decode() for a, b in zip(starts, ends)] == [w for ws in (want if slice_of is texts else want[::-1]) for w in ws]


def test_verbatim_items_in_unspaced_scripts_leak(spark):
    items = {1: "水的沸点在标准大气压下是多少摄氏度？", 2: "日本の首都はどこですか。東京です。", 3: "เมืองหลวงของประเทศไทยคือกรุงเทพ"}
    texts = {10 * k: f"前文很长，和题目没有关系。{t}后面还有别的文字。" for k, t in items.items()} | {40: "这一段文字里什么题目也没有。"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in decontaminate.find_leaks(docs, bench).collect()}
    assert got == {(10, 1): 0, (20, 2): 0, (30, 3): 0}
    assert [r["doc_id"] for r in decontaminate.without_leaks(docs, bench).collect()] == [40]


def padded(text):
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % 64 if raw else 64)


ODD = {1: None, 2: "", 3: "a", 4: "é" * 32, 5: "x" * 64, 6: "y" * 200_000, 7: "\n", None: "no id"}


def test_media_round_trip(spark):
    rows = [(i, t, "k", b"m") for i, t in ODD.items()] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, key string, media binary").repartition(3)
    manifest = media.write_archives(df, scratch_path(spark, "media"))
    got = media.media_features(media.read_archives(spark, manifest, range_bytes=300, batch_bytes=100)).collect()
    assert Counter(r["doc_id"] for r in got) == {i: 2 for i in ODD}
    import zipfile

    paths = [r["archive"].removeprefix("file://") for r in spark.read.parquet(manifest).collect()]
    infos = [i for path in paths for i in zipfile.ZipFile(path).infolist()]
    big = next(i for i in infos if i.file_size > 200_000)
    fast = zlib.compressobj(1, zlib.DEFLATED, -15)
    assert big.compress_size == len(fast.compress(media.wav(padded(ODD[6]))) + fast.flush())  # the fast level
    for r in got:
        p = padded(ODD[r["doc_id"]])
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["n_bytes"]) == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len((ODD[r["doc_id"]] or "").encode()))
        assert r["media_sha256"] == hashlib.sha256(media.wav(p)).hexdigest()
    assert len({r["feature"] for r in got}) == len(ODD) - 1  # null and empty are equal


def test_a_broken_member_leaves_the_others(spark):
    df = spark.createDataFrame([(i, str(i) * 1000) for i in range(20)], "doc_id long, text string").coalesce(1)
    manifest = media.write_archives(df, scratch_path(spark, "media"))
    rows = media.read_archives(spark, manifest).collect()
    path = rows[0]["archive"].removeprefix("file://")
    data = bytearray(open(path, "rb").read())
    at = sorted(r["header_offset"] for r in rows)[7] + 50
    data[at] ^= 0xFF
    open(path, "wb").write(data)
    again = media.read_archives(spark, manifest, tries=2).collect()
    assert sum(r["error"] is not None for r in again) == 1 and len(again) == 20


def test_warc_round_trip(spark):
    pages = [(1, "http://b.example.com/x", "same"), (2, "http://a.example.com/y?q#f", "same"), (3, None, None), (4, "bad\r\nurl", ""), (5, "http://b.example.com/x", "z" * 100_000), (6, "http://b.example.com/x", "same"), (None, "http://n/", "same"), (8, "http://b.example.com/x", "é")]
    pages += [(100 + k, "http://hot.example.com/", f"page {k}") for k in range(60)]
    df = spark.createDataFrame([(*p, "d", "u") for p in pages], "page_id long, url string, html string, digest string, url_key string")
    folder = scratch_path(spark, "warc")
    shards = warc.build_index(warc.write_warcs(df, folder), folder, block_lines=7)
    got = {r["page_id"]: tuple(r)[1:] for r in warc.look_up(df.select(warc.url_key(F.col("url")).alias("url_key"), "page_id"), shards).collect()}
    groups = defaultdict(list)
    for i, _, h in pages:
        groups[h or ""].append(i)
    for i, _, h in pages:
        payload = (h or "").encode()
        largest = max(x for x in groups[h or ""] if x is not None)
        want = (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), *(("response", None) if i == largest else ("revisit", largest)))
        assert got[i] == want
    assert len(got) == len(pages)
    plan = warc.look_up(df.select(warc.url_key(F.col("url")).alias("url_key"), "page_id"), shards, 3 << 20)
    assert plan.rdd.getNumPartitions() == 3
    missing = spark.createDataFrame([("com,nowhere)/", 1)], "url_key string, page_id long")
    assert warc.look_up(missing, shards).count() == 0
    assert warc.build_index(warc.write_warcs(df.where("false"), folder), folder) == []


def test_warc_with_several_payloads_under_one_page_id(spark):
    pages = [(1, "http://a/", "x"), (1, "http://a/", "y"), (1, "http://b/", "x"), (1, "http://a/", "x"), (2, "http://a/", "y"), (None, None, None), (None, None, None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    folder = scratch_path(spark, "warc")
    shards = warc.build_index(warc.write_warcs(df, folder), folder)
    got = Counter(tuple(r)[:1] + tuple(r)[3:] for r in warc.look_up(df.select(warc.url_key(F.col("url")).alias("url_key"), "page_id"), shards).collect())
    assert got == {(1, "response", None): 3, (1, "revisit", 2): 1, (2, "response", None): 1, (None, "response", None): 2}
    assert warc.task_count(spark, 0) == 1 and warc.task_count(spark, 1 << 40) == 1 << 14 and warc.task_count(spark, 2 << 20) == 2


def test_mixing_splits_rows_under_one_id(spark):
    df = spark.range(4000).selectExpr("CAST(NULL AS long) AS doc_id", "'a' AS source", "concat('t', id) AS text")
    mixed = mixing.mix_sources(df, {}, 1, block_rows=8)
    assert sorted(r["mix_position"] for r in mixed.collect()) == list(range(4000))
    h = F.xxhash64(F.col("doc_id").cast("string"), F.xxhash64("doc_id", "source", "text"))
    assert df.select(F.pmod(h, F.lit(64)).alias("b")).groupBy("b").count().agg(F.max("count")).first()[0] < 200


CONTRACT = {
    "op1_mixing": {"doc_id", "source", "mix_block", "mix_slot", "mix_position"},
    "op2_quality": {"doc_id", "held_out", "score", "predicted"},
    "op3_toxicity": {"doc_id", "held_out", "score", "predicted"},
    "op4_language": {"doc_id", "held_out", "lang_pred", "score"},
    "op5_neardup": {"doc_id", "n_shingles", "component_id", "kept"},
    "op6_decontaminate": {"doc_id", "item_id", "edits", "words"},
    "op7_media": {"doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"},
    "op8_urls": {"page_id", "host", "path", "rule", "verdict"},
    "op9_pii": {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"},
    "op10_warc": {"page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"},
}


@pytest.mark.parametrize("name", CONTRACT)
def test_registered_query(spark, name):
    import __spark_entry__

    out = __spark_entry__.queries()[name](spark, SF)
    assert CONTRACT[name] <= set(out.columns)
    rows = out.collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    if name == "op6_decontaminate":
        items = {r["item_id"]: re.findall(r"\w+", r["text"].lower()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
        words = {i: re.findall(r"\w+", (t or "").lower()) for i, t in docs.items()}
        want = {(i, k): d for i, t in words.items() for k, w in items.items() if len(w) >= 5 and len(set(w) & set(t)) >= 0.5 * len(set(w)) and (d := plain_infix_distance(w, t)) <= int(0.2 * len(w))}
        assert {(r["doc_id"], r["item_id"]): r["edits"] for r in rows} == want
        return
    key, ids = ("page_id", [p["page_id"] for p in pages]) if "page_id" in out.columns else ("doc_id", list(docs))
    assert sorted(r[key] for r in rows) == sorted(ids)
    if name == "op1_mixing":
        assert sorted(r["mix_position"] for r in rows) == list(range(len(docs))) and {r["doc_id"]: r["text"] for r in rows} == docs
    elif name == "op5_neardup":
        sets = sets_of(docs, 3)
        comp = brute_components(sets, 85)
        assert all((r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), comp[r["doc_id"]], comp[r["doc_id"]] == r["doc_id"]) for r in rows)
    elif name == "op7_media":
        for r in rows:
            p = padded(docs[r["doc_id"]])
            assert (r["payload_bytes"], r["payload_sha256"], r["media_sha256"]) == (len(p), hashlib.sha256(p).hexdigest(), hashlib.sha256(media.wav(p)).hexdigest())
    elif name == "op10_warc":
        largest = {}
        for p in pages:
            largest[p["html"] or ""] = max(largest.get(p["html"] or "", -1), p["page_id"])
        html = {p["page_id"]: p["html"] or "" for p in pages}
        for r in rows:
            at = largest[html[r["page_id"]]]
            assert (r["record_type"], r["refers_to"]) == (("response", None) if at == r["page_id"] else ("revisit", at))
            assert r["payload_digest"] == base64.b32encode(hashlib.sha1(html[r["page_id"]].encode()).digest()).decode()
    elif name in ("op2_quality", "op3_toxicity"):
        assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    elif name == "op4_language":
        assert all(0 <= r["score"] <= 1 and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
        assert all((r["lang_pred"] == "und") == (not any(c.isalpha() for c in docs[r["doc_id"]] or "")) for r in rows)


def test_pipeline_stages_equal_brute_force(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(-1, "12 34 !!", "en", "src0", 8), (-2, None, None, None, None)], docs.schema)
    now = docs.union(extra).cache()
    rows = {r["doc_id"]: r for r in now.collect()}
    texts = {i: r["text"] for i, r in rows.items()}
    kept = {i for i, t in texts.items() if t and any(c.isalpha() for c in t)}
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, now, SF).cache()
        ids = {r["doc_id"] for r in after.select("doc_id").collect()}
        if name == "language":
            assert ids == kept
        elif name == "near_duplicates":
            comp = brute_components(sets_of({i: texts[i] for i in kept}, 5), 80)
            kept = {i for i in kept if comp[i] == i}
            assert ids == kept
        elif name == "decontamination":
            words = {i: re.findall(r"\w+", texts[i].lower()) for i in kept}
            wanted = [re.findall(r"\w+", r["text"].lower()) for r in items]
            leaked = {i for i in kept for w in wanted if len(set(w) & set(words[i])) >= 0.5 * len(set(w)) and plain_infix_distance(w, words[i]) <= int(0.2 * len(w))}
            kept -= leaked
            assert ids == kept and leaked
        elif name == "personal_data":
            from rallyframe.llm.pii import masked

            assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in after.collect()} == {i: (masked(texts[i]), len(masked(texts[i]))) for i in kept}
        if name != "mixing":
            assert after.columns == docs.columns
        else:
            assert sorted(r["mix_position"] for r in after.collect()) == list(range(len(kept)))
        now = after


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def pipeline_dir(spark, tmp_path, rows, schema=DOCUMENTS):
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_the_pipeline_runs_on_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, pipeline_dir(spark, tmp_path, []))
    assert out.count() == 0 and {"doc_id", "text", "lang", "source", "n_chars", "mix_position"} <= set(out.columns)


def test_the_pipeline_as_a_whole_with_clashing_columns(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    rows = [(*r, "kept", r["doc_id"], "x") for r in docs if len((r["text"] or "").split()) > 20]
    first = rows[0]
    rows += [(9001, first[1] + " and one more", first[2], "new", 1, "kept", 9001, "x"), (9002, first[1].split(".")[0] + " quite other words " + item, "en", "new", 1, "kept", 9002, "x"), (None, None, None, None, None, "kept", 0, "x"), (9003, "   ", "en", "new", 1, "kept", 9003, "x")]
    path = pipeline_dir(spark, tmp_path, rows, DOCUMENTS + ", mix_slot string, component_id long, kept string")
    got = corpus_pipeline.run(spark, path).collect()
    ids = {r["doc_id"] for r in got}
    assert sorted(r["mix_position"] for r in got) == list(range(len(got))) and len(got) > len(rows) / 3
    assert not ids & {9001, 9002, 9003, None}  # a near copy, a leak, texts without a letter
    assert first[0] in ids or first[0] not in {r[0] for r in rows}
    for r in got:
        assert r["n_chars"] == len(r["text"]) and r["kept"] == "x" and r["component_id"] == r["doc_id"]
