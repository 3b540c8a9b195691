"""SimHash near duplicates, against brute force."""

import random
import re
from itertools import combinations

import xxhash

from rallyframe.llm import simhash

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text, size=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    said = [" ".join(w[k : k + size]) for k in range(len(w) - size + 1)] if len(w) >= size else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in said]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints, distance):
    """prints: (doc_id, fingerprint) pairs; a doc_id may stand in several."""
    comp = {i: i for i, _ in prints}
    for (a, x), (b, y) in combinations(prints, 2):
        if (x ^ y).bit_count() <= distance and comp[a] != comp[b]:
            lo, hi = sorted((comp[a], comp[b]))
            comp = {i: lo if c == hi else c for i, c in comp.items()}
    return comp


def held_to(got, rows, distance=3):
    prints = [(i, plain_fingerprint(t)) for i, t in rows]
    comp = plain_components([p for p in prints if p[0] is not None], distance)
    want = sorted((str(i), f"{f:016x}", str(comp.get(i)), i is None or comp[i] == i) for i, f in prints)
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"]), r["kept"]) for r in got) == want


def test_fingerprints_read_whole_texts_in_pieces(monkeypatch):
    rng = random.Random(3)
    texts = ["", " \t\n", "one", "One  TWO", "é È\x85x ß", "  a b", "a\x00b c d e", *("".join(rng.choice("ab C\n é") for _ in range(rng.randint(1, 400))) for _ in range(60))]
    for piece in (1, 7, 1 << 20):
        monkeypatch.setattr(simhash, "PIECE", piece)
        for t in texts:
            assert simhash.fingerprint(t.encode()) == plain_fingerprint(t), (piece, t)


def test_documents_equal_brute_force(spark):
    rng = random.Random(5)
    vocab = [f"w{k}" for k in range(300)]
    rows = []
    for base in range(12):
        words = [rng.choice(vocab) for _ in range(rng.choice((5, 60, 300)))]
        for copy in range(rng.choice((1, 2, 30))):
            w = list(words)
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((base * 100 + copy, rng.choice((" ", "\n")).join(w).upper()))
    rows += [(5000, None), (5001, ""), (5002, " \t"), (5003, "one"), (5004, "ONE"), (5005, "long " * 60_000), (5006, "long " * 70_000), (None, "one"), (None, None)]
    rows += [rows[3], (101, rows[-3][1]), (5003, "something else altogether")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, fingerprint string, id int")
    for block in (500, 3):
        held_to(simhash.simhash_duplicates(df, block=block).collect(), rows)
    assert simhash.simhash_duplicates(df.where("false")).count() == 0


def linked(spark, prints, distance, block):
    classes = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in prints], "id long, fp long")
    comp = {i: i for i, _ in prints}
    for r in simhash.links(classes, distance, block).collect():
        lo, hi = sorted((comp[r["a"]], comp[r["b"]]))
        comp = {i: lo if c == hi else c for i, c in comp.items()}
    return comp


def test_links_of_flipped_bits_and_crowded_cells(spark):
    rng = random.Random(8)
    prints, seen = [], set()
    for _ in range(60):
        f = rng.choice((0, (1 << 64) - 1, rng.getrandbits(64)))
        for _ in range(6):
            for b in rng.sample(range(64), rng.randint(0, 4)):
                f ^= 1 << b
            if f not in seen:
                seen.add(f)
                prints.append((len(prints), f))
    for distance in (0, 1, 2, 3, 6):
        want = plain_components(prints, distance)
        for block in (500, 4):
            assert linked(spark, prints, distance, block) == want, (distance, block)
    # one hot cell: the low half is the same, the high half walks
    walk = [(k, k ^ k >> 1) for k in range(1500)]
    crowd = [(k, g << 32) for k, g in walk]
    assert set(linked(spark, crowd, 1, 40).values()) == {0}
    apart = [(k, (g << 32) * 1) for k, g in walk if g.bit_count() % 2 == 0]
    assert linked(spark, apart, 1, 40) == {k: k for k, _ in apart}


def test_every_pair_within_the_distance_meets_exactly_in_cells(spark):
    """All flips of up to three bits of random fingerprints, each pair on its own."""
    rng = random.Random(9)
    base = rng.getrandbits(64)
    flips = [()] + [rng.sample(range(64), k) for k in (1, 2, 3) for _ in range(40)] + [(62, 63, 61), (0, 32, 63), (31, 32), (0, 1, 2)]
    for flip in flips[1:]:
        other = base
        for b in flip:
            other ^= 1 << b
        points = [plain_cells(base), plain_cells(other)]
        assert points[0][0] & points[1][0] or points[0][0] & points[1][1] or points[0][1] & points[1][0], flip
    one = spark.createDataFrame([(1, base - (1 << 64) if base >> 63 else base)], "id long, fp long")
    got = {(r["piece"], r["cell"] % (1 << 64), r["own"]) for r in simhash.cells(one, 3).collect()}
    own, called = plain_cells(base)
    assert got == {(p, c, True) for p, c in own} | {(p, c, False) for p, c in called}


def plain_cells(f):
    counts = [(f >> 2 * s & 3).bit_count() for s in range(32)]
    own, called = set(), set()
    for p, part in enumerate((range(16), range(16, 32))):
        at = sum(counts[s] << 2 * s for s in part)
        own.add((p, at))
        called |= {(p, at + (1 << 2 * s)) for s in part if counts[s] < 2}
    return own, called


def test_op12_on_its_table(spark):
    got = simhash.op12_simhash(spark, SF)
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert got.columns[:3] == ["doc_id", "fingerprint", "component_id"]
    held_to(got.collect(), rows)
