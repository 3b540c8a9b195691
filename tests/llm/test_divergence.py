"""The divergence audit, against exact arithmetic by hand."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from rallyframe.llm import divergence


def plain(rows, least, ranks):
    texts = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for text, lang, source in rows]
    documents, counts, whole = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for lang, source, found in texts:
        documents[lang].update(set(found))
        counts[lang, source].update(found)
        whole[lang].update(found)
    out = []
    for lang, source in counts:
        kept = [t for t, n in documents[lang].items() if n >= least]

        def p(count, kept=kept):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 2) // (total + 2 * len(kept)) for t in kept}

        mine, q = p(counts[lang, source]), p(whole[lang])
        f = lambda a, b: (a - b) ** 2 // (a + b)
        parts = {"pair": [], "term": []}
        for l2, other in counts:
            if l2 == lang and other != source:
                theirs = p(counts[lang, other])
                parts["pair"].append((other, sum(f(mine[t], theirs[t]) for t in kept)))
        parts["term"] = [(t, f(mine[t], q[t])) for t in kept if counts[lang, source][t] and mine[t] > q[t]]
        for part, items in parts.items():
            items.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, i, v, r) for r, (i, v) in enumerate(items, 1) if part == "pair" or r <= ranks]
    return sorted(out)


def made(seed):
    rng = random.Random(seed)
    vocab = [f"{a}{b}" for a in "abcdeé" for b in ("", "x", "Ø", "zz", "𝒳")]
    rows = []
    for _ in range(250):
        lang, source = rng.choice(("en", "en", "fr", None, "")), rng.choice(("s1", "s2", "s3", None, "É"))
        words = [rng.choice(vocab[: rng.choice((6, 30))]) for _ in range(rng.randint(0, 40))]
        rows.append((rng.choice((" ", "1", "--", "\x7f")).join(words).swapcase() if rng.random() < 0.95 else None, lang, source))
    return rows + [("only words of few documents", "xx", "s1"), ("", "xx", "s2"), (None, "yy", "s1"), ("É É é e\x00f ZZ " * 9000, "en", "s1")] + rows[:5]


@pytest.mark.parametrize("least,ranks,piece,held", [(10, 10, 1 << 20, 100_000), (3, 4, 50, 20), (10**6, 10, 7, 5)])
def test_equal_to_arithmetic_by_hand(spark, monkeypatch, least, ranks, piece, held):
    monkeypatch.setattr(divergence, "PIECE", piece)
    monkeypatch.setattr(divergence, "HELD", held)
    rows = made(least)
    df = spark.createDataFrame([(t, a, b, 1, "z") for t, a, b in rows], "text string, lang string, source string, n int, term string")
    got = divergence.divergence(df, least, ranks)
    assert sorted(map(tuple, got.collect())) == plain(rows, least, ranks)
    assert divergence.divergence(df.where("false")).count() == 0


def test_terms_are_cut_whatever_the_piece(monkeypatch):
    text = ("Ab1cD é_ÉZ\x00q " * 30).encode()
    want = re.findall(rb"[a-z\x80-\xff]+", text.lower())
    for piece in (1, 2, 3, 64, 1000):
        monkeypatch.setattr(divergence, "PIECE", piece)
        assert [t for part in divergence.terms(text) for t in part] == want


def test_counts_beyond_a_long_times_the_scale(spark):
    big = 10**13
    counts = spark.createDataFrame([("l", "a", "x", big, big), ("l", "a", "y", 5, 20), ("l", "b", "x", 7, 30), ("l", "b", "y", 3 * big, 30)], "lang string, source string, term string, n long, documents long")
    kept = divergence.kept_counts(counts)
    docs = spark.createDataFrame([("l", "a"), ("l", "b")], "lang string, source string")
    got = divergence.pair_sums(kept, divergence.group_totals(docs, kept)).collect()
    p = lambda n, t: 1 + 10**9 * (n + 2) // (t + 4)
    a, b = (p(big, big + 5), p(5, big + 5)), (p(7, 3 * big + 7), p(3 * big, 3 * big + 7))
    assert {r["value"] for r in got} == {sum((x - y) ** 2 // (x + y) for x, y in zip(a, b))}


def test_op13_and_its_sql_on_the_table(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.sql(divergence.OP13_SQL).fetchall()
    assert sorted(map(tuple, divergence.op13_divergence(spark, sf).collect())) == sorted(want)
    assert {r[2] for r in want} == {"pair", "term"}
