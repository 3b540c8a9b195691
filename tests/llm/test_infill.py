"""Fill-in-middle, against the rule by hand and an exact round trip."""

import hashlib
import random
import re

import duckdb
import numpy as np
from pyspark.sql import functions as F

from rallyframe.llm import infill

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(doc_id, text):
    text, tokens = text or "", TOKEN.findall(text or "")
    d = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(tokens)
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return (doc_id, n, "plain", None, None, text, text)
    i, j = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(tokens[:i]), "".join(tokens[i:j]), "".join(tokens[j:])
    if h[3] % 100 < 80:
        return (doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", text)
    return (doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", text)


def texts():
    rng = random.Random(2)
    shared = " ".join(f"word{rng.randint(0, 999)}é" for _ in range(900))
    out = [None, "", " ", "a", " a", "a ", "\t\n a b\x0b\x0c", "x<P>y z", "a <S> b", "c<M>", "é\x85\xa0è 日本 𝒳", "x" * 30_000, " " * 30_000, "ab " * 20_000]
    for _ in range(120):
        head = "".join(rng.choice("abé \n日") for _ in range(rng.randint(0, 90)))
        out.append(head + rng.choice(("", shared, shared + " ", shared * 3)))
    return out


def test_rows_equal_the_rule_and_round_trip(spark):
    rows = list(enumerate(texts())) + [(None, "some words of a text"), (7, " a b"), (7, " a b")]
    df = spark.createDataFrame([(i, t, "f", [1]) for i, t in rows], "doc_id long, text string, form string, `odd name` array<int>")
    made = infill.fill_in_middle(df)
    assert made.columns == ["doc_id", "text", "odd name", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", infill.restored(F.col("output"), F.col("form")).alias("r")).collect()
    key = lambda x: (str(x[0]), x[5])
    want = sorted((plain(i, t) for i, t in rows), key=key)
    assert sorted(map(tuple, got), key=key) == want
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    assert infill.fill_in_middle(df.where("false")).count() == 0


def test_every_cut_of_every_text(monkeypatch):
    for sizes in ((64, 512, 8192), (1, 4, 9), (3, 8, 16)):
        for name, v in zip(("SHORTEST", "AVERAGE", "LONGEST"), sizes):
            monkeypatch.setattr(infill, name, v)
        cache = infill.Cache(2000)
        for t in texts():
            t = (t or "")[:700]
            seen = infill.Text(np.frombuffer(t.encode(), np.uint8), cache)
            tokens = TOKEN.findall(t)
            assert seen.tokens == len(tokens)
            for k in range(0, len(tokens) + 1, 1 if len(tokens) < 50 else 7):
                said = "".join(tokens[:k])
                assert seen.cut(k) == (len(said.encode()), len(said)), (t, k)
        assert cache.size <= 2000


def test_shared_passages_are_cut_alike_and_counted_once():
    rng = random.Random(5)
    shared = "".join(rng.choice("abc de\n") for _ in range(60_000)).encode()
    cache = infill.Cache()
    infill.Text(np.frombuffer(b"one head " + shared, np.uint8), cache)
    before, kept = cache.hits, len(cache.kept)
    infill.Text(np.frombuffer(b"another, longer head of it " + shared, np.uint8), cache)
    assert kept > 60 and cache.hits - before > 0.9 * kept
    h = infill.rolling(np.frombuffer(shared, np.uint8))
    again = infill.rolling(np.frombuffer(shared[1000:], np.uint8))
    assert (h[1000 + 31 :] == again[31:]).all() and len(np.unique(h)) > 50_000


def test_op11_and_its_sql_on_the_table(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    rel = con.sql(infill.OP11_SQL)
    got = infill.op11_infill(spark, sf)
    assert sorted(got.select(rel.columns).collect()) == sorted(rel.fetchall())
    hashed = {(r["doc_id"], r["output_sha256"], r["restored_sha256"]) for r in got.collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert hashed == {(w[0], sha(w[5]), sha(w[6])) for w in (plain(*r) for r in rows)}
