"""Language ID, quality, toxicity, personal data and URL filters."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

import numpy as np
import pyarrow as pa

from rallyframe.llm import langid, linear, pii, quality, toxicity, urls
from rallyframe.llm.common import bounded_sample

SF = "/root/testdata/sf0.01"
# Extra columns whose names clash with those that operators make.
ODD = "doc_id long, text string, lang string, source string, score double, label int, key string, predicted int, features string"


def odd_docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 1.5, 7, "k", 9, "f") for i, t, lang in rows], ODD)


ODD_ROWS = [(1, None, None), (2, "", "en"), (3, " \n\t ", "en"), (4, "the cat", None), (4, "the cat", "en"), (None, "le chat", "fr"), (6, "x" * 300_000, "en"), (7, "word " * 60_000, "en"), (8, "!!! 123", "fr"), (9, "\U0001f600 ß日本", "fr")]


def test_language_held_out_accuracy(spark):
    got = langid.op4_language(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    right, n = got.where("lang = lang_pred").count(), got.count()
    assert right / n > 0.97


def test_language_odd_rows_and_empty_tables(spark):
    docs = odd_docs(spark, ODD_ROWS)
    model = langid.fit_languages(docs)
    got = langid.predict_languages(docs, model).collect()
    assert len(got) == len(ODD_ROWS)
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (1, 2, 3, 8))
    assert by[4]["lang_pred"] in ("en", "fr") and all(0 <= r["score"] <= 1 for r in got)
    none = docs.where("false")
    assert langid.fit_languages(none) is None and langid.predict_languages(none, None).count() == 0
    assert {r["lang_pred"] for r in langid.predict_languages(docs, None).collect()} == {"und"}
    kept = langid.identified(docs, model, 0.0)
    assert kept.columns == docs.columns and kept.where("doc_id in (1, 2, 3, 8)").isEmpty()


def test_language_rare_among_many_rows_and_copies(spark):
    # 12 Greek rows of 20012, 20000 copies of one German text, and a bound of 400 rows.
    common = spark.range(20000).selectExpr("id AS doc_id", "concat('the house of the man is near the river ', id) AS text", "'en' AS lang")
    copies = spark.range(20000, 40000).selectExpr("id AS doc_id", "'das haus des mannes ist an dem fluss' AS text", "'de' AS lang")
    rare = spark.range(40000, 40012).selectExpr("id AS doc_id", "concat('το σπίτι του άνδρα είναι κοντά στο ποτάμι ', id) AS text", "'el' AS lang")
    model = langid.fit_languages(common.union(copies).union(rare), sample_rows=400)
    assert model.languages == ["de", "en", "el"]
    got = langid.predict_languages(rare.union(copies.limit(3)).union(common.limit(3)), model, keep=("lang",)).collect()
    assert len(got) == 18 and all(r["lang_pred"] == r["lang"] and r["score"] >= 0.3 for r in got)


def test_language_does_not_depend_on_the_rows_around(spark):
    texts = ["und der", "the of and", "", "le la", "a"]
    alone = [next(iter(langid.grams([t])))[4].tolist() for t in texts]
    _, _, _, owner, hashes = next(iter(langid.grams(texts)))
    assert [sorted(hashes[owner == k].tolist()) for k in range(len(texts))] == [sorted(a) for a in alone]


def test_more_languages_than_one_word_holds(spark):
    rows = [(k * 10 + j, "".join(chr(0x4E00 + 50 * k + c) for c in range(j, j + 20)), f"l{k:02}") for k in range(70) for j in range(6)]
    model = langid.fit_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.languages) == 70 and model.masks.shape[1] == 2
    got = langid.predict_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"), model, keep=("lang",)).collect()
    assert all(r["lang"] == r["lang_pred"] for r in got)


def test_language_sample_is_bounded_whatever_is_repeated(spark):
    hot = spark.range(3000).selectExpr("CAST(7 AS long) AS doc_id", "'das haus des mannes ist an dem fluss' AS text", "'de' AS lang")
    others = spark.range(100, 400).selectExpr("id AS doc_id", "concat('der hund und die katze sind im garten ', id) AS text", "'de' AS lang")
    english = spark.range(1000, 1300).selectExpr("id AS doc_id", "concat('the dog and the cat are in the garden ', id) AS text", "'en' AS lang")
    one = langid.fit_languages(hot.union(others).union(english), sample_rows=10_000)
    two = langid.fit_languages(hot.limit(1).union(others).union(english), sample_rows=10_000)
    assert (one.masks == two.masks).all()  # the repeated row counts once
    docs = hot.union(others)
    assert bounded_sample(docs, ["doc_id", "text"], 50).count() < 90
    assert bounded_sample(docs, ["doc_id", "text"], 10_000).count() == 301
    lists = docs.selectExpr("doc_id", "split(text, ' ') AS words")
    few = bounded_sample(lists, ["doc_id", "words"], 10_000, "words", 900)
    assert 50 < few.count() < 160


def test_filter_equals_plain_sets():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 1 << 62, 3000, dtype=np.uint64)) for _ in range(9)]
    f = langid.LanguageFilter([f"l{k}" for k in range(9)], np.zeros((1 << 15, 1), np.uint64), np.zeros(9))
    for k, grams in enumerate(sets):
        f.add(grams, np.full((len(grams), 1), 1 << k, np.uint64))
    f.fill = np.array([((f.masks[:, 0] >> np.uint64(k)) & np.uint64(1)).mean() for k in range(9)])
    owner = np.sort(rng.integers(0, 40, 20_000))
    grams = np.concatenate([rng.choice(s, 2000) for s in sets] + [rng.integers(0, 1 << 62, 2000, dtype=np.uint64)])
    rng.shuffle(grams)
    hits = f.hits(40, owner, grams)
    exact = np.column_stack([np.bincount(owner[np.isin(grams, s)], minlength=40) for s in sets])
    total = np.bincount(owner, minlength=40)
    assert (hits >= exact).all()  # no member is ever missed
    corrected = (hits - total[:, None] * f.fill**3) / (1 - f.fill**3)
    assert abs((corrected - exact) / total[:, None]).max() < 0.03 and abs((corrected - exact).sum() / total.sum()) < 0.02


def held_out(spark, run, label):
    got = run(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").select(label, "predicted").collect()
    return [(r[label], r["predicted"]) for r in got]


def test_quality_held_out(spark):
    got = held_out(spark, quality.op2_quality, "quality")
    bad = [p for y, p in got if y == 0]
    assert len(bad) > 10 and bad.count(0) >= 0.9 * len(bad)  # the rare class is found
    assert sum(y == p for y, p in got) >= 0.97 * len(got)


def test_toxicity_held_out(spark):
    got = held_out(spark, toxicity.op3_toxicity, "toxic")
    toxic = [p for y, p in got if y == 1]
    assert len(toxic) > 10 and toxic.count(1) >= 0.7 * len(toxic)  # 33 toxic rows are learned from
    assert sum(y == 0 and p == 1 for y, p in got) <= 0.03 * len(got)


def dual_by_projected_gradient(x, y, most, steps=40_000):
    """The dual of the hinge loss, max sum(a) - |X^T (a y)|^2 / 2 with 0 <= a <= most, by plain projected gradient."""
    q = (x * y[:, None]) @ (x * y[:, None]).T
    rate, a = 1 / np.linalg.eigvalsh(q)[-1], np.zeros(len(y))
    for _ in range(steps):
        a = np.clip(a + rate * (1 - q @ a), 0, most)
    return x.T @ (a * y)


def test_dual_coordinate_descent_equals_a_plain_solver():
    rng = np.random.default_rng(6)
    rows = [np.sort(rng.choice(30, rng.integers(2, 8), replace=False)) for _ in range(60)]
    extra = np.column_stack([np.ones(60), rng.random(60)])
    y = np.where([(5 in r) or (9 in r) for r in rows], 1.0, -1.0)
    y[:4] *= -1  # not separable
    scale = rng.normal(size=30)
    w, v = linear.hinge_dcd(rows, extra, y, scale, cost=0.7, epochs=3000, seed=1)
    x = np.zeros((60, 32))
    for i, r in enumerate(rows):
        x[i, r] = scale[r] / np.sqrt((scale[r] ** 2).sum())
    x[:, 30:] = extra
    share = (y > 0).mean()
    want = dual_by_projected_gradient(x, y, np.where(y > 0, 0.7 * 0.5 / share, 0.7 * 0.5 / (1 - share)))
    assert np.allclose(np.concatenate([w, v]), want, atol=1e-4)


def test_log_count_ratios_by_hand():
    rows = [np.array([1, 2]), np.array([2]), np.array([2, 3]), np.array([], int)]
    r = linear.log_count_ratios(rows, np.array([1, 1, -1, -1]))
    positive, negative = 3 + linear.DIM, 2 + linear.DIM  # features, each raised by 1
    for feature, p, n in ((1, 2, 1), (2, 3, 2), (3, 1, 2), (4, 1, 1)):
        assert np.isclose(r[feature], np.log((p / positive) / (n / negative)))


def test_chain_feeds_earlier_probabilities_to_later_models():
    rng = np.random.default_rng(3)
    rows = [np.sort(rng.choice(40, 6, replace=False)) for _ in range(300)]
    first = np.array([7 in r for r in rows])
    y = np.column_stack([first, first])  # the second category equals the first
    one, two = toxicity.fit_rows(y, rows, 2)
    assert len(one.dense) == 1 and len(two.dense) == 2 and two.dense[1] > 0
    # the training input of the second model is the out-of-fold output of the first
    _, out_of_fold = linear.fit(rows, np.ones((300, 1)), y[:, 0], cost=8.0)
    again, _ = linear.fit(rows, np.column_stack([np.ones(300), out_of_fold]), y[:, 1], cost=8.0)
    assert np.allclose(again.weights, two.weights) and np.allclose(again.dense, two.dense)
    # by hand for one row: p1, then p2 from the features and p1
    i = int(np.flatnonzero(first)[0])
    m1 = one.weights[rows[i]].sum() / np.sqrt((one.scale[rows[i]] ** 2).sum()) + one.dense[0]
    p1 = 1 / (1 + np.exp(-(one.slope * m1 + one.offset)))
    m2 = two.weights[rows[i]].sum() / np.sqrt((two.scale[rows[i]] ** 2).sum()) + two.dense @ [1, p1]
    owner, feature = np.zeros(len(rows[i]), int), rows[i]
    got1 = one.probability(one.margins(owner, feature, 1, np.ones((1, 1))))
    got2 = two.margins(owner, feature, 1, np.column_stack([np.ones((1, 1)), got1]))
    assert np.isclose(got1[0], p1) and np.isclose(got2[0], m2)


def test_ngram_features_do_not_depend_on_the_rows_around():
    texts = ["a b a", "", "b!! c", "é à"]
    alone = [next(iter(linear.features(pa.array([t]), (3,), True)))[3].tolist() for t in texts]
    _, _, owner, feature = next(iter(linear.features(pa.array(texts), (3,), True)))
    assert [feature[owner == k].tolist() for k in range(len(texts))] == alone


def test_classifiers_take_odd_rows(spark):
    docs = odd_docs(spark, ODD_ROWS)
    labels = spark.createDataFrame([(2, 0, 1), (4, 1, 0), (7, 1, None), (None, 0, 0), (99, 1, 1), (4, None, 0)], "doc_id long, quality int, toxic int")
    for lab in (labels, labels.where("false"), labels.where("quality = 1")):
        got = quality.score_quality(docs, quality.fit_quality(docs, lab)).collect()
        assert len(got) == len(ODD_ROWS) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
        assert toxicity.score_chain(docs, toxicity.fit_chain(docs, lab)).count() == len(ODD_ROWS)
    none = docs.where("false")
    assert toxicity.score_chain(none, toxicity.fit_chain(none, labels)).count() == 0
    assert quality.score_quality(none, quality.fit_quality(none, labels)).count() == 0


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_items(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = [c for c in m[0] if c.isdigit()]
            doubled = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
            good = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(digits) <= 19 and sum(v - 9 * (v > 9) for v in doubled) % 10 == 0, "phone": 8 <= len(digits) <= 15}
            if good[kind]:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_items_equal_the_patterns_on_random_texts():
    rng = random.Random(5)
    for alphabet in ("0123456789.@+- ()a%é4512", "12.", "0 -5+", "a@b.-", "4111 -"):
        for _ in range(4000):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 70)))
            assert [x for x in pii.find(text) if x[0] in BASE] == base_items(text), text


def test_added_kinds_and_masks():
    text = 'see http://a.example/x?y token = "04dbebab91ab85687d33" or DE89370400440532013000, mail a.b@c.example now'
    assert [(k, text[s:e]) for k, s, e in pii.find(text)] == [("email", "a.b@c.example"), ("url", "http://a.example/x?y"), ("secret", "04dbebab91ab85687d33"), ("iban", "DE89370400440532013000")]
    assert pii.masked(text) == 'see http://a.example/x?y token = "<secret>" or <iban>, mail <email> now'
    assert pii.masked(None) is None and pii.masked("") == "" and pii.masked("plain") == "plain"


def test_pii_query_equals_brute_force(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = pii.op9_pii(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        want = base_items(docs[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in want).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in BASE] == [sum(w[0] == k for w in want) for k in BASE]


def test_pii_odd_rows(spark):
    docs = odd_docs(spark, ODD_ROWS)
    assert pii.find_pii(docs).count() == len(ODD_ROWS) and pii.find_pii(docs.where("false")).count() == 0
    assert pii.mask_pii(docs).columns == docs.columns


def like(glob, text):
    return re.fullmatch("".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob), text, re.S) is not None


def test_automaton_equals_globs_on_random_strings():
    rng = random.Random(2)
    globs = ["".join(rng.choice("abé*?") for _ in range(rng.randint(1, 9))) for _ in range(60)] + ["*", "a" * 70 + "*b", "*" + "ab" * 40]
    machine = urls.Automaton.of(globs)
    texts = ["".join(rng.choice("abé日") for _ in range(rng.randint(0, 14))) for _ in range(300)] + ["a" * 75 + "b", "b" + "ab" * 40, "é", "a日b"]
    offsets = np.cumsum([0] + [len(t.encode()) for t in texts])
    fits = machine.fits(np.frombuffer("".join(texts).encode(), np.uint8), offsets)
    for i, t in enumerate(texts):
        assert [bool(x) for x in fits[i]] == [like(g, t) for g in globs], t


def test_url_rules(spark):
    cases = {
        "https://WWW.Example.com/en/7?x": ("www.example.com", "/en/7", "example.com/en/7", "allow"),
        "https://notexample.com/en/8#t": ("notexample.com", "/en/8", "com/en/", "block"),
        "http://example.net/de/81": ("example.net", "/de/81", "example.net/de/8", "block"),
        "http://com/en/": ("com", "/en/", "com/en/", "block"),
        "http://x.org/a.com/en/1": ("x.org", "/a.com/en/1", None, "allow"),
        "http://x.org?/es/": ("x.org", "", None, "allow"),
        "http://cheap-pills.example.org/": ("cheap-pills.example.org", "/", None, "block"),
        "http://x.org/a\nb.exe": ("x.org", "/a\nb.exe", None, "block"),
        "no scheme": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        "http://" + "é" * 5000 + ".com/en/": ("é" * 5000 + ".com", "/en/", "com/en/", "block"),
        None: ("", "", None, "allow"),
    }
    rows = [(k, u, "x", "y") for k, u in enumerate(cases)] * 2
    df = spark.createDataFrame(rows, "page_id long, url string, host string, rule string")
    got = urls.judge(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r)[1:] == list(cases.values())[r["page_id"]]
    assert urls.judge(df.where("false")).count() == 0


def test_url_rules_are_those_of_the_contract(spark):
    assert dict(urls.RULES) == {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    cases = {
        "http://example.net/de/7": ("net/de/", "allow"),
        "http://a.net/de/x.exe": ("net/de/", "allow"),  # a rule goes before the general globs
        "http://cheap-pills.net/de/": ("net/de/", "allow"),
        "http://www.example.net/de/80": ("example.net/de/8", "block"),
        "http://a.org/es/1": ("org/es/", "block"),
    }
    df = spark.createDataFrame(list(enumerate(cases)), "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.judge(df).collect()}
    assert [got[k] for k in range(len(cases))] == list(cases.values())
