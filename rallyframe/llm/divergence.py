"""Audit of how the sources of each language differ, by ranking cells of counts.

A term is a run of A-Z, a-z and code points above 127; A-Z is lower-cased. A language keeps the V terms that
at least ``least_documents`` of its documents (rows) hold. In each group (language, source), and in each
language, a kept term that occurs ``count`` times has p = 1 + floor(10^9 (count + 2) / (N + 2 V)), N the
count's sum over kept terms. Two values p and q differ by f = floor((p - q)^2 / (p + q)).

f depends on a term by its two counts alone, so terms are grouped into cells of equal counts and f is
evaluated once for each cell:

* Terms of a group (``top_terms``): cells (count in the group, count in the language) with p > q. Cells of
  equal f are merged; in order of f, a running sum of how many terms they hold tells which cells
  reach the asked ranks. Only terms of those cells are looked up and ordered by their UTF-8 bytes.
* Pairs of sources of a language (``pair_sums``): cells (count here, count there) with the number of terms.
  Terms that one side lacks need no rows: how many there are of each count follows from the cells of the
  group alone, less those that both hold.

Longs hold all but 10^9 (count + 2), which is a decimal. Nulls in text, lang or source are empty texts;
doc_id is not used. Every group that occurs is in the pairs, also without terms; with V = 0 a value is 0.
Repeated rows are documents of their own. Whole texts are read, in pieces of bounded size. Extra columns
are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rallyframe.llm.common import dropped, small, table, written

LEAST_DOCUMENTS = 10
RANKS = 10
SCALE = 1_000_000_000
HELD = 100_000
PIECE = 1 << 20
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, repeats included, in lists of about ``PIECE`` bytes of text."""
    at = 0
    while at < len(text):
        end = at + PIECE
        piece = text[at:end].translate(_LETTERS)
        while end < len(text) and piece[-1:] != b" ":  # up to the end of the term that is cut
            more = text[end : end + 64].translate(_LETTERS).partition(b" ")
            piece += more[0] + more[1]
            end += len(more[0]) + len(more[1])
        yield piece.split()
        at = end


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and documents (rows that hold it)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0

        def out() -> pa.RecordBatch:
            rows = [(lang, source, t, n, documents[t]) for (lang, source), (counts, documents) in held.items() for t, n in counts.items()]
            kinds = (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64())
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 5, kinds)], names=["lang", "source", "term", "n", "documents"])

        for batch in batches:
            for rows in small(pa.Table.from_batches([batch]).combine_chunks().to_batches(), 64):
                for lang, source, text in zip(*(rows.column(k).to_pylist() for k in ("lang", "source", "text"))):
                    counts, documents = held.setdefault((lang, source), (Counter(), Counter()))
                    before, here = len(counts), set()
                    for found in terms(text):
                        counts.update(found)
                        here.update(found)
                    documents.update(here)
                    size += len(counts) - before + 1
                    if size > HELD:
                        yield out()
                        held.clear()
                        size = 0
        yield out()

    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")], F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    found = texts.mapInArrow(scan, "lang string, source string, term binary, n long, documents long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents")).withColumn("term", F.col("term").cast("string"))


def _whole(a: Column, b: Column) -> Column:
    """The whole part of a / b as a long; null if b is 0."""
    return F.call_function("div", a, F.when(b != 0, b))


def _p(count: Column | str, total: str, kept: str = "kept") -> Column:
    count = F.col(count) if isinstance(count, str) else count
    return 1 + _whole(F.lit(SCALE).cast("decimal(10,0)") * (count + 2).cast("decimal(20,0)"), (F.col(total) + 2 * F.col(kept)).cast("decimal(20,0)"))


def _f(p: Column, q: Column) -> Column:
    return _whole((p - q) * (p - q), p + q)


def kept_counts(counts: DataFrame, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """lang, source, term, n and lang_n (occurrences in the language) of the kept terms."""
    kept = counts.groupBy("lang", "term").agg(F.sum("documents").alias("documents"), F.sum("n").alias("lang_n")).where(F.col("documents") >= least_documents)
    return counts.select("lang", "source", "term", "n").join(kept.select("lang", "term", "lang_n"), ["lang", "term"])


def group_totals(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source, total (N), held (kept terms that occur), lang_total, kept (V) of every group that occurs."""
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    groups = docs.select(*named).distinct()
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("held"))
    langs = kept.groupBy("lang", "term").agg(F.first("lang_n").alias("n")).groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count("*").alias("kept"))
    return groups.join(own, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0)


def top_terms(kept: DataFrame, groups: DataFrame, ranks: int = RANKS) -> DataFrame:
    """lang, source, item, value and rank of the terms that a group has more of than its language."""
    cells = kept.groupBy("lang", "source", "n", "lang_n").agg(F.count("*").alias("terms")).join(groups, ["lang", "source"])
    cells = cells.withColumn("p", _p("n", "total")).withColumn("q", _p("lang_n", "lang_total")).where("p > q")
    cells = cells.select("lang", "source", "n", "lang_n", "terms", _f(F.col("p"), F.col("q")).alias("value"))
    # Each value has a term at least, so only the first values of a group can reach the ranks.
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
    merged = cells.groupBy("lang", "source", "value").agg(F.sum("terms").alias("terms")).withColumn("place", F.row_number().over(by_value)).where(F.col("place") <= ranks)
    before = F.sum("terms").over(by_value.rowsBetween(Window.unboundedPreceding, -1))
    reached = merged.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < ranks).select("lang", "source", "value")
    wanted = cells.join(reached, ["lang", "source", "value"]).select("lang", "source", "n", "lang_n", "value")
    found = kept.join(wanted, ["lang", "source", "n", "lang_n"]).select("lang", "source", F.col("term").alias("item"), "value")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    return ranked.where(F.col("rank") <= ranks)


def pair_sums(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item (each other source of the language), value and rank."""
    one = groups.select("lang", "kept", F.col("source").alias("a"), F.col("total").alias("a_total"), F.col("held").alias("a_held"))
    two = groups.select("lang", F.col("source").alias("b"), F.col("total").alias("b_total"), F.col("held").alias("b_held"))
    zero = F.lit(0).cast("long")

    # Terms of both, as cells of two counts. What the sums below say of them as terms of one side is taken off.
    mine, other = (kept.select("lang", "term", F.col("source").alias(x), F.col("n").alias(f"{x}_n")) for x in "ab")
    cells = mine.join(other, ["lang", "term"]).where("a < b").groupBy("lang", "a", "b", "a_n", "b_n").agg(F.count("*").alias("terms"))
    cells = cells.join(one, ["lang", "a"]).join(two, ["lang", "b"])
    said = _f(_p("a_n", "a_total"), _p("b_n", "b_total")) - _f(_p("a_n", "a_total"), _p(zero, "b_total")) - _f(_p(zero, "a_total"), _p("b_n", "b_total"))
    both = cells.groupBy("lang", "a", "b").agg(F.sum(F.col("terms") * said).alias("both"), F.sum("terms").alias("shared"))

    # Terms of one side, as if the other had none of them.
    counts = kept.groupBy("lang", F.col("source").alias("a"), F.col("n").alias("a_n")).agg(F.count("*").alias("terms"))
    alone = counts.join(one, ["lang", "a"]).join(two, "lang").where("a <> b").groupBy("lang", "a", "b").agg(F.sum(F.col("terms") * _f(_p("a_n", "a_total"), _p(zero, "b_total"))).alias("alone"))
    back = alone.select("lang", F.col("a").alias("b"), F.col("b").alias("a"), F.col("alone").alias("alone_b"))

    pairs = one.join(two, "lang").where("a < b").join(both, ["lang", "a", "b"], "left").join(alone, ["lang", "a", "b"], "left").join(back, ["lang", "a", "b"], "left").fillna(0, ["both", "shared", "alone", "alone_b"])
    neither = (F.col("kept") - F.col("a_held") - F.col("b_held") + F.col("shared")) * _f(_p(zero, "a_total"), _p(zero, "b_total"))
    value = F.col("both") + F.col("alone") + F.col("alone_b") + F.coalesce(neither, zero)
    sides = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))
    found = pairs.select("lang", value.alias("value"), F.inline(sides)).select("lang", "source", "item", "value")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def divergence(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, ranks: int = RANKS) -> DataFrame:
    """lang, source, part (pair or term), item, value and rank."""
    counts = written(term_counts(docs), "counts")
    kept = written(kept_counts(counts, least_documents), "kept")
    groups = written(group_totals(docs, kept), "groups")
    dropped(counts)
    pairs, terms_ = pair_sums(kept, groups), top_terms(kept, groups, ranks)
    return pairs.withColumn("part", F.lit("pair")).unionByName(terms_.withColumn("part", F.lit("term"))).select("lang", "source", "part", "item", "value", "rank")


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS lang_n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY lang, source, term),
x AS (SELECT g.lang, g.source, k.term, k.lang_n, CAST(coalesce(c.n, 0) AS HUGEINT) AS n FROM g JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
y AS (SELECT *, count(*) OVER (PARTITION BY lang, source) AS v, sum(n) OVER (PARTITION BY lang, source) AS total, sum(lang_n) OVER (PARTITION BY lang, source) AS lang_total FROM x),
z AS (SELECT lang, source, term, n, 1 + (1000000000 * (n + 2)) // CAST(total + 2 * v AS HUGEINT) AS p, 1 + (1000000000 * (lang_n + 2)) // CAST(lang_total + 2 * v AS HUGEINT) AS q FROM y),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM z a JOIN z b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, b.source AS item, CAST(coalesce(p.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source),
t AS (SELECT lang, source, term AS item, CAST((p - q) * (p - q) // (p + q) AS BIGINT) AS value FROM z WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM every
UNION ALL
SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM t) WHERE rank <= 10
"""
