"""Toxicity by a classifier chain.

The categories are predicted in a fixed order. Each category's linear model sees the text's word
indicators (whole words, word beginnings), scaled by the category's log-count ratios so that a few
words count in a long text too, and the probabilities of the earlier categories. While fitting,
those are out-of-fold predictions, so that later models do not learn from overfitted ones.

The default chain over a labels table with ``quality`` and ``toxic`` is: junk (quality 0), toxic_prose
(toxic 1 in a text of quality 1), toxic (toxic 1), the last of which uses both before it. Others can
be given as SQL conditions.

Fitting takes at most about ``sample_rows`` labelled rows with about ``sample_features`` features in
all (documented bounds: what the driver holds); scoring reads every whole text. Null and blank texts
have no features. Rows with a null in a condition count as not in that category; labels without a
doc_id or of unknown documents are not learned from. A label or a text that one document has several
times counts once; different ones each count. Without labels nothing is toxic. Every row is scored,
those with a null or repeated doc_id too; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rallyframe.llm import linear
from rallyframe.llm.common import bounded_sample, crc_mod, table

SAMPLE_ROWS = 8000
SAMPLE_FEATURES = 12_000_000
CHAIN = {"junk": "quality = 0", "toxic_prose": "toxic = 1 AND quality = 1", "toxic": "toxic = 1"}
PREFIXES = (3, 5, 7)


def _features(column: pa.Array):
    return linear.features(pc.utf8_lower(column), PREFIXES)


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, owner, feature in _features(batch.column("text")):
            yield pa.record_batch([batch.column("doc_id").slice(lo, hi - lo), batch.column("marks").slice(lo, hi - lo), linear.feature_lists(owner, feature, hi - lo)], names=["doc_id", "marks", "features"])


def fit_chain(docs: DataFrame, labels: DataFrame, chain: dict[str, str] = CHAIN, sample_rows: int = SAMPLE_ROWS, sample_features: int = SAMPLE_FEATURES) -> list[linear.Linear]:
    """One model for each category, in the chain's order."""
    marks = F.array(*[F.coalesce(F.expr(c).cast("int"), F.lit(0)) for c in chain.values()])
    marked = bounded_sample(labels.where(F.col("doc_id").isNotNull()).select("doc_id", marks.alias("marks")), ["doc_id", "marks"], sample_rows)
    found = docs.select("doc_id", "text").join(F.broadcast(marked), "doc_id").select("doc_id", "marks", "text").mapInArrow(_feature_rows, "doc_id long, marks array<int>, features array<int>")
    got = bounded_sample(found, ["doc_id", "marks", "features"], sample_rows, "features", sample_features).select("marks", "features").toArrow()
    return fit_rows(*linear.training_rows(got, "marks"), categories=len(chain))


def fit_rows(y: np.ndarray, rows: list[np.ndarray], categories: int) -> list[linear.Linear]:
    """The chain's models from marks (one column for each category) and features of the rows."""
    y, dense, models = y if len(y) else np.zeros((0, categories), int), np.ones((len(rows), 1)), []
    for k in range(categories):
        model, out_of_fold = linear.fit(rows, dense, y[:, k], cost=8.0)
        models.append(model)
        dense = np.column_stack([dense, out_of_fold])
    return models


def score_chain(docs: DataFrame, models: list[linear.Linear], chain: dict[str, str] = CHAIN) -> DataFrame:
    """doc_id and the probability ``p_<category>`` of each category, for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(models)
    names = [f"p_{c}" for c in chain]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, owner, feature in _features(batch.column("text")):
                dense = np.ones((hi - lo, 1))
                for m in shared.value:
                    dense = np.column_stack([dense, m.probability(m.margins(owner, feature, hi - lo, dense))])
                yield pa.record_batch([batch.column("doc_id").slice(lo, hi - lo), *(pa.array(np.ascontiguousarray(c)) for c in dense.T[1:])], names=["doc_id", *names])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(score, "doc_id long, " + ", ".join(f"{n} double" for n in names))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: held_out, score (of the category toxic), predicted (score 0.5 or more), and the chain's probabilities."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    models = fit_chain(docs, labels.where(crc_mod("doc_id", 3) != 1))
    out = score_chain(docs, models)
    return out.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), F.col("p_toxic").alias("score"), (F.col("p_toxic") >= 0.5).cast("int").alias("predicted"), "p_junk", "p_toxic_prose")
