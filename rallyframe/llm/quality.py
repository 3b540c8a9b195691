"""Quality classifier: Naive Bayes support vectors.

Word n-gram indicators (tokens and pairs of neighbours, hashed) are scaled by the classes'
log-count ratios; a linear hinge-loss model on them is fitted by dual coordinate descent and
calibrated with out-of-fold margins.

Fitting takes at most about ``sample_rows`` labelled rows with about ``sample_features`` features in
all (documented bounds: what the driver holds); scoring reads every whole text in tasks. Null, empty
and blank texts have no features and get the score of the bare offset. Null labels and labels of
unknown documents are not learned from. A label or a text that one document has several times counts
once; different ones each count. An empty table gives no rows; without labels of both
classes the score is that of the only class (0 without any). Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rallyframe.llm import linear
from rallyframe.llm.common import bounded_sample, crc_mod, table

SAMPLE_ROWS = 8000
SAMPLE_FEATURES = 12_000_000


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, owner, feature in linear.features(batch.column("text"), pairs=True):
            yield pa.record_batch([batch.column("doc_id").slice(lo, hi - lo), batch.column("label").slice(lo, hi - lo), linear.feature_lists(owner, feature, hi - lo)], names=["doc_id", "label", "features"])


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = SAMPLE_ROWS, sample_features: int = SAMPLE_FEATURES) -> linear.Linear:
    """Learn from all of ``docs`` that ``labels`` marks, or from a sample within both bounds."""
    marked = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("label"))
    marked = bounded_sample(marked, ["doc_id", "label"], sample_rows)
    # The marked rows are few by their bound, so only their own documents' texts are moved.
    found = docs.select("doc_id", "text").join(F.broadcast(marked), "doc_id").select("doc_id", "label", "text").mapInArrow(_feature_rows, "doc_id long, label int, features array<int>")
    got = bounded_sample(found, ["doc_id", "label", "features"], sample_rows, "features", sample_features).select("label", "features").toArrow()
    y, rows = linear.training_rows(got, "label")
    return linear.fit(rows, np.ones((len(y), 1)), y[:, 0], cost=4.0, beta=0.9)[0]


def score_quality(docs: DataFrame, model: linear.Linear) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 if the score is 0.5 or more) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for lo, hi, owner, feature in linear.features(batch.column("text"), pairs=True):
                p = m.probability(m.margins(owner, feature, hi - lo, np.ones((hi - lo, 1))))
                yield pa.record_batch([batch.column("doc_id").slice(lo, hi - lo), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(score, "doc_id long, score double, predicted int")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit_quality(docs, labels.where(crc_mod("doc_id", 3) != 1))
    return score_quality(docs, model).select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", "predicted")
