"""Streams of observations: latest ratings, idempotent merges, and which roster snapshots may retire members."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rallyframe.operators.merge import merge_latest

VERDICTS = "team_id long, url string, observed_at timestamp, verdict string"


def latest_ratings(stream: DataFrame) -> DataFrame:
    """The last observation for each player and source, kept up to date (output mode: update)."""
    last = F.max(F.struct("observed_on", "rating_id", "value")).alias("m")
    return stream.groupBy("player_id", "source").agg(last).select("player_id", "source", "m.*")


def snapshot_verdicts(stream: DataFrame) -> DataFrame:
    """Whether each roster snapshot (team_id, url, observed_at) may retire absent members.

    The first snapshot only sets the baseline; one not newer than the last applied is stale; one from
    another URL moves the baseline; the rest are trusted. In a batch, snapshots are taken in time order.
    """
    return stream.groupBy("team_id").applyInPandasWithState(_judge, VERDICTS, "observed_at timestamp, url string", "append", GroupStateTimeout.NoTimeout)


def _judge(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows = pd.concat(list(batches)).sort_values(["observed_at", "url"])
    at, url = state.get if state.exists else (None, None)
    said = []
    for r in rows.itertuples():
        if at is not None and r.observed_at <= at:
            verdict = "stale"
        else:
            verdict = "baseline" if url is None else "moved" if r.url != url else "trusted"
            at, url = r.observed_at, r.url
        said.append((key[0], r.url, r.observed_at, verdict))
    state.update((at, url))
    yield pd.DataFrame(said, columns=["team_id", "url", "observed_at", "verdict"])


def merge_into(path: str, keys: list[str], order: list[str], buckets: int = 64):
    """A ``foreachBatch`` function that merges each batch into the Parquet table at ``path``.

    The table lies in ``buckets`` folders by a hash of the key (a power of two near the table's size over the
    size of a file suits it; it must not change later). A batch reads and writes only the buckets of
    its own keys, and writes each as a whole. Running a batch again changes nothing, so one that was
    broken off between two buckets is simply run again.
    """

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        fresh = batch.withColumn("bucket", bucket)
        touched = [r["bucket"] for r in fresh.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
        if not touched:
            return
        there = spark._jvm.org.apache.hadoop.fs.Path(path)
        known = there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)
        stored = spark.read.schema(fresh.schema).parquet(path).where(F.col("bucket").isin(touched)) if known else fresh.limit(0)
        merged = merge_latest(stored, fresh, ["bucket", *keys], order)
        merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)

    return merge
