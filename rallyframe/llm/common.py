"""What the operators of this subpackage share: tables, scratch tables and hold-out rules."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's ``spark.checkpoint.dir``. Only where that is unset and the master is local
    (a test) a temporary folder is taken and set; on a cluster no folder is guessed.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/rallyframe/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written as Parquet to the shared folder and read again.

    This cuts the lineage: what was written survives the loss of any executor.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def dropped(*frames: DataFrame) -> None:
    """Delete the tables of ``written`` frames that nothing reads any more."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._scratch)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def small(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, so that few texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def crc_mod(col: Column | str, modulus: int) -> Column:
    """crc32 of the value as text, modulo ``modulus``; a null counts as the empty text."""
    c = F.col(col) if isinstance(col, str) else col
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit(""))), F.lit(modulus))


def bounded_sample(df: DataFrame, columns: list[str], rows: int, values: str | None = None, most_values: int = 0) -> DataFrame:
    """Rows of ``df``, distinct in ``columns``: all, or if that is more, about ``rows`` of them whose arrays ``values`` hold about ``most_values`` elements.

    They are picked by a hash of ``columns``. Only for fitting models: what reaches one process is
    small at any input size, however often a row is repeated and however long the arrays are.
    """
    row = "__rf_row"
    once = df.withColumn(row, F.xxhash64(*columns, F.lit(97))).dropDuplicates([row])
    if values:
        once = written(once, "sample")
    found = once.agg(F.count("*").alias("n"), F.sum(F.size(values) if values else F.lit(0)).alias("v")).first()
    share = min(1.0, rows / max(1, found["n"]), most_values / max(1, found["v"] or 0) if values else 1.0)
    if share < 1:
        once = once.where(F.pmod(row, F.lit(1 << 30)) < int((1 << 30) * share))
    return once.drop(row)
