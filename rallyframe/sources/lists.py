"""Ordered lists in text files: vocabularies with their reviews, stand-ins.

A line's place is its file, the block of the file that its task read, and its order in that task. What stands
before a line is looked up within its block; a block's first line gets the last line of the block before.
So a large file is read by many tasks and the rule about the preceding line holds where they meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rallyframe.functions import markup

REVIEW = r"(?i)^#\s*reviewed:\s*(.+)$"
SYNTHETIC = r"(?i)^#\s*reviewed\[synthetic\]:\s*(.+)$"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """file, block, place (in the block), line and before (the line before it in the file; null for the first), trimmed."""
    text = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), F.trim(F.regexp_replace("value", r"\s", " ")).alias("line"))
    inside = text.withColumn("__lag", F.lag("line").over(Window.partitionBy("file", "block").orderBy("place")))
    ends = text.groupBy("file", "block").agg(F.min("place").alias("place"), F.max_by("line", "place").alias("__last"))
    edges = ends.select("file", "block", "place", F.lag("__last").over(Window.partitionBy("file").orderBy("block")).alias("__edge"))
    return inside.join(edges, ["file", "block", "place"], "left").select("file", "block", "place", "line", F.coalesce("__lag", "__edge").alias("before"))


def _reason(line: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(line, pattern, 1), F.lit(""))


def vocabulary(listed: DataFrame, stand_ins: list[str] | None = None) -> DataFrame:
    """file, entry, review (synthetic, plain or null), reason and error of each entry of ``lines``.

    Lines that are empty or begin with ``#`` are no entries. A review counts for the line right behind it. Errors: an
    entry that stands twice in its file, one that is name-shaped without a review, one that is reviewed as
    synthetic but is not made of ``stand_ins`` alone, one of a class that must never be published.
    """
    entry = listed.where((F.col("line") != "") & ~F.col("line").startswith("#"))
    made, plain = _reason(F.col("before"), SYNTHETIC), _reason(F.col("before"), REVIEW)
    entry = entry.withColumn("review", F.when(made.isNotNull(), "synthetic").when(plain.isNotNull(), "plain")).withColumn("reason", F.coalesce(made, plain))
    copies = entry.groupBy("file", "line").agg(F.count("*").alias("copies"))
    held = F.lit(False)
    for pattern in markup.CLASSES.values():
        held = held | F.col("line").rlike(pattern)
    left = markup.skeleton(F.col("line"), stand_ins)
    error = (
        F.when(F.col("copies") > 1, "duplicate").when(markup.needs_review(F.col("line")) & F.col("review").isNull(), "needs a review")
        .when((F.col("review") == "synthetic") & (left != ""), "not synthetic").when(held, "personal data")
    )
    return entry.join(copies, ["file", "line"]).select("file", F.col("line").alias("entry"), "review", "reason", error.alias("error"))


def stand_ins(listed: DataFrame) -> DataFrame:
    """file and value of each line that is no comment and not empty; reviews are not asked for."""
    return listed.where((F.col("line") != "") & ~F.col("line").startswith("#")).select("file", F.col("line").alias("value"))
