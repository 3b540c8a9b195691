"""What holds as of a day, over a span of days, and over several groupings at once.

No window here holds all rows of one key: as-of joins cut a key's time into buckets and carry one value from bucket
to bucket, frames run over a key's days, not its rows, and quantiles over the buckets of a sketch.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_DAYS = 28


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, since: str, order: list[str], values: list[str], bucket_days: int = BUCKET_DAYS) -> DataFrame:
    """``left`` with the ``values`` that ``right`` has for its key as of its day ``at``: those of the last row with ``since`` no later, on one day the last by ``order``.

    Nulls where there is none, or where a key or day is null. Repeated rows of ``left`` stay.
    """
    daily = right.where(F.col(key).isNotNull() & F.col(since).isNotNull()).groupBy(key, F.col(since).alias("__day")).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("__v"))
    row = F.struct(*[F.col(c) for c in left.columns]).alias("__row")
    asked = left.select(key, F.col(at).alias("__day"), row)
    kind = daily.schema["__v"].dataType
    both = daily.select(key, "__day", "__v", F.lit(None).cast(asked.schema["__row"].dataType).alias("__row")).unionByName(asked.select(key, "__day", F.lit(None).cast(kind).alias("__v"), "__row"))
    both = both.withColumn("__b", F.floor(F.unix_date("__day") / bucket_days))
    inside = F.last("__v", ignorenulls=True).over(Window.partitionBy(key, "__b").orderBy("__day", F.col("__v").isNull()).rowsBetween(Window.unboundedPreceding, 0))
    buckets = both.groupBy(key, "__b").agg(F.max_by("__v", F.when(F.col("__v").isNotNull(), F.col("__day"))).alias("__last"))
    before = F.last("__last", ignorenulls=True).over(Window.partitionBy(key).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    carried = buckets.select(key, "__b", before.alias("__before"))
    found = both.withColumn("__inside", inside).where("__row IS NOT NULL")
    found = found.alias("f").join(carried.alias("c"), (F.col(f"f.{key}") == F.col(f"c.{key}")) & (F.col("f.__b") == F.col("c.__b")), "left")
    said = F.when(F.col(f"f.{key}").isNotNull() & F.col("f.__day").isNotNull(), F.coalesce("__inside", "__before"))
    return found.select("__row.*", said.alias("__said")).select(*left.columns, *[F.col(f"__said.{v}").alias(v) for v in values])


def form(rows: DataFrame, days: int = 90) -> DataFrame:
    """player_id and day: matches played and won on it and in the ``days`` days before it, and days since the last match.

    ``rows``: player_id, played_on, winner_side, side. Undated matches are left out. The frames run over each player's days.
    """
    won = F.count(F.when(F.col("winner_side") == F.col("side"), 1))
    daily = rows.where("played_on IS NOT NULL").groupBy("player_id", F.col("played_on").alias("day")).agg(F.count("*").alias("played"), won.alias("won"))
    by_day = Window.partitionBy("player_id").orderBy(F.unix_date("day"))
    span = by_day.rangeBetween(-days, -1)
    before = lambda c: F.coalesce(F.sum(c).over(span), F.lit(0)).alias(f"{c}_before")
    rest = F.datediff("day", F.lag("day").over(by_day)).alias("rest_days")
    return daily.select("player_id", "day", "played", "won", before("played"), before("won"), rest)


def grouped_records(rows: DataFrame, sets: list[list[str]], columns: list[str]) -> DataFrame:
    """Matches, wins and losses for each of several groupings of ``columns`` in one pass; ``level`` has a bit for each column that is left out, the last one lowest."""
    wins = F.count(F.when(F.col("winner_side") == F.col("side"), 1)).alias("wins")
    losses = F.count(F.when(F.col("winner_side") != F.col("side"), 1)).alias("losses")
    return rows.groupingSets(sets, *columns).agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("matches"), wins, losses)


def quantile_sketch(rows: DataFrame, by: list[str], value: str, error: float = 0.01) -> DataFrame:
    """A mergeable sketch: for each group, sign and bucket of the value's logarithm the number of rows.

    ``error``: how far a quantile of the sketch may be from the true one, relative to it. Sketches of the
    same error are merged by ``merge_sketches``. Nulls and NaN are left out.
    """
    gamma = (1 + error) / (1 - error)
    v = F.col(value).cast("double")
    bucket = F.when(v == 0, 0).otherwise(F.ceil(F.log(F.abs(v)) / log(gamma))).cast("long")
    kept = rows.where(v.isNotNull() & ~F.isnan(v))
    return kept.groupBy(*by, F.signum(v).cast("int").alias("sign"), bucket.alias("bucket")).agg(F.count("*").alias("n"))


def merge_sketches(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Sketches added up to coarser groups."""
    return sketches.groupBy(*by, "sign", "bucket").agg(F.sum("n").alias("n"))


def sketch_quantiles(sketch: DataFrame, by: list[str], quantiles: list[float], error: float = 0.01) -> DataFrame:
    """For each group and q the value whose rank is the first of at least q * n: within ``error`` of the true one."""
    gamma = (1 + error) / (1 - error)
    middle = F.col("sign") * 2 * F.pow(F.lit(gamma), F.col("bucket")) / (gamma + 1)
    order = Window.partitionBy(*by).orderBy("sign", F.col("sign") * F.col("bucket"))
    placed = sketch.withColumn("upto", F.sum("n").over(order)).withColumn("all", F.sum("n").over(Window.partitionBy(*by)))
    asked = placed.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in quantiles])))
    wanted: Column = F.greatest(F.ceil(F.col("q") * F.col("all")), F.lit(1))
    return asked.where((F.col("upto") >= wanted) & (F.col("upto") - F.col("n") < wanted)).select(*by, "q", F.col("all").alias("n"), middle.alias("value"))
