"""Mixing sources to target weights by Pfair scheduling.

Each source's rows, in a fixed random order, are cut into blocks of ``block_rows``. Time is counted
in blocks. In a round a source with weight w gives w blocks (what is left, in its last round), and the
round has T slots, the sum over the sources that still have blocks. The source's j-th block of c
in the round is released at slot floor(j * T / c) and due by slot ceil((j + 1) * T / c); each
slot takes the released block with the earliest deadline. So at any time every source is less than
one block from its exact share among the sources that still have blocks, and each row stands in the
mix exactly once: when a source ends, the others go on at their weights.

Everything is DataFrame functions, for any number of sources:

1. Sources with the same number c of blocks in a round are one class: their j-th blocks have the same release
   and deadline, and take their slots in the order of the sources. So a round is scheduled class by class.
2. Rounds differ only where a source ends. Between two such rounds the classes have the same sizes (a shape);
   a shape is scheduled once, in one row of a number for each slot of a round.
3. The slot of a block follows by joins on the round, the class and the place in the class. No table of
   blocks, rounds or slots has more rows than the mix has blocks.
4. Rows are ranked within a source in two steps, by about sqrt(n) buckets of about sqrt(n) rows each by a hash of
   all columns, so a source with a third of all rows is not ordered in one task. A row that is repeated so often
   that it fills a bucket is counted, and its copies are dealt out to as many buckets as they need.

Running sums over the rounds at which sources end, and over chunks of slots, are made in one task: a few numbers
for each source and for each 4096 blocks.

A null source is a source of its own; null ids and repeated rows are placed like others (rows that
agree in every column are interchangeable). Sources without a given weight have the default weight.
Weights must be whole numbers from 1. An empty table gives no rows. Input columns that have the name
of a result column are replaced; all others are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rallyframe.llm.common import dropped, table, written

WEIGHTS = {"src0": 10, "src1": 8, "src2": 3}
DEFAULT_WEIGHT = 5
BLOCK_ROWS = 64
CHUNK = 4096


def _div(a: Column, b: Column) -> Column:
    return F.floor(a / b)


def _members(sources: DataFrame) -> DataFrame:
    """Sources (src, n, w, blocks) with full (rounds of w blocks), rem (blocks of its last, partial round), m (place in
    the class of w), alike (sources with the same partial round) and r (place among them)."""
    s = sources.withColumn("full", _div(F.col("blocks"), F.col("w"))).withColumn("rem", F.col("blocks") - F.col("full") * F.col("w"))
    # Sources that stay longest stand first, so that places do not change when others end.
    s = s.withColumn("m", (F.row_number().over(Window.partitionBy("w").orderBy(F.desc("full"), "src")) - 1).cast("long"))
    same = Window.partitionBy("full", "rem")
    return s.withColumn("alike", F.count("*").over(same)).withColumn("r", (F.row_number().over(same.orderBy("src")) - 1).cast("long"))


def _runs(members: DataFrame) -> DataFrame:
    """One row for each run of rounds with the same shape: first, until, shape (c and k, the number of sources with c blocks), slots and base (the slot it begins at)."""
    def change(at: Column, c: Column, by: int) -> Column:
        return F.struct(at.alias("at"), c.alias("c"), F.lit(by).alias("by"))

    full, rem, w = F.col("full"), F.col("rem"), F.col("w")
    zero = F.lit(0).cast("long")
    events = F.array(change(zero, w, 1), change(full, w, -1), change(full, rem, 1), change(full + 1, rem, -1))
    changes = members.select(F.inline(events)).where("c > 0").groupBy("c", "at").agg(F.sum("by").alias("by")).where("by <> 0")
    by_class = Window.partitionBy("c").orderBy("at")
    steps = changes.select("c", "at", F.sum("by").over(by_class).alias("k"), F.lead("at").over(by_class).alias("next"))
    cuts = changes.select("at").distinct().withColumn("i", F.row_number().over(Window.orderBy("at")))
    held = steps.where("k > 0").join(cuts, "at").join(cuts.select(F.col("at").alias("next"), F.col("i").alias("j")), "next")
    shapes = held.select("c", "k", F.explode(F.sequence(F.col("i"), F.col("j") - 1)).alias("i")).groupBy("i").agg(F.array_sort(F.collect_list(F.struct("c", "k"))).alias("shape"))
    slots = F.aggregate("shape", zero, lambda a, x: a + x.c * x.k)
    ends = cuts.select("i", F.col("at").alias("first"), F.lead("at").over(Window.orderBy("at")).alias("until"))
    runs = ends.join(shapes, "i").withColumn("slots", slots)
    base = F.sum((F.col("until") - F.col("first")) * F.col("slots")).over(Window.orderBy("i").rowsBetween(Window.unboundedPreceding, -1))
    return runs.withColumn("base", F.coalesce(base, zero))


def _earliest_deadline_first(shape: Column, slots: Column) -> Column:
    """The index of the class that each slot of a round takes."""
    state = F.transform(shape, lambda _: F.lit(0).cast("long"))
    none = F.expr("CAST(array() AS array<int>)")

    def step(acc: Column, slot: Column) -> Column:
        def ready(x: Column, i: Column) -> Column:
            done = F.get(acc.done, i)
            j = _div(done, x.k)
            return F.when((done < x.c * x.k) & (_div(j * slots, x.c) <= slot), F.struct(F.ceil((j + 1) * slots / x.c).alias("deadline"), i.alias("i")))

        chosen = F.array_min(F.transform(shape, ready)).i
        done = F.transform(acc.done, lambda d, i: d + F.when(i == chosen, 1).otherwise(0))
        return F.struct(done.alias("done"), F.concat(acc.order, F.array(chosen)).alias("order"))

    # Slots are taken in stretches of about sqrt(slots), so that little is copied for each of them.
    width = F.ceil(F.sqrt(slots)).cast("long")

    def stretch(acc: Column, start: Column) -> Column:
        part = F.aggregate(F.sequence(start, F.least(start + width, slots) - 1), F.struct(acc.done.alias("done"), none.alias("order")), step)
        return F.struct(part.done.alias("done"), F.concat(acc.order, part.order).alias("order"))

    return F.aggregate(F.sequence(F.lit(0).cast("long"), slots - 1, width), F.struct(state.alias("done"), none.alias("order")), stretch, lambda acc: acc.order)


def _schedule(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rounds (turn, sid, shape, slots, base) and the schedule of each shape (sid, c, t: the t-th slot of the class, at)."""
    ids = runs.groupBy("shape").agg(F.min("i").alias("sid"), F.first("slots").alias("slots"))
    taken = ids.select("sid", "shape", F.posexplode(_earliest_deadline_first(F.col("shape"), F.col("slots"))).alias("at", "i"))
    turn = Window.partitionBy("sid", "i").orderBy("at")
    schedule = taken.select("sid", F.get("shape", F.col("i")).c.alias("c"), (F.row_number().over(turn) - 1).cast("long").alias("t"), F.col("at").cast("long").alias("at"))
    rounds = runs.join(ids.select("shape", "sid"), "shape").select("sid", "shape", "slots", "first", "base", F.explode(F.sequence("first", F.col("until") - 1)).alias("turn"))
    return rounds.select("turn", "sid", "shape", (F.col("base") + (F.col("turn") - F.col("first")) * F.col("slots")).alias("base")), schedule


def _slots(blocks: DataFrame, members: DataFrame, runs: DataFrame, block_rows: int) -> DataFrame:
    """src, block, slot (counted over all rounds) and start (rows before it in the mix) of the distinct blocks."""
    rounds, schedule = _schedule(runs)
    b = blocks.select("src", "block").distinct().join(members, "src").withColumn("turn", _div(F.col("block"), F.col("w"))).join(rounds, "turn")
    whole = F.col("turn") < F.col("full")
    c, j = F.when(whole, F.col("w")).otherwise(F.col("rem")), F.col("block") - F.col("turn") * F.col("w")
    b = b.withColumn("c", c).withColumn("k", F.get(F.filter("shape", lambda x: x.c == F.col("c")), F.lit(0)).k)
    # In a class the sources with further rounds stand before those that end with this one.
    place = F.when(whole, F.col("m")).otherwise(F.col("k") - F.col("alike") + F.col("r"))
    b = b.withColumn("t", j * F.col("k") + place).join(schedule, ["sid", "c", "t"])
    lack = F.when(F.col("block") == F.col("blocks") - 1, F.col("blocks") * block_rows - F.col("n")).otherwise(F.lit(0))
    b = b.select("src", "block", (F.col("base") + F.col("at")).alias("slot"), lack.alias("lack")).withColumn("chunk", _div(F.col("slot"), F.lit(CHUNK)))
    b = written(b, "slots")
    before = F.sum("lack").over(Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    chunks = b.groupBy("chunk").agg(F.sum("lack").alias("lack")).select("chunk", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.sum("lack").over(Window.partitionBy("chunk").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1))
    lacking = F.col("before") + F.coalesce("inside", F.lit(0))
    return b.withColumn("inside", inside).join(chunks, "chunk").select("src", "block", "slot", (F.col("slot") * block_rows - lacking).alias("start"))


def _dealt(docs: DataFrame, sources: DataFrame, name: Column, columns: list[str], key: str) -> tuple[DataFrame, DataFrame]:
    """src, h, tie, bucket and row of every row, and src, bucket and m (rows); copies of a row that would fill a bucket are dealt out."""
    maps = {c for c, kind in docs.dtypes if kind.startswith("map")}
    hashed = [F.map_entries(f"`{c}`") if c in maps else F.col(f"`{c}`") for c in columns]
    row = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row")
    sizes = sources.select("src", F.ceil(F.sqrt("n")).alias("buckets"))
    rows = docs.select(name.alias("src"), F.xxhash64(F.col(key).cast("string"), F.xxhash64(*hashed)).alias("h"), F.xxhash64(*hashed).alias("tie"), row)
    rows = rows.join(sizes, "src").withColumn("bucket", F.pmod("h", "buckets"))
    sized = written(rows.groupBy("src", "bucket", "buckets").agg(F.count("*").alias("m")), "sized")
    full = sized.where(F.col("m") > 4 * F.col("buckets") + 1000).select("src", "bucket")
    if full.isEmpty():
        return rows.drop("buckets"), sized.select("src", "bucket", "m")
    often = rows.join(full, ["src", "bucket"], "leftsemi").groupBy("src", "buckets", "h", "tie").agg(F.count("*").alias("m")).where(F.col("m") > F.col("buckets")).select("src", "h", "tie")
    often = written(often, "often")
    dropped(sized)
    same = [F.map_entries(f"row.`{c}`").alias(f"__rf_{k}") if c in maps else F.col(f"row.`{c}`").alias(f"__rf_{k}") for k, c in enumerate(columns)]
    copies = rows.join(often, ["src", "h", "tie"]).groupBy("src", "buckets", "h", "tie", *same).agg(F.count("*").alias("m"))
    back = [(F.map_from_entries(f"__rf_{k}") if c in maps else F.col(f"__rf_{k}")).alias(c) for k, c in enumerate(columns)]
    # As many copies as a bucket holds go to a bucket each.
    parts = copies.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / F.col("buckets")))))
    parts = parts.withColumn("mine", F.least(F.col("buckets"), F.col("m") - F.col("part") * F.col("buckets"))).withColumn("bucket", F.pmod(F.xxhash64("h", "part"), F.col("buckets")))
    parts = parts.repartition("src", "bucket").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("mine"))))
    others = rows.join(often, ["src", "h", "tie"], "leftanti")
    dealt = others.select("src", "h", "tie", "bucket", "row").union(parts.select("src", "h", "tie", "bucket", F.struct(*back).alias("row")))
    return dealt, dealt.groupBy("src", "bucket").agg(F.count("*").alias("m"))


def mix_sources(docs: DataFrame, weights: dict[str, int] = WEIGHTS, default_weight: int = DEFAULT_WEIGHT, block_rows: int = BLOCK_ROWS, source: str = "source", key: str = "doc_id") -> DataFrame:
    """All rows and columns with mix_block (within the source), mix_slot (of all blocks) and mix_position (of all rows, from 0)."""
    if default_weight < 1 or any(w < 1 or w != int(w) for w in weights.values()) or block_rows < 1:
        raise ValueError("weights and block_rows must be whole numbers from 1")
    name = F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n"))
    weight = F.lit(int(default_weight))
    for k, v in sorted(weights.items()):
        weight = F.when(F.col("src") == "s" + k, F.lit(int(v))).otherwise(weight)
    sources = docs.groupBy(name.alias("src")).agg(F.count("*").alias("n")).withColumn("w", weight.cast("long")).withColumn("blocks", F.ceil(F.col("n") / block_rows))
    sources = written(sources, "sources")
    members = written(_members(sources), "members")
    runs = written(_runs(members), "runs")

    columns = [c for c in docs.columns if c.lower() not in ("mix_block", "mix_slot", "mix_position")]
    rows, sized = _dealt(docs, sources, name, columns, key)
    before = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counted = written(sized.select("src", "bucket", "m", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("offset")), "counted")
    touched = F.sequence(_div(F.col("offset"), F.lit(block_rows)), _div(F.col("offset") + F.col("m") - 1, F.lit(block_rows)))
    blocks = counted.select("src", "bucket", "offset", F.explode(touched).alias("block"))
    placed = blocks.join(_slots(blocks, members, runs, block_rows), ["src", "block"])
    # A bucket's blocks are few: about sqrt(n) / block_rows.
    placed = placed.groupBy("src", "bucket", "offset").agg(F.array_sort(F.collect_list(F.struct("block", "slot", "start"))).alias("blocks"))
    placed = written(placed, "placed")
    dropped(members, runs, counted)

    ranked = rows.join(placed, ["src", "bucket"]).withColumn("at", F.col("offset") + F.row_number().over(Window.partitionBy("src", "bucket").orderBy("h", "tie")) - 1)
    ranked = ranked.withColumn("mix_block", _div(F.col("at"), F.lit(block_rows)))
    here = F.get("blocks", (F.col("mix_block") - F.get("blocks", F.lit(0)).block).cast("int"))
    return ranked.select("row.*", "mix_block", here.slot.alias("mix_slot"), (here.start + F.col("at") % block_rows).alias("mix_position"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))
