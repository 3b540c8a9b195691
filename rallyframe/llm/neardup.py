"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

A document's set holds its distinct shingles of ``shingle`` words (words: runs of bytes other than
ASCII white space, A-Z lower-cased); with fewer words the whole sequence is the one shingle; without
words the set is empty and linked with nothing. Two documents are linked if their sets' Jaccard
similarity is at least ``per_cent`` / 100; links are confirmed on full sets of 64-bit hashes.

Sketch: in round i < t every element is thrown into a bin by a hash of the round, with value
i + fraction; in round t + b every element goes to bin b. A bin keeps its least value, and the rounds
end once all t bins are full, so each coordinate fills and agrees with the similarity as its
probability. ``rows`` coordinates make a band key; equal keys make candidates.

Recall: a linked pair shares no band with probability at most (1 - s^rows)^bands, at the threshold
s: 1.2e-5 for s = 0.85 with 6 rows and 24 bands, 7e-6 for s = 0.8 with 5 rows and 30 bands.

Candidates are not expanded into pairs:

1. Equal sets form a class; its smallest doc_id and its set stand for it from here on.
2. In each bucket (band key) every member is compared with the bucket's smallest id only.
3. Connected components of the links so far. A bucket whose other members already lie in one
   component is done: no further comparison could change anything.
4. Members of very large open buckets are dealt out again, by keys of twice as many coordinates and so
   many bands that the chance to miss a linked pair is no larger, which splits off what is alike by
   much less than asked. Buckets of one component are done; in the others each member is compared
   with the smallest id.
5. Members of the buckets that are open still are compared inside tasks, only across components, in
   blocks of about ``block`` members (a larger bucket is dealt out as pairs of blocks, so no pair is
   lost and no task holds more than two blocks; blocks of one component only do not meet); a task
   returns links that join components, not pairs.
6. Components of all links.

Nulls: a null text is an empty set; a null doc_id is in no component and kept. A doc_id is one
document however many rows it has: all its texts are compared, what any of them is linked with is in
its component, and each row shows its own set's size. Extra columns are ignored. An empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rallyframe.llm.common import dropped, small, table, written
from rallyframe.llm.graph import components
from rallyframe.llm.text import LOWER, SPACE, U64, arrow_list, doc_of, mix, slices, span_hashes, spans

BLOCK = 500
SALTS = (0xA1, 0xB2)


def shingle_sets(column: pa.Array, shingle: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, sorted distinct shingle hashes, pointers of the rows into them)."""
    for lo, hi, data, offsets in slices(column):
        data = LOWER[data]
        starts, ends = spans(~SPACE[data], offsets)
        words, docs = span_hashes(data, starts, ends), doc_of(starts, offsets)
        n = np.bincount(docs, minlength=hi - lo)
        hashes, owners = [], []
        if len(words) >= shingle:
            m = len(words) - shingle + 1
            h = words[:m].copy()
            for k in range(1, shingle):
                h = mix(h) * U64(3) + words[k : k + m]
            one = docs[:m] == docs[shingle - 1 :]
            hashes.append(mix(h[one]))
            owners.append(docs[:m][one])
        first = np.cumsum(n) - n
        for d in np.flatnonzero((n > 0) & (n < shingle)):
            h = words[first[d] : first[d] + 1].copy()
            for k in range(1, n[d]):
                h = mix(h) * U64(3) + words[first[d] + k]
            hashes.append(mix(h ^ U64(0x5555 + n[d])))
            owners.append(np.array([d]))
        h = np.concatenate(hashes) if hashes else np.zeros(0, U64)
        o = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        order = np.lexsort((h, o))
        h, o = h[order], o[order]
        keep = np.ones(len(h), bool)
        keep[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
        h, o = h[keep], o[keep]
        yield lo, hi, h, np.searchsorted(o, np.arange(hi - lo + 1))


def sketches(hashes: np.ndarray, pointers: np.ndarray, t: int) -> np.ndarray:
    """A fast similarity sketch of t coordinates for each set (zeros for an empty one)."""
    n = len(pointers) - 1
    size = np.diff(pointers)
    out = np.full((n, t), np.iinfo(U64).max, U64)
    flat = out.reshape(-1)
    live = np.flatnonzero(size > 0)
    for i in range(2 * t):
        if not len(live):
            break
        # the elements of the sets that still have an empty bin
        counts = size[live]
        owner = np.repeat(live, counts)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(pointers[live], counts)
        h = mix(hashes[at] ^ mix(np.array([i + 1], U64)))
        bins = (((h >> U64(32)) * U64(t)) >> U64(32)).astype(np.int64) if i < t else np.full(len(h), i - t)
        value = (U64(i) << U64(40)) | (mix(h) >> U64(24))
        np.minimum.at(flat, owner * t + bins, value)
        live = live[(out[live] == np.iinfo(U64).max).any(1)]
    out[size == 0] = 0
    return out


def band_keys(sketch: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """One key for each band of each sketch."""
    sketch = sketch.reshape(len(sketch), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=U64), (len(sketch), bands)).copy()
    for r in range(rows):
        key = mix(key * U64(3) + sketch[:, :, r])
    return key


def sketch_table(docs: DataFrame, shingle: int, rows: int, bands: int) -> DataFrame:
    """doc_id, n (set size), fp1 and fp2 (128 bits that stand for the set), bands (keys)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, h, ptr in shingle_sets(batch.column("text"), shingle):
                n = np.diff(ptr)
                fps = [fingerprints(h, ptr, s) for s in SALTS]
                key = band_keys(sketches(h, ptr, rows * bands), rows, bands)
                has = n > 0
                at = np.concatenate([[0], np.cumsum(np.where(has, bands, 0))])
                keys = arrow_list(key[has].reshape(-1).view(np.int64), at, pa.int64())
                yield pa.record_batch([batch.column("doc_id").slice(lo, hi - lo), pa.array(n.astype(np.int64)), pa.array(fps[0]), pa.array(fps[1]), keys], names=["doc_id", "n", "fp1", "fp2", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, fp1 long, fp2 long, bands array<long>")


def fingerprints(hashes: np.ndarray, pointers: np.ndarray, salt: int) -> np.ndarray:
    """64 bits that stand for each set."""
    sums = np.append(U64(0), np.cumsum(mix(hashes ^ U64(salt))))
    return (sums[pointers[1:]] - sums[pointers[:-1]]).view(np.int64)


def set_table(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, v (the set's first fingerprint) and the set of hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, h, ptr in shingle_sets(batch.column("text"), shingle):
                yield pa.record_batch([batch.column("doc_id").slice(lo, hi - lo), pa.array(fingerprints(h, ptr, SALTS[0])), arrow_list(h.view(np.int64), ptr, pa.int64())], names=["doc_id", "v", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, v long, shingles array<long>")


def joining_links(ids: np.ndarray, comps: np.ndarray, sets: list[np.ndarray], per_cent: int) -> list[tuple[int, int]]:
    """Links that join different components of the members, found by comparing across components only.

    Every member outside the largest component is compared with all members that are in other
    components by then, so each two components have been compared.
    """
    size = np.array([len(s) for s in sets])
    at = np.cumsum(size) - size
    words, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(len(words), bool)
    names, comps = np.unique(comps, return_inverse=True)
    members = np.bincount(comps)
    begun, found = comps.copy(), []
    for name in np.argsort(members, kind="stable")[:-1]:
        for p in np.flatnonzero(begun == name):
            other = comps != comps[p]
            other &= (100 * np.minimum(size, size[p]) >= per_cent * np.maximum(size, size[p]))
            if not other.any():
                continue
            mine = inverse[at[p] : at[p] + size[p]]
            mark[mine] = True
            shared = np.add.reduceat(mark[inverse], at, dtype=np.int64)
            mark[mine] = False
            for q in np.flatnonzero(other & (100 * shared >= per_cent * (size + size[p] - shared))):
                if comps[q] != comps[p]:
                    found.append((int(ids[p]), int(ids[q])))
                    comps[comps == comps[q]] = comps[p]
    return found


def _confirmed(stars: DataFrame, sets: DataFrame, per_cent: int) -> DataFrame:
    """(a, b) of the pairs (hub, hub_v), (id, v) that are linked, by their full sets."""

    def side(name: str, v: str) -> DataFrame:
        return sets.select(F.col("doc_id").alias(name), F.col("v").alias(v), F.col("shingles").alias(f"{name}_set"))

    shared = F.size(F.array_intersect("hub_set", "id_set"))
    linked = 100 * shared >= per_cent * (F.size("hub_set") + F.size("id_set") - shared)
    return stars.join(side("hub", "hub_v"), ["hub", "hub_v"]).join(side("id", "v"), ["id", "v"]).where(linked).select(F.col("hub").alias("a"), F.col("id").alias("b"))


def _placed(members: DataFrame, found: DataFrame) -> DataFrame:
    """Members of buckets with the component that each is in so far."""
    return members.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))


def _open_keys(placed: DataFrame) -> DataFrame:
    """key, size and i (the smallest component) of the buckets with several components; one of those with the same members."""
    sizes = placed.groupBy("key").agg(F.count("*").alias("size"), F.min("component").alias("i"), F.max("component").alias("j"), F.sum(F.xxhash64("id", "v").cast("decimal(38,0)")).alias("same"))
    return sizes.where("i < j").groupBy("size", "same").agg(F.min(F.struct("key", "i")).alias("m")).select("m.key", "size", "m.i")


def _keyed_again(members: DataFrame, rows: int, bands: int) -> DataFrame:
    """id, v, n and key for each band of new sketches of the members' sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            sets = batch.column("shingles")
            ptr = np.append(0, np.cumsum(pc.list_value_length(sets).to_numpy(zero_copy_only=False)))
            h = mix(sets.flatten().to_numpy().view(U64) ^ U64(0xC3))
            keys = band_keys(sketches(h, ptr, rows * bands), rows, bands)
            at = np.arange(0, keys.size + 1, bands)
            yield pa.record_batch([batch.column("id"), batch.column("v"), pa.array(np.diff(ptr)), arrow_list(keys.reshape(-1).view(np.int64), at, pa.int64())], names=["id", "v", "n", "bands"])

    return members.select("id", "v", "shingles").mapInArrow(run, "id long, v long, n long, bands array<long>").select("id", "v", "n", F.explode("bands").alias("key"))


def near_duplicates(docs: DataFrame, shingle: int = 5, per_cent: int = 80, rows: int = 5, bands: int = 30, block: int = BLOCK, again_above: int | None = None) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id and kept.

    ``again_above``: the size above which an open bucket's members are keyed again; by default that
    from which pairs of blocks would move more rows than the new keys do.
    """
    more_bands = ceil(bands * log(1 - (per_cent / 100) ** rows) / log(1 - (per_cent / 100) ** (2 * rows)))
    again_above = block * more_bands if again_above is None else again_above
    sketched = written(sketch_table(docs, shingle, rows, bands), "sketches")
    # Aggregates are written before they are joined again: only a side with a shuffle of its own lets
    # adaptive execution split the rows of a hot key (a third of all rows may be copies of one text).
    classes = written(sketched.where("n > 0 AND doc_id IS NOT NULL").groupBy("n", "fp1", "fp2").agg(F.min("doc_id").alias("class_id")), "class_list")
    known = written(
        sketched.join(classes, ["n", "fp1", "fp2"], "left").select("doc_id", "n", F.coalesce("class_id", "doc_id").alias("class_id"), F.col("fp1").alias("v"), F.when(F.col("doc_id") == F.col("class_id"), F.col("bands")).alias("bands")),
        "classes",
    )
    dropped(sketched, classes)

    # Buckets with two members or more; the hub is the smallest member. A member is a doc_id and, as
    # a doc_id may have several texts, the hash v of its set.
    keys = known.where("bands IS NOT NULL").select(F.col("doc_id").alias("id"), "v", "n", F.explode("bands").alias("key"))
    hubs = keys.groupBy("key").agg(F.min(F.struct("id", "v", "n")).alias("hub"), F.max(F.struct("id", "v", "n")).alias("last")).where("hub < last")
    hubs = written(hubs.select("key", F.col("hub.id").alias("hub"), F.col("hub.v").alias("hub_v"), F.col("hub.n").alias("hub_n")), "hubs")
    buckets = written(keys.join(hubs, "key").where("id <> hub OR v <> hub_v"), "buckets")

    near = 100 * F.least("n", "hub_n") >= per_cent * F.greatest("n", "hub_n")
    stars = buckets.where(near).select("hub", "hub_v", "id", "v").distinct()
    crowded = buckets.groupBy("key").agg(F.min(F.struct("id", "v")).alias("i"), F.max(F.struct("id", "v")).alias("j")).where("i < j").select("key")
    crowded = written(crowded, "crowded")
    needed = stars.select("hub").union(stars.select("id")).union(buckets.join(crowded, "key", "leftsemi").select("id")).distinct().withColumnRenamed("hub", "doc_id")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(needed, "doc_id", "leftsemi")
    sets = written(set_table(texts, shingle).groupBy("doc_id", "v").agg(F.min("shingles").alias("shingles")), "sets")
    links = _confirmed(stars, sets, per_cent)
    # A document with several texts joins their classes.
    several = written(known.where("n > 0").groupBy("doc_id").agg(F.min("class_id").alias("a"), F.max("class_id").alias("b")).where("a < b").select("doc_id", "a"), "several")
    own = known.where("n > 0").join(several, "doc_id").select("a", F.col("class_id").alias("b")).distinct()
    links = written(links.union(own), "links")
    found = components(links)

    # Buckets whose members other than the hub still lie in several components.
    placed = written(_placed(buckets, found), "placed")
    still = written(_open_keys(placed), "open")
    rest = placed.join(still.where(F.col("size") <= again_above), "key")
    large = written(placed.join(still.where(F.col("size") > again_above), "key").select("id", "v").distinct(), "large")
    dropped(hubs, buckets, crowded, several, links)
    used = [placed, still, large]
    if not large.isEmpty():
        # Members of large open buckets are dealt out again, by keys of twice as many coordinates.
        again = _placed(_keyed_again(large.join(sets.withColumnRenamed("doc_id", "id"), ["id", "v"]), 2 * rows, more_bands), found)
        again = written(again, "again")
        hub = F.min(F.struct("id", "v", "n", "component")).alias("hub")
        hubs = written(again.groupBy("key").agg(hub, F.min("component").alias("i"), F.max("component").alias("j")).where("i < j").select("key", F.col("hub.id").alias("hub"), F.col("hub.v").alias("hub_v"), F.col("hub.n").alias("hub_n"), F.col("hub.component").alias("hub_component")), "hubs")
        buckets = written(again.join(hubs, "key"), "buckets")
        links = written(_confirmed(buckets.where(near & (F.col("component") != F.col("hub_component"))).select("hub", "hub_v", "id", "v").distinct(), sets, per_cent), "links")
        first, found = found, components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(links))
        split = written(_placed(buckets.drop("component"), found), "placed")
        rest = rest.select("key", "id", "v", "component", "i").union(split.join(_open_keys(split), "key").select("key", "id", "v", "component", "i"))
        used += [first, again, hubs, buckets, links, split]

    # What is left is compared in tasks, a bucket of many blocks by pairs of blocks. Members of the
    # bucket's smallest component, mostly its largest, need not be compared with each other: they have
    # blocks of their own, which meet those of the other members only.
    rest = written(rest.select("key", "id", "v", "component", (F.col("component") == F.col("i")).alias("main")).distinct(), "rest")
    dropped(*used)
    counted = written(rest.groupBy("key").agg(F.ceil(F.count(F.when(F.col("main"), 1)) / block).cast("int").alias("mains"), F.ceil(F.count(F.when(~F.col("main"), 1)) / block).cast("int").alias("others")), "counted")
    own = F.when(F.col("main"), F.pmod(F.xxhash64("id", "v"), F.col("mains")) + F.col("others")).otherwise(F.pmod(F.xxhash64("id", "v"), F.col("others"))).cast("int")
    met = F.sequence(F.lit(0), F.col("others") - 1 + F.when(F.col("main"), 0).otherwise(F.col("mains")))
    pairs = rest.join(counted, "key").withColumn("own", own).withColumn("other", F.explode(met))
    pairs = pairs.select("key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "id", "v", "component")
    pairs = pairs.join(sets.select(F.col("doc_id").alias("id"), "v", "shingles"), ["id", "v"])

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["id", "v"])
        found = joining_links(group["id"].to_numpy(), group["component"].to_numpy(), [np.asarray(s) for s in group["shingles"]], per_cent) if len(group) > 1 else []
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    more = written(pairs.groupBy("key", "p", "q").applyInPandas(compare, "a long, b long"), "joins")
    if not more.isEmpty():
        first, found = found, components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
        dropped(first)
    dropped(more, rest, counted, sets)
    named = known.select("doc_id", F.col("n").alias("n_shingles"), "class_id").join(found.withColumnRenamed("node", "class_id"), "class_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "class_id"))
    return named.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op5_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, per_cent=85, rows=6, bands=24)
