"""Near-duplicate documents by SimHash fingerprints, joined over segment popcounts.

A text's shingles are its runs of ``shingle`` words, repeats included (words: runs of bytes other than
ASCII white space, A-Z lower-cased; joined by a blank). With fewer words the whole sequence is the one
shingle; without words there is none. A bit of the fingerprint is 1 if it is set in over half of the
shingles' XXH64 values (seed 42), so without shingles the fingerprint is zero. Documents whose
fingerprints differ in at most ``distance`` bits are linked.

The join. A fingerprint is cut into 32 segments of two bits and mapped to the number of bits set in each.
Flipping a bit changes one count by one, so the Manhattan distance of two such points never exceeds
the fingerprints' Hamming distance. The segments are dealt to ``distance // 2 + 1`` pieces: of two linked
fingerprints some piece has points at Manhattan distance 0 or 1. So each point stands in its own cell
of each piece's grid and calls at the cells one step up in one coordinate: linked points meet, whichever of
them is the lower. All that meet in a cell are compared by all 64 bits.

1. Rows with one fingerprint are a class with the smallest doc_id; only classes are joined.
2. Cells with one member, or with callers only, are left out by their counts.
3. Members of a cell are dealt to blocks of about ``block`` members, and blocks meet in pairs, so no
   task holds more than two blocks and no link is lost. A meeting returns links that join its members'
   components, not pairs, so what is returned grows with the members.
4. Components of all links.

Nulls: a null text has no words; a null doc_id is in no component (null) and links nothing. A doc_id with
several texts is one document: all its fingerprints' classes are in its component. Whole texts are read,
in pieces of bounded size. Repeated rows stay. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rallyframe.llm.common import dropped, small, table, written
from rallyframe.llm.graph import components

BLOCK = 500
PIECE = 1 << 20
SEGMENTS = 32
_space = re.compile(rb"[\x20\x09-\x0D]")
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_EVEN = 0x5555555555555555


def shingles(text: bytes, size: int) -> Iterator[list[bytes]]:
    """The shingles of a text in order, repeats included, in lists of about ``PIECE`` bytes of text."""
    at, carried, words = 0, [], 0
    while at < len(text):
        cut = _space.search(text, at + PIECE)
        end = cut.start() if cut else len(text)
        new = text[at:end].lower().split()
        words, at = words + len(new), end
        carried += new
        if len(carried) >= size:
            yield [b" ".join(s) for s in zip(*(carried[k:] for k in range(size)))]
            carried = carried[len(carried) - size + 1 :]
    if 0 < words < size:
        yield [b" ".join(carried)]


def fingerprint(text: bytes, size: int = 3) -> int:
    """The fingerprint of a text, unsigned."""
    n, counts = 0, np.zeros((8, 8), np.int64)
    for found in shingles(text, size):
        h = np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in found), "<u8", len(found))
        places = h.view(np.uint8).reshape(-1, 8) + np.arange(0, 2048, 256)
        counts += np.bincount(places.ravel(), minlength=2048).reshape(8, 256) @ _BITS
        n += len(found)
    return int.from_bytes(np.packbits(2 * counts > n, axis=1, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """Per row: doc_id and fp (the fingerprint as a signed long)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            fps = [fingerprint(t.as_py() or b"", shingle) for t in batch.column("text")]
            yield pa.record_batch([batch.column("doc_id"), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(scan, "doc_id long, fp long")


def popcounts(fp: Column) -> Column:
    """The counts of bits set in the 32 segments, two bits of a long each."""
    low, high = fp.bitwiseAND(F.lit(_EVEN)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(_EVEN))
    return low.bitwiseXOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))  # low + high, which no sign bit overflows


def _long(bits: int) -> Column:
    return F.lit(bits - (1 << 64) if bits >> 63 else bits).cast("long")


def cells(classes: DataFrame, distance: int) -> DataFrame:
    """piece, cell, own (else it calls there), fp and id, for each cell in which a class stands or calls."""
    pieces = distance // 2 + 1
    point = F.col("point")
    found = []
    for p in range(pieces):
        lo, hi = p * SEGMENTS // pieces, (p + 1) * SEGMENTS // pieces
        at = point.bitwiseAND(_long((1 << 2 * hi) - (1 << 2 * lo)))
        found.append(F.struct(F.lit(p).alias("piece"), at.alias("cell"), F.lit(True).alias("own")))
        for s in range(lo, hi):
            count = F.shiftrightunsigned(point, 2 * s).bitwiseAND(F.lit(3))
            up = F.when(count == 0, at.bitwiseXOR(_long(1 << 2 * s))).when(count == 1, at.bitwiseXOR(_long(3 << 2 * s)))
            found.append(F.struct(F.lit(p).alias("piece"), up.alias("cell"), F.lit(False).alias("own")))
    return classes.withColumn("point", popcounts(F.col("fp"))).select("fp", "id", F.inline(F.array(*found))).where("cell IS NOT NULL")


def _joined(group: np.ndarray, own: np.ndarray, part: np.ndarray, alone: np.ndarray, fp: np.ndarray, ids: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that join the members of each group as their near fingerprints do.

    Rows of a group stand together. Rows of one part are compared only if the group is ``alone``
    (a block that meets itself); two rows that only call are not compared.
    """
    n = len(fp)
    label = np.arange(n)
    left, right = [], []
    step = 1
    while step < n and (same := np.flatnonzero(group[step:] == group[:-step])).size:
        other = same + step
        keep = (own[same] | own[other]) & (alone[same] | (part[same] != part[other]))
        keep &= np.bitwise_count(fp[same] ^ fp[other]) <= distance
        left.append(same[keep])
        right.append(other[keep])
        step += 1
    if not left:
        return ids[:0], ids[:0]
    a, b = np.concatenate(left), np.concatenate(right)
    while True:  # the least label spreads along links, by way of the labels themselves
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero((label != np.arange(n)) & (ids[label] != ids))
    return ids[moved], ids[label[moved]]


def links(classes: DataFrame, distance: int = 3, block: int = BLOCK) -> DataFrame:
    """(a, b) of linked classes (fp, id), enough to join all that are linked."""
    found = cells(classes, distance)
    place = ["piece", "cell"]
    # Counts are written before they are joined, so that adaptive execution can split a hot cell.
    counts = written(found.groupBy(*place).agg(F.count("*").alias("n"), F.max("own").alias("any")).where("n > 1 AND any").select(*place, F.ceil(F.col("n") / block).cast("int").alias("blocks")), "cells")
    met = found.join(counts, place).withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select(*place, F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"), "mine", "own", "fp", "id")
    dealt = met.repartition(*place, "p", "q").sortWithinPartitions(*place, "p", "q", "fp")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(rows: pa.Table) -> pa.RecordBatch:
            c = {name: rows.column(name).to_numpy() for name in ("piece", "cell", "p", "q", "mine", "own", "fp", "id")}
            new = np.ones(rows.num_rows, bool)
            new[1:] = (c["piece"][1:] != c["piece"][:-1]) | (c["cell"][1:] != c["cell"][:-1]) | (c["p"][1:] != c["p"][:-1]) | (c["q"][1:] != c["q"][:-1])
            a, b = _joined(np.cumsum(new), c["own"].astype(bool), c["mine"], c["p"] == c["q"], c["fp"].view(np.uint64), c["id"], distance)
            return pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            # the last meeting of a batch may go on in the next one
            last = [batch.column(k)[batch.num_rows - 1].as_py() for k in ("piece", "cell", "p", "q")] if batch.num_rows else None
            if last is None:
                continue
            ends = np.ones(batch.num_rows, bool)
            for k, v in zip(("piece", "cell", "p", "q"), last):
                ends &= batch.column(k).to_numpy() == v
            first = int(np.flatnonzero(~ends)[-1]) + 1 if not ends.all() else 0
            if first:
                yield done(pa.Table.from_batches([*held, batch.slice(0, first)]))
                held = []
            held.append(batch.slice(first))
        if held:
            yield done(pa.Table.from_batches(held))

    out = written(dealt.mapInArrow(compare, "a long, b long").distinct(), "links")
    dropped(counts)
    return out


def simhash_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 3, block: int = BLOCK) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hexadecimal digits), component_id and kept."""
    if not 0 <= distance < 16:
        raise ValueError("distance must be from 0 to 15 bits")
    prints = written(fingerprints(docs, shingle), "fingerprints")
    known = prints.where("doc_id IS NOT NULL")
    classes = written(known.groupBy("fp").agg(F.min("doc_id").alias("id")), "classes")
    near = links(classes, distance, block)
    # A doc_id with several fingerprints joins their classes.
    several = written(known.groupBy("doc_id").agg(F.min("fp").alias("f"), F.max("fp").alias("g")).where("f < g").select("doc_id"), "several")
    own = known.join(several, "doc_id").select("doc_id", "fp").distinct().join(classes, "fp").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    found = components(near.union(own))
    named = classes.join(found.withColumnRenamed("node", "id"), "id", "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    named = written(named, "named")
    dropped(near, several, classes, found)
    component = F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
    out = prints.join(named, "fp", "left").withColumn("component_id", component)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_duplicates(table(spark, sf_dir, "documents"))
