"""Benchmark decontamination by CGK embedding, bit-sampling LSH and exact edit verification.

Texts and items are sequences of words (runs of letters, digits and non-ASCII characters but
punctuation and blanks, of the lower-cased text). In scripts that are written without spaces each
letter, with the marks on it, is a word. An item of n words leaks into a document if some run of the document's words has
an edit distance (words inserted, deleted or replaced) of at most floor(``edits`` * n) to it.

1. Anchors. Within k edits at least n - q + 1 - k * q of an item's q-grams stay whole (q is the
   largest of 3, 2, 1 for which that is positive). Only stretches of a document that hold so many of
   the items' q-grams close enough together can hold a leak; nothing else is looked at.
2. Embedding. Items are cut into parts of about ``PART`` words (short items are one part); of a leak's
   parts one at least has no more than its share of the edits, and mostly several. Part-sized windows of
   the stretches, and the parts, are walked along by CGK's random walk: at step j the current word is
   put out, and a random bit of (j, word) says whether to move on. Small edit distance becomes small
   Hamming distance.
3. LSH. ``walks`` walks times ``samples`` draws of ``sampled`` positions make the keys of a window;
   an item of which a part shares a key is a candidate. At the largest distance the keys alone find
   0.95 and more of the leaks of items of 5 to 1500 words, whatever the kind of edits (tests turn 4 off).
4. Counting, the exact way for the rest (``exact``): an item is also a candidate if n + k words of the
   stretch hold n - q + 1 - k * q of its own q-grams, as every leak does.
5. Each candidate is verified over its whole stretch by an exact bit-parallel edit distance.

The items' indexes are built in tasks and written in blocks of about ``block_items`` items and
``block_bytes`` of text. The documents are read once: a task splits a batch of texts into words and
takes one block after the other to it, forth and back, so what it holds is bounded however many items
there are and the ``HELD`` blocks read last serve the next batch. Items of fewer than ``least_words`` words
(null and empty ones too) leak into nothing. Null and empty texts hold nothing. Items with equal
texts all leak. Repeated rows of one doc_id are one document in ``find_leaks``, and all rows without a doc_id
are one document too; ``without_leaks`` decides each row by its own text. Extra columns are ignored or kept as
told.
"""

from __future__ import annotations

import pickle
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rallyframe.llm.common import scratch_path, table
from rallyframe.llm.files import new_file, open_fs
from rallyframe.llm.text import U64, WORD, doc_of, mix, slices, span_hashes, spans

EDITS = 0.2
LEAST_WORDS = 5
BLOCK_ITEMS = 10000
BLOCK_BYTES = 8 << 20
GRID = 1.15
PART = 40
HELD = 4
_SLOTS = 1 << 20


# Han, kana, bopomofo; Thai, Lao, Myanmar, Khmer; Tai Le to Tai Tham, Balinese; Yi; Javanese, Cham, Tai Viet.
UNSPACED = ((0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3021, 0x3029), (0x3031, 0x303C), (0x3040, 0x312F), (0x31A0, 0x31BF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x16FE0, 0x18DFF), (0x1AFF0, 0x1B2FF), (0x20000, 0x3FFFF),
            (0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19DF), (0x1A20, 0x1AAF), (0x1B00, 0x1B7F), (0xA000, 0xA4CF), (0xA980, 0xA9FF), (0xAA00, 0xAA7F), (0xAA80, 0xAADF))
_kinds: list[np.ndarray] = []


def _kind_table() -> np.ndarray:
    """For every code point 0 (between words), 1 (in words), 2 (letter of an unspaced script) or 3 (mark)."""
    if not _kinds:
        kinds = np.ones(0x110000, np.uint8)
        kinds[:128] = WORD[:128]
        kinds[0x200B] = 0  # a blank of no width
        for c in range(128, 0x20000):
            category = unicodedata.category(chr(c))[0]
            if category in "PZ":
                kinds[c] = 0
            elif category == "M":
                kinds[c] = 3
        for first, last in UNSPACED:
            for c in range(first, min(last, 0x1FFFF) + 1):
                if unicodedata.category(chr(c)) in ("Lo", "Lm", "Nl", "So", "Cn"):
                    kinds[c] = 2
        kinds[0x20000:0x40000] = 2
        _kinds.append(kinds)
    return _kinds[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of UTF-8 bytes."""
    inside = WORD[data]
    lead = np.flatnonzero(data >= 0xC0)
    if not len(lead):
        return spans(inside, offsets)
    size = 2 + (data[lead] >= 0xE0).astype(np.int64) + (data[lead] >= 0xF0)
    code = (data[lead] & (0xFF >> (size + 1))).astype(np.int64)
    for k in range(1, 4):
        code = np.where(size > k, (code << 6) | (data[np.minimum(lead + k, len(data) - 1)] & 0x3F), code)
    kind, end = _kind_table()[code], lead + size
    for k in range(4):
        inside[lead[(kind == 0) & (size > k)] + k] = False
    # A mark belongs to the letter before it: the words of unspaced letters end after their marks.
    marks = np.append(False, (kind[1:] == 3) & (lead[1:] == end[:-1]) & ~np.isin(lead[1:], offsets))
    base = kind[np.maximum.accumulate(np.where(marks, 0, np.arange(len(kind))))]
    last = np.append(~marks[1:], True)
    cuts = np.concatenate([lead[kind == 2], end[(base == 2) & last]])
    return spans(inside, offsets, cuts[cuts < len(data)])


def words_of(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, hashes of the words, pointers of the rows into them)."""
    for lo, hi, data, offsets in slices(pc.utf8_lower(column)):
        starts, ends = word_spans(data, offsets)
        yield lo, hi, span_hashes(data, starts, ends), np.searchsorted(starts, offsets)


def infix_distance(item: np.ndarray, text: np.ndarray) -> int:
    """Least edit distance of the item to any run of the text (Myers' bit vectors, one word a step)."""
    n = len(item)
    masks: dict[int, int] = defaultdict(int)
    for i, w in enumerate(item.tolist()):
        masks[w] |= 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    up, down, score, best = full, 0, n, n
    for w in text.tolist():
        eq = masks.get(w, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph = down | (~(xh | up) & full)
        mh = up & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            best = min(best, score)
        ph, mh = (ph << 1) & full, (mh << 1) & full
        up = mh | (~(xv | ph) & full)
        down = ph & xv
    return best


@dataclass
class SizeClass:
    """Items of about one size."""

    size: int
    part: int = 0
    q: int = 3
    least: int = 1
    span: int = 0
    items: list[int] = field(default_factory=list)
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, U64))
    owners: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    # the items' q-grams in order; the r-th is in the items (positions in ``items``) holders[ptr[r] : ptr[r + 1]]
    grams: np.ndarray = field(default_factory=lambda: np.zeros(0, U64))
    ptr: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    holders: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    # of each item: the q-grams that a leak leaves whole, and the most words of a leak
    needs: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    spans: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))


class ItemIndex:
    """A block of items: their words, the q-gram anchors and the LSH keys."""

    def __init__(self, ids: list, texts: list, edits: float = EDITS, least_words: int = LEAST_WORDS, walks: int = 8, samples: int = 8, sampled: int = 2, seed: int = 11, exact: bool = True):
        self.walks, self.samples, self.sampled, self.edits = walks, samples, sampled, edits
        self.seed, self.exact = seed, exact
        self.ids, self.words = [], []
        row = 0
        for lo, hi, words, ptr in words_of(pa.array(texts, pa.string())):
            for d in range(hi - lo):
                w = words[ptr[d] : ptr[d + 1]]
                if len(w) >= least_words:
                    self.ids.append(ids[lo + d])
                    self.words.append(w)
                row += 1
        self.most = [int(edits * len(w)) for w in self.words]
        by: dict[int, SizeClass] = {}
        for i, w in enumerate(self.words):
            c = int(np.log(len(w)) / np.log(GRID))
            by.setdefault(c, SizeClass(0)).items.append(i)
        self.classes = list(by.values())
        # slot -> bitmask of classes (classes beyond the 63rd share bits, which only adds candidates)
        self.anchors: dict[int, np.ndarray] = {}
        for k, c in enumerate(self.classes):
            pairs = [(len(self.words[i]), self.most[i]) for i in c.items]
            c.size = max(n for n, _ in pairs)
            c.q = next(q for q in (3, 2, 1) if min(n - q + 1 - e * q for n, e in pairs) >= 1)
            c.least = min(n - c.q + 1 - e * c.q for n, e in pairs)
            c.span = max(n + e for n, e in pairs)
            self.anchors.setdefault(c.q, np.zeros(_SLOTS, U64))
            for i in c.items:
                g = self._grams(self.words[i], c.q)
                np.bitwise_or.at(self.anchors[c.q], (g & U64(_SLOTS - 1)).astype(np.int64), U64(1) << U64(k % 64))
            c.needs = np.array([n - c.q + 1 - e * c.q for n, e in pairs])
            c.spans = np.array([n + e for n, e in pairs])
            own = [np.unique(self._grams(self.words[i], c.q)) for i in c.items]
            every, holders = np.concatenate(own), np.repeat(np.arange(len(own)), [len(g) for g in own])
            order = np.argsort(every, kind="stable")
            c.grams, first = np.unique(every[order], return_index=True)
            c.ptr, c.holders = np.append(first, len(every)), holders[order]
            parts = ceil(c.size / PART)
            c.part = ceil(c.size / parts)
            windows = np.zeros((len(c.items) * parts, c.part), U64)
            for r, i in enumerate(c.items):
                w = self.words[i]
                for k in range(parts):
                    at = max(0, min(k * c.part, len(w) - c.part))  # the last part ends with the item
                    said = w[at : at + c.part]
                    windows[r * parts + k, : len(said)] = said
            keys = self._keys(windows, c.part)
            owners = np.repeat(np.array(c.items), parts * keys.shape[1])
            order = np.argsort(keys.reshape(-1), kind="stable")
            c.keys, c.owners = keys.reshape(-1)[order], owners[order]
        self.used = sorted({c.q for c in self.classes})

    @staticmethod
    def _grams(words: np.ndarray, q: int) -> np.ndarray:
        m = max(0, len(words) - q + 1)
        h = words[:m].copy()
        for k in range(1, q):
            h = mix(h) * U64(3) + words[k : k + m]
        return mix(h)

    def _keys(self, windows: np.ndarray, size: int) -> np.ndarray:
        """The LSH keys (walks * samples for each row) of rows of words padded by zeros."""
        n, width = windows.shape
        out = np.empty((n, self.walks * self.samples), U64)
        rng = np.random.default_rng([self.seed, size])
        rows = np.arange(n)
        for w in range(self.walks):
            steps = 2 * size
            factors = rng.integers(1, 1 << 62, steps, dtype=np.uint64) * U64(2) + U64(1)
            walked, at = np.empty((n, steps), U64), np.zeros(n, np.int64)
            for j in range(steps):
                word = np.where(at < width, windows[rows, np.minimum(at, width - 1)], U64(0))
                walked[:, j] = word
                at += (mix(word * factors[j]) >> U64(63)).astype(np.int64)
            for s in range(self.samples):
                places = rng.integers(0, max(1, int(1.7 * size)), self.sampled)
                key = np.full(n, U64(1 + w * self.samples + s))
                for p in places:
                    key = mix(key * U64(3) + walked[:, p])
                out[:, w * self.samples + s] = key
        return out

    def _stretches(self, words: np.ndarray, ptr: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(class, document, first word, last word + 1) of the stretches that can hold a leak."""
        found = []
        for q in self.used:
            masks = self.anchors[q][(self._grams(words, q) & U64(_SLOTS - 1)).astype(np.int64)]
            at = np.flatnonzero(masks)
            if not len(at):
                continue
            docs = doc_of(at, ptr)
            inside = at + q <= ptr[docs + 1]
            at, docs, masks = at[inside], docs[inside], masks[at[inside]]
            for k, c in enumerate(self.classes):
                if c.q != q:
                    continue
                mine = (masks >> U64(k % 64)) & U64(1) == 1
                p, d = at[mine], docs[mine]
                m = len(p) - c.least + 1
                if m <= 0:
                    continue
                e = p[c.least - 1 :]
                close = (e - p[:m] + q <= c.span) & (d[c.least - 1 :] == d[:m])
                lo = np.maximum(ptr[d[:m]], e + q - c.span)[close]
                hi = np.minimum(ptr[d[:m] + 1], p[:m] + c.span)[close]
                d = d[:m][close]
                if not len(lo):
                    continue
                new = np.append(True, (lo[1:] >= np.maximum.accumulate(hi)[:-1]) | (d[1:] != d[:-1]))
                first = np.flatnonzero(new)
                found += zip([k] * len(first), d[first].tolist(), lo[first].tolist(), np.maximum.reduceat(hi, first).tolist())
        return found

    def _counted(self, c: SizeClass, flat: np.ndarray, base: np.ndarray, limit: int = 1 << 20) -> set[tuple[int, int]]:
        """(stretch, item) of all pairs in which the item's span of words holds as many of its q-grams as it needs; stretches begin in ``flat`` at ``base``."""
        gram = self._grams(flat, c.q)
        rank = np.minimum(np.searchsorted(c.grams, gram), len(c.grams) - 1)
        at = np.flatnonzero(c.grams[rank] == gram)
        part = np.searchsorted(base, at, "right") - 1
        inside = at + c.q <= np.append(base[1:], len(flat))[part]
        at, part = at[inside], part[inside]
        rank = rank[at]
        many = c.ptr[rank + 1] - c.ptr[rank]
        found = set()
        group = max(1, limit // len(c.items))  # stretches counted at once
        for lo in range(0, len(base), group):
            a, b = np.searchsorted(part, [lo, lo + group])
            counts = np.zeros(min(group, len(base) - lo) * len(c.items), np.int64)
            done = np.cumsum(many[a:b])
            while a < b:  # about ``limit`` pairs of position and item at once
                z = max(a + 1, b - len(done) + int(np.searchsorted(done, (done[a - b] - many[a]) + limit, "right")))
                m = many[a:z]
                place = np.repeat(c.ptr[rank[a:z]] - np.cumsum(m) + m, m) + np.arange(m.sum())
                counts += np.bincount(np.repeat(part[a:z] - lo, m) * len(c.items) + c.holders[place], minlength=len(counts))
                a = z
            for pair in np.flatnonzero(counts.reshape(-1, len(c.items)) >= c.needs).tolist():
                r, k = lo + pair // len(c.items), pair % len(c.items)
                x, y = np.searchsorted(part, [r, r + 1])
                p = at[x:y][np.isin(gram[at[x:y]], self._grams(self.words[c.items[k]], c.q))]
                if (p[c.needs[k] - 1 :] - p[: len(p) - c.needs[k] + 1] + c.q <= c.spans[k]).any():
                    found.add((r, c.items[k]))
        return found

    def leaks(self, texts: Iterable[tuple[int, int, np.ndarray, np.ndarray]]) -> list[tuple[int, int, int]]:
        """(row, item's position in ``ids``, edits) of texts as ``words_of`` gives them."""
        stretches: dict[int, list[tuple[int, np.ndarray]]] = defaultdict(list)
        for lo, _, words, ptr in texts:
            for k, d, a, b in self._stretches(words, ptr):
                stretches[k].append((lo + d, words[a:b].copy()))
        best: dict[tuple[int, int], int] = {}
        for k, parts in stretches.items():
            c = self.classes[k]
            step = max(1, c.part // 12)
            owners, starts = [], []
            for r, (_, w) in enumerate(parts):
                s = np.arange(0, max(1, len(w) - c.part + c.part // 4 + 1), step)
                owners.append(np.full(len(s), r))
                starts.append(s)
            owners, starts = np.concatenate(owners), np.concatenate(starts)
            sizes = np.array([len(w) for _, w in parts])
            base = np.cumsum(sizes) - sizes
            flat = np.concatenate([w for _, w in parts])
            block = max(1, (1 << 19) // c.part)
            pairs: set[tuple[int, int]] = set()
            for f in range(0, len(owners), block):
                o, s = owners[f : f + block], starts[f : f + block]
                place = s[:, None] + np.arange(c.part)
                windows = np.where(place < sizes[o][:, None], flat[np.minimum(base[o][:, None] + place, len(flat) - 1)], U64(0))
                keys = self._keys(windows, c.part)
                lo, hi = np.searchsorted(c.keys, keys, "left"), np.searchsorted(c.keys, keys, "right")
                hit = np.flatnonzero((hi > lo).any(1))
                for h in hit:
                    for a, b in zip(lo[h], hi[h]):
                        if b > a:
                            pairs.update((int(o[h]), int(i)) for i in c.owners[a:b])
            for r, i in pairs | (self._counted(c, flat, base) if self.exact else set()):
                row, w = parts[r]
                if (row, i) in best and best[row, i] == 0:
                    continue
                d = infix_distance(self.words[i], w)
                if d <= self.most[i]:
                    best[row, i] = min(d, best.get((row, i), d))
        return [(row, i, d) for (row, i), d in best.items()]


def item_blocks(benchmark: DataFrame, block_items: int = BLOCK_ITEMS, block_bytes: int = BLOCK_BYTES, **options) -> list[str]:
    """Write the items' indexes, of about ``block_items`` items and ``block_bytes`` of text at most each; returns their URIs."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.col("text").isNotNull()).distinct()
    size = items.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    blocks = max(1, ceil(size["n"] / block_items), ceil((size["bytes"] or 0) / block_bytes))
    folder = scratch_path(benchmark.sparkSession, "items")

    def build(group: pa.Table) -> pa.Table:
        rows = sorted(group.select(["item_id", "text"]).to_pylist(), key=lambda r: (r["item_id"] is None, r["item_id"], r["text"]))
        uri = new_file(folder, ".index")
        fs, path = open_fs(uri)
        with fs.open_output_stream(path, compression=None) as out:
            out.write(pickle.dumps(ItemIndex([r["item_id"] for r in rows], [r["text"] for r in rows], **options)))
        return pa.table({"uri": [uri]})

    built = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))).groupBy("block").applyInArrow(build, "uri string")
    return sorted(r["uri"] for r in built.collect())


@lru_cache(HELD)
def _index(uri: str) -> ItemIndex:
    fs, path = open_fs(uri)
    with fs.open_input_file(path) as f:
        return pickle.loads(f.read())


def _by_bytes(batches: Iterator[pa.RecordBatch], most: int = 32 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of text."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(at, to - at)
            at = to


def _leaks(batch: pa.RecordBatch, blocks: list[str]) -> Iterator[tuple[ItemIndex, list[tuple[int, int, int]]]]:
    """The leaks of one batch by blocks of items; the texts are split into words once."""
    words = list(words_of(batch.column("text"))) if blocks else []
    for uri in list(blocks):
        index = _index(uri)
        yield index, index.leaks(words)
    blocks.reverse()  # the next batch begins with the blocks that are held


def find_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, item_id, edits and words (the item's) for each leak; one row for each document and item."""
    blocks = item_blocks(benchmark, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _by_bytes(batches):
            for m, found in _leaks(batch, blocks):
                rows = pa.array([f[0] for f in found], pa.int64())
                yield pa.record_batch([batch.column("doc_id").take(rows), pa.array([m.ids[f[1]] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int64()), pa.array([len(m.words[f[1]]) for f in found], pa.int64())], names=["doc_id", "item_id", "edits", "words"])

    every = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, item_id long, edits long, words long")
    return every.groupBy("doc_id", "item_id").agg(F.min(F.struct("edits", "words")).alias("m")).select("doc_id", "item_id", "m.edits", "m.words")


def without_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no item. Nothing is shuffled."""
    blocks = item_blocks(benchmark, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _by_bytes(batches):
            keep = np.ones(batch.num_rows, bool)
            for _, found in _leaks(batch, blocks):
                keep[[f[0] for f in found]] = False
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
