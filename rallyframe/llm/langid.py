"""Language ID by a bit-sliced Bloom filter of n-grams.

The filter is an array of language bitmasks. An n-gram is put in for every language in which it is
common, by setting that language's bit in the masks at its hash positions; the AND of those masks
gives at once all languages that contain an n-gram (and, rarely, one that does not). A text's
n-grams are looked up, each language's hits are counted, what false positives are expected to add
is taken off, and the language with most hits is the answer.

N-grams are runs of 2 to 4 characters of the lower-cased words with a blank on either side. An
n-gram is common in a language if its share of documents there is at least ``least_share`` and at
least ``least_ratio`` of its largest share in any language.

Learning takes all labelled rows of a language, or about ``sample_rows`` of them where it has more (a
documented bound, for each language by itself), so how rare a language is among all rows does not
matter. A row that is repeated with one key and one text counts once; the others are picked by a hash
of key and text. A language has at most (n-grams of a document) / ``least_share`` n-grams, which bounds the
filter, whatever the size of the table: it has ``bits_per_gram`` bits for each, times one word of 64 bits
for each 64 languages. Prediction reads every whole text. Null texts and texts without a letter are
``und`` with score 0. Other texts get a learned language even if no n-gram is known: the most frequent
one, score 0. Ties go to the more frequent language (of all labelled rows). Nothing learned: ``und``.
Every row is predicted, those with a null or repeated key too. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rallyframe.llm.common import crc_mod, dropped, small, table, written
from rallyframe.llm.text import U64, mix

SAMPLE_ROWS = 10000
SIZES = (2, 3, 4)
HASHES = 3
_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    """For every code point its lower-case form if it is a letter, else a blank."""
    if not _letters:
        codes = np.full(0x110000, 32, np.uint32)
        for c in range(0x40000):  # no letters lie beyond
            if chr(c).isalpha():
                low = chr(c).lower()
                codes[c] = ord(low) if len(low) == 1 else c
        _letters.append(codes)
    return _letters[0]


def grams(texts: list[str | None], limit: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, letters of each row, row of each n-gram, hash of each n-gram), by slices of rows."""
    table_, lo = _letter_table(), 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi] or "") <= limit):
            size += len(texts[hi] or "")
            hi += 1
        rows = [t or "" for t in texts[lo:hi]]
        codes = np.frombuffer((" " + " ".join(rows) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = table_[np.minimum(codes, 0x10FFFF)]
        ends = np.cumsum([len(r) + 1 for r in rows])
        letter = codes != 32
        keep = letter.copy()  # runs of blanks shrink to one
        keep[1:] |= letter[:-1]
        keep[0] = True
        owner = np.searchsorted(ends, np.arange(len(codes)), "right")
        letters = np.bincount(owner[letter], minlength=hi - lo)
        codes, owner = codes[keep].astype(U64), owner[keep]
        hashes, owners = [], []
        for n in SIZES:
            if len(codes) < n:
                continue
            m = len(codes) - n + 1
            h = codes[:m].copy()
            whole = np.ones(m, bool)
            for k in range(1, n):
                h = h * U64(0x100000001B3) + codes[k : k + m]
                if k < n - 1:
                    whole &= codes[k : k + m] != 32
            hashes.append(mix(h[whole] * U64(8) + U64(n)))
            # an n-gram belongs to the row of its first letter
            owners.append(np.where(codes[:m] != 32, owner[:m], owner[1 : 1 + m])[whole])
        yield lo, hi, letters, np.concatenate(owners) if owners else np.zeros(0, np.int64), np.concatenate(hashes) if hashes else np.zeros(0, U64)
        lo = hi


@dataclass
class LanguageFilter:
    """``masks``: bitmasks of languages for each slot (a row of 64-bit words); ``fill``: share of set slots by language."""

    languages: list[str]
    masks: np.ndarray
    fill: np.ndarray

    def _slots(self, hashes: np.ndarray) -> list[np.ndarray]:
        n, step = U64(len(self.masks) - 1), (hashes >> U64(32)) | U64(1)
        return [((hashes + step * U64(k)) & n).astype(np.int64) for k in range(HASHES)]

    def add(self, hashes: np.ndarray, masks: np.ndarray) -> None:
        for s in self._slots(hashes):
            np.bitwise_or.at(self.masks, s, masks)

    def containing(self, hashes: np.ndarray) -> np.ndarray:
        """The bitmasks of languages that contain each n-gram."""
        a, *rest = (self.masks[s] for s in self._slots(hashes))
        for b in rest:
            a = a & b
        return a

    def hits(self, n: int, owner: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """How many n-grams of each of ``n`` rows each language contains, false positives among them."""
        found, langs = self.containing(hashes), len(self.languages)
        out = np.empty((n, langs))
        bits = (np.arange(256)[:, None] >> np.arange(8)) & 1
        for first in range(0, langs, 8):  # eight languages are counted at once, by what their bits spell
            eight = (found[:, first // 64] >> U64(first % 64)) & U64(255)
            spelt = np.bincount((owner << 8) | eight.astype(np.int64), minlength=n << 8).reshape(n, 256)
            out[:, first : first + 8] = (spelt @ bits)[:, : langs - first]
        return out

    def decide(self, n: int, owner: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The index of the best language and its score, the share of known n-grams among all, for each of ``n`` rows."""
        total = np.bincount(owner, minlength=n)
        false = self.fill**HASHES
        hits = np.maximum(0, (self.hits(n, owner, hashes) - total[:, None] * false) / np.maximum(1 - false, 1e-9))
        best = hits.argmax(1)  # the first of equals; languages stand in order of frequency
        return best, np.where(total > 0, hits[np.arange(n), best] / np.maximum(total, 1), 0.0).clip(0, 1)


def _rows_by_language(known: DataFrame) -> dict[str, int]:
    """The rows of each language, the most frequent language first."""
    return {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").collect()}


def fit_languages(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, least_share: float = 0.01, least_ratio: float = 0.5, bits_per_gram: int = 24, key: str = "doc_id") -> LanguageFilter | None:
    """Learn a filter from the rows with text and lang, about ``sample_rows`` at most of each language; None if there are none."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = rows = _rows_by_language(known)
    if not rows:
        return None
    row = F.xxhash64(F.col(key).cast("string"), F.xxhash64("text"), F.lit(97))
    share = F.create_map(*[F.lit(x) for k, n in rows.items() for x in (k, int((1 << 30) * min(1.0, sample_rows / n)))])
    known = known.where(F.pmod(row, F.lit(1 << 30)) < share[F.col("lang")])
    once = written(known.select("lang", row.alias("row")).groupBy("lang", "row").agg(F.count("*").alias("n")), "picked")
    sizes = _rows_by_language(once)
    if not once.where("n > 1").isEmpty():  # repeated rows: each text once
        known = known.withColumn("row", row).dropDuplicates(["lang", "row"])
    dropped(once)
    known = known.select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            langs = np.array(batch.column("lang").to_pylist(), object)
            for lo, hi, _, owner, hashes in grams(batch.column("text").to_pylist()):
                for lang in set(langs[lo:hi]):
                    mine = np.isin(owner, np.flatnonzero(langs[lo:hi] == lang))
                    order = np.lexsort((owner[mine], hashes[mine]))
                    o, h = owner[mine][order], hashes[mine][order]
                    first = np.append(True, (o[1:] != o[:-1]) | (h[1:] != h[:-1]))[: len(o)]
                    values, counts = np.unique(h[first], return_counts=True)
                    yield pa.record_batch([pa.array([lang] * len(values), pa.string()), pa.array(values.view(np.int64)), pa.array(counts.astype(np.int64))], names=["lang", "gram", "n"])

    share = F.col("n") / F.create_map(*[F.lit(x) for k, v in sizes.items() for x in (k, float(v))])[F.col("lang")]
    common = known.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).withColumn("share", share)
    # A language has at most (n-grams of a document) / least_share such n-grams.
    common = common.where((F.col("share") >= least_share) & (F.col("n") >= 2))
    got = common.groupBy("gram").agg(F.map_from_entries(F.collect_list(F.struct("lang", "share"))).alias("by")).toArrow()
    names = [k for k in rows if k in sizes]
    gram = got.column("gram").to_numpy().view(U64)
    place = {k: i for i, k in enumerate(names)}
    mask = np.zeros((len(gram), (len(names) + 63) // 64), U64)
    for i, by in enumerate(got.column("by").to_pylist()):
        top = max(v for _, v in by)
        for lang, v in by:
            if v >= least_ratio * top:
                mask[i, place[lang] // 64] |= U64(1) << U64(place[lang] % 64)
    slots = 1 << max(12, int(len(gram) * bits_per_gram / HASHES - 1).bit_length())
    out = LanguageFilter(names, np.zeros((slots, mask.shape[1]), U64), np.zeros(len(names)))
    out.add(gram, mask)
    out.fill = np.array([((out.masks[:, k // 64] >> U64(k % 64)) & U64(1)).mean() for k in range(len(names))])
    return out


def predict_languages(docs: DataFrame, model: LanguageFilter | None, key: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """``key`` and the columns ``keep`` of every row, with lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    cols = [key, *keep]
    text = "__rf_text"
    source = docs.select(*cols, F.col("text").alias(text))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in small(batches):
            for lo, hi, letters, owner, hashes in grams(batch.column(text).to_pylist()):
                if m is None:
                    names, score = ["und"] * (hi - lo), np.zeros(hi - lo)
                else:
                    best, score = m.decide(hi - lo, owner, hashes)
                    score = np.where(letters > 0, score, 0.0)
                    names = [m.languages[b] if n else "und" for b, n in zip(best.tolist(), letters.tolist())]
                yield pa.record_batch([*(batch.column(c).slice(lo, hi - lo) for c in cols), pa.array(names, pa.string()), pa.array(score)], names=[*cols, "lang_pred", "score"])

    schema = source.drop(text).schema.add("lang_pred", "string").add("score", "double")
    return source.mapInArrow(predict, schema)


def identified(docs: DataFrame, model: LanguageFilter | None, least_score: float = 0.3, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose language is known: not ``und``, and a score of ``least_score`` or more. Nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in small(batches):
            good = np.zeros(batch.num_rows, bool)
            for lo, hi, letters, owner, hashes in grams(batch.column(text).to_pylist()):
                if m is not None:
                    good[lo:hi] = (m.decide(hi - lo, owner, hashes)[1] >= least_score) & (letters > 0)
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(keep, docs.schema)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    held_out = crc_mod("doc_id", 5) == 0
    model = fit_languages(docs.where(~held_out))
    return predict_languages(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
