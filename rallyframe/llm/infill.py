"""Fill-in-middle transformation with memoised content-defined chunks.

A text's tokens are words with the white space before them, and white space at the end (ASCII white space).
Two of its token boundaries, drawn from a hash of the document's id, cut it into prefix, middle and
suffix. The output is the text (``plain``), or the parts behind their sentinels, suffix last
(``psm``) or first (``spm``). The exact text can be rebuilt from output and form (``restored``).

Where the k-th token ends is found through chunks. A rolling hash of the last 32 bytes cuts texts where its
low bits are zero, so equal passages are cut alike wherever they stand. A chunk's boundary summary
holds its bytes, its code points, how many words end inside it, and whether it begins and ends with white
space. Summaries are kept in a bounded cache that is keyed by the chunk's bytes themselves: a shared chunk
is verified by equality and counted once. Summaries of neighbours combine: a word ends between two chunks if
the first ends inside a word and the second begins with white space or is the text's end. Running
counts over the chunks tell the chunk of each cut, and only that chunk is looked at again.

Nulls: a null text is an empty one; a null id is hashed as the empty text. Empty texts, and texts that hold
a sentinel, stay plain. Whole texts are read; a chunk has at most ``LONGEST`` bytes. Repeated rows are
transformed alike. Input columns that have the name of a result column are replaced, others are kept.
An empty table gives no rows.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rallyframe.llm.common import small, table
from rallyframe.llm.text import SPACE, slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 42
SHORTEST, AVERAGE, LONGEST = 64, 512, 8192
CACHED = 16 << 20
WINDOW = 32
_GEAR = np.random.default_rng(11).integers(0, 1 << 32, 256, np.uint32)


class Summary(NamedTuple):
    """What a chunk says to its neighbours."""

    size: int
    chars: int
    ends: int  # words that end before its last byte
    opens: bool  # begins with white space
    closes: bool  # ends with white space


def summary(chunk: bytes) -> Summary:
    data = np.frombuffer(chunk, np.uint8)
    space = SPACE[data]
    return Summary(len(chunk), int(np.count_nonzero((data & 0xC0) != 0x80)), int(np.count_nonzero(space[1:] & ~space[:-1])), bool(space[0]), bool(space[-1]))


class Cache:
    """Summaries of chunks by content, of the lately used ``limit`` bytes."""

    def __init__(self, limit: int = CACHED):
        self.limit, self.size, self.hits, self.kept = limit, 0, 0, OrderedDict()

    def get(self, chunk: bytes) -> Summary:
        found = self.kept.get(chunk)  # equal bytes, not only an equal hash
        if found is not None:
            self.hits += 1
            self.kept.move_to_end(chunk)
            return found
        found = self.kept[chunk] = summary(chunk)
        self.size += len(chunk)
        while self.size > self.limit:
            self.size -= len(self.kept.popitem(last=False)[0])
        return found


def rolling(data: np.ndarray) -> np.ndarray:
    """For each byte a hash of the last 32 bytes, itself included."""
    h = _GEAR[data]
    width = 1
    while width < WINDOW:
        wide = h.copy()
        wide[width:] += h[:-width] << np.uint32(width)
        h, width = wide, 2 * width
    return h


def chunks(data: np.ndarray) -> list[int]:
    """Where the chunks of one text end."""
    n, at, ends = len(data), 0, []
    # the hash's high bits depend on all 32 bytes
    marks = np.flatnonzero(rolling(data) >> np.uint32(32 - AVERAGE.bit_length() + 1) == 0) + 1
    marks = marks[marks >= WINDOW]
    while at < n:
        k = int(np.searchsorted(marks, at + SHORTEST))
        at = min(int(marks[k]) if k < len(marks) else n, at + LONGEST, n)
        ends.append(at)
    return ends


class Text:
    """A text as the summaries of its chunks."""

    def __init__(self, data: np.ndarray, cache: Cache):
        self.data = data
        self.stops = chunks(data)
        self.starts = [0, *self.stops[:-1]]
        raw = data.tobytes()
        parts = [cache.get(raw[a:b]) for a, b in zip(self.starts, self.stops)]
        after = [p.opens for p in parts[1:]] + [True]
        self.ends = np.cumsum([0] + [p.ends + (not p.closes and opens) for p, opens in zip(parts, after)])
        self.chars = np.cumsum([0] + [p.chars for p in parts])
        self.words = int(self.ends[-1])
        self.tokens = self.words + (bool(parts) and parts[-1].closes)

    def cut(self, k: int) -> tuple[int, int]:
        """(byte, code point) behind the first k tokens."""
        if k == 0:
            return 0, 0
        if k > self.words:
            return len(self.data), int(self.chars[-1])
        c = int(np.searchsorted(self.ends, k)) - 1  # the chunk in which the k-th word ends
        a, b = self.starts[c], self.stops[c]
        space = SPACE[self.data[a:b]]
        stops = np.flatnonzero(space[1:] & ~space[:-1]) + 1
        nth = k - int(self.ends[c]) - 1
        inside = int(stops[nth]) if nth < len(stops) else b - a
        return a + inside, int(self.chars[c]) + int(np.count_nonzero((self.data[a : a + inside] & 0xC0) != 0x80))


def arranged(text: str, byte: int, end: int, form: str) -> str:
    raw = text.encode()
    prefix, middle, suffix = raw[:byte].decode(), raw[byte:end].decode(), raw[end:].decode()
    if form == "psm":
        return PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle
    return SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle


def fill_in_middle(docs: DataFrame, plain_per_cent: int = 50, spm_per_cent: int = 80, seed: int = SEED, text: str = "text", key: str = "doc_id") -> DataFrame:
    """All rows and columns with n (tokens), form, prefix_chars, middle_chars and output."""
    added = ("n", "form", "prefix_chars", "middle_chars", "output")
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    draws = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.conv(F.substr(drawn, 8 * k + 1, F.lit(8)), 16, 10).cast("long"))
    held = F.coalesce(F.col(text), F.lit(""))
    plain = (held == "") | held.contains(PREFIX) | held.contains(SUFFIX) | held.contains(MIDDLE) | (F.get(draws, 2) % 100 >= plain_per_cent)
    form = F.when(plain, "plain").when(F.get(draws, 3) % 100 < spm_per_cent, "spm").otherwise("psm")
    kept = [c for c in docs.columns if c.lower() not in added]
    rows = docs.select(*[f"`{c}`" for c in kept], form.alias("form"), F.get(draws, 0).alias("__rf_a"), F.get(draws, 1).alias("__rf_b"))
    types = ("long", "string", "long", "long", "string")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*[f"`{c}`" for c in kept]).schema] + [f"{c} {k}" for c, k in zip(added, types)])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Cache()
        for batch in small(batches):
            names, forms = batch.schema.names, batch.column("form").to_pylist()
            texts = batch.column(text)
            n, before, within, out = [], [], [], []
            for lo, hi, data, offsets in slices(texts):
                for r in range(lo, hi):
                    seen = Text(data[offsets[r - lo] : offsets[r - lo + 1]], cache)
                    n.append(seen.tokens)
                    said = texts[r].as_py() or ""
                    if forms[r] == "plain":
                        before.append(None)
                        within.append(None)
                        out.append(said)
                        continue
                    k = sorted(int(batch.column(c)[r].as_py()) % (seen.tokens + 1) for c in ("__rf_a", "__rf_b"))
                    (a, a_chars), (b, b_chars) = seen.cut(k[0]), seen.cut(k[1])
                    before.append(a_chars)
                    within.append(b_chars - a_chars)
                    out.append(arranged(said, a, b, forms[r]))
            made = [pa.array(n, pa.int64()), batch.column("form"), pa.array(before, pa.int64()), pa.array(within, pa.int64()), pa.array(out, pa.string())]
            yield pa.record_batch([batch.column(names.index(c)) for c in kept] + made, names=[*kept, *added])

    return rows.mapInArrow(scan, schema)


def restored(output: Column, form: Column) -> Column:
    """The exact text of an output: it holds each sentinel once, in the form's order."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    psm = F.concat(F.get(parts, 1), F.get(parts, 3), F.get(parts, 2))
    spm = F.concat(F.get(parts, 2), F.get(parts, 3), F.get(parts, 1))
    return F.when(form == "plain", output).when(form == "psm", psm).when(form == "spm", spm)


def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    made = fill_in_middle(docs)
    text = restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(text.cast("binary"), 256).alias("restored_sha256"))


OP11_SQL = r"""
WITH a AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS t FROM documents),
b AS (SELECT *, len(t) AS n, [CAST('0x' || substr(h, 8 * k + 1, 8) AS BIGINT) FOR k IN range(4)] AS d FROM a),
c AS (SELECT *, least(d[1] % (n + 1), d[2] % (n + 1)) AS i, greatest(d[1] % (n + 1), d[2] % (n + 1)) AS j,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR d[3] % 100 >= 50 THEN 'plain' WHEN d[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM b),
e AS (SELECT *, coalesce(array_to_string(t[1:i], ''), '') AS p, coalesce(array_to_string(t[i + 1:j], ''), '') AS m, coalesce(array_to_string(t[j + 1:n], ''), '') AS s FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM e
"""
