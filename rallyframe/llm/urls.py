"""URL filters by a bit-parallel wildcard automaton.

Glob rules are packed into one multiword Shift-And automaton. Every rule symbol is one bit; a
character's mask has the bits of the symbols that accept it; ``*`` is a loop on the bit before it.
All rules advance together over each canonical URL, and the batch of URLs advances together.

Canonical URL: ``.host``, a boundary, then the path. Host: after the first ``://`` up to ``/``,
``?``, ``#`` or the end, A-Z lower-cased. Path: from there up to ``?``, ``#`` or the end. A null URL, or
one without ``://``, has an empty host and path. In a rule's glob, ``*`` stands for any run, ``?`` for
one character, and ``\\n`` for the boundary (no other byte of a canonical URL becomes one).

A rule (host, path) fits its host and all its subdomains if the URL's path starts with the rule's.
Of the fitting rules the longest wins (a tie: the first of equals by text). Where none fits, the
general globs decide: block if any fits, else allow. All rows are kept, those with a null or repeated
key too; an empty table gives none. URLs of any length are read whole, in slices of bounded size. Extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rallyframe.llm.common import table
from rallyframe.llm.text import slices

BOUNDARY = 0xFF
RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))
BLOCK_GLOBS = ("*cheap-pills.*\n*", "*casino-win.*\n*", "*free-bets.*\n*", "*adult-?.*\n*", "*spam-farm.*\n*", "*.ads-track.*\n*", "*\n*.exe", "*\n*/wp-login*")


@dataclass
class Automaton:
    """``accepts``: 256 masks; ``loops``: bits with a loop; ``first``: first symbols of a rule, ``anywhere``: those behind a leading ``*``, ``tails``: bits that stay for the further bytes of a character."""

    accepts: np.ndarray
    loops: np.ndarray
    first: np.ndarray
    anywhere: np.ndarray
    tails: np.ndarray
    finals: list[int | None]

    @classmethod
    def of(cls, globs: list[str]) -> Automaton:
        symbols: list[tuple[int, int]] = []  # (rule, byte or -1 for any)
        loops, first, anywhere, finals = set(), set(), set(), []
        for k, glob in enumerate(globs):
            parts, begun, after_star = glob.encode().replace(b"\n", bytes([BOUNDARY])), False, False
            for c in parts:
                if c == 0x2A:
                    if begun:
                        loops.add(len(symbols) - 1)
                    after_star = True
                    continue
                if not begun:
                    (anywhere if after_star else first).add(len(symbols))
                symbols.append((k, -1 if c == 0x3F else c))
                begun = True
            finals.append(len(symbols) - 1 if begun else None)
        words = max(1, -(-len(symbols) // 64))

        def mask(bits) -> np.ndarray:
            out = np.zeros(words, np.uint64)
            for b in bits:
                out[b // 64] |= np.uint64(1) << np.uint64(b % 64)
            return out

        accepts = np.zeros((256, words), np.uint64)
        for c in range(256):
            begins = c < 0x80 or 0xC0 <= c != BOUNDARY
            accepts[c] = mask(i for i, (_, s) in enumerate(symbols) if s == c or (s == -1 and begins))
        # a rule's first symbol must not be reached from the rule before it
        return cls(accepts, mask(loops), mask(first), mask(anywhere), mask(i for i, (_, s) in enumerate(symbols) if s == -1), finals)

    def fits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Row by rule: whether the rule fits the whole row."""
        n, words, one = len(offsets) - 1, self.accepts.shape[1], np.uint64(1)
        size = np.diff(offsets)
        order = np.argsort(-size, kind="stable")
        begin, size = offsets[:-1][order], size[order]
        state = np.zeros((n, words), np.uint64)
        heads = self.first | self.anywhere
        for j in range(int(size[0]) if n else 0):
            live = int(np.searchsorted(-size, -j, "left"))  # rows longer than j stand first
            s = state[:live]
            up = s << one
            up[:, 1:] |= s[:, :-1] >> np.uint64(63)
            up = (up & ~heads) | (heads if j == 0 else self.anywhere)
            byte = data[begin[:live] + j]
            stay = np.where(((byte & 0xC0) == 0x80)[:, None], self.loops | self.tails, self.loops)
            state[:live] = (up & self.accepts[byte]) | (s & stay)
        out = np.zeros((n, len(self.finals)), bool)
        for k, f in enumerate(self.finals):
            out[order, k] = True if f is None else (state[:, f // 64] >> np.uint64(f % 64)) & one == 1
        return out


def url_parts(url) -> tuple:
    """Columns host and path of a URL column."""
    url = F.coalesce(url, F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.regexp_extract(rest, r"(?s)^([^?#]*)", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/]*)", 1)
    path = F.substring(rest, F.length(host) + 1, F.length(rest))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_glob(rule: str) -> str:
    host, slash, path = rule.partition("/")
    return f"*.{host}\n{slash}{path}*"


def judge(pages: DataFrame, rules: tuple = RULES, globs: tuple = BLOCK_GLOBS, key: str = "page_id") -> DataFrame:
    """``key``, host, path, rule (or null) and verdict of every row."""
    ranked = sorted(rules, key=lambda r: (-len(r[0]), r[0]))
    machine = Automaton.of([*(rule_glob(r) for r, _ in ranked), *globs])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            canonical = batch.column("__rf_url")
            for lo, hi, data, offsets in slices(canonical):
                fits = machine.fits(_with_boundary(data, offsets, batch.column("host").slice(lo, hi - lo)), offsets)
                chosen = np.where(fits[:, : len(ranked)].any(1), fits[:, : len(ranked)].argmax(1), -1).tolist()
                general = fits[:, len(ranked) :].any(1).tolist()
                names = [ranked[k][0] if k >= 0 else None for k in chosen]
                verdicts = [ranked[k][1] if k >= 0 else "block" if g else "allow" for k, g in zip(chosen, general)]
                part = batch.slice(lo, hi - lo)
                yield pa.record_batch([part.column(key), part.column("host"), part.column("path"), pa.array(names, pa.string()), pa.array(verdicts, pa.string())], names=[key, "host", "path", "rule", "verdict"])

    host, path = url_parts(F.col("url"))
    source = pages.select(F.col(key), host.alias("host"), path.alias("path")).withColumn("__rf_url", F.concat(F.lit("."), "host", F.lit("\n"), "path"))
    return source.mapInArrow(run, source.select(key, "host", "path").schema.add("rule", "string").add("verdict", "string"))


def _with_boundary(data: np.ndarray, offsets: np.ndarray, hosts: pa.Array) -> np.ndarray:
    """The byte behind ``.host`` made the boundary, which no byte of UTF-8 equals."""
    out = data.copy()
    out[offsets[:-1] + 1 + pc.binary_length(hosts.cast(pa.binary())).to_numpy()] = BOUNDARY
    return out


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select(F.col("page_id").cast("long").alias("page_id"), "url"))


_HOST = r"translate(regexp_extract(regexp_extract(substr(coalesce(url, ''), strpos(coalesce(url, ''), '://') + 3), '^([^?#]*)', 1), '^([^/]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = r"regexp_extract(regexp_extract(substr(coalesce(url, ''), strpos(coalesce(url, ''), '://') + 3), '^([^?#]*)', 1), '(?s)^[^/]*(.*)$', 1)"
OP8_SQL = f"""
WITH parts AS (
  SELECT page_id,
         CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN {_HOST} ELSE '' END AS host,
         CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN {_PATH} ELSE '' END AS path
  FROM pages),
ruled AS (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.example.net' AND path LIKE '/de/8%' THEN 'example.net/de/8'
    WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/en/7%' THEN 'example.com/en/7'
    WHEN ('.' || host) LIKE '%.com' AND path LIKE '/en/%' THEN 'com/en/'
    WHEN ('.' || host) LIKE '%.net' AND path LIKE '/de/%' THEN 'net/de/'
    WHEN ('.' || host) LIKE '%.org' AND path LIKE '/es/%' THEN 'org/es/' END AS rule
  FROM parts)
SELECT page_id, host, path, rule,
       CASE WHEN rule = 'example.com/en/7' THEN 'allow'
            WHEN rule IS NOT NULL THEN 'block'
            WHEN ('.' || host) LIKE '%cheap-pills.%' OR ('.' || host) LIKE '%casino-win.%' OR ('.' || host) LIKE '%free-bets.%'
              OR ('.' || host) LIKE '%adult-_.%' OR ('.' || host) LIKE '%spam-farm.%' OR ('.' || host) LIKE '%.ads-track.%'
              OR path LIKE '%.exe' OR path LIKE '%/wp-login%' THEN 'block'
            ELSE 'allow' END AS verdict
FROM ruled
"""
