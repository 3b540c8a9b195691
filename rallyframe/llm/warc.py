"""WARC archives with a two-level capture index.

``write_warcs`` writes one record for each page into gzip-per-record WARC files, one file for each
task. Of records with equal payloads (by SHA-1) of at least ``least_revisit`` bytes the one with the
largest page id is the response and the others are revisits that refer to it.

``build_index`` sorts the captures by reversed-host URL key and page id over range partitions. Each
partition is a shard: compressed blocks of lines, and beside it a sparse directory with the first
key of each block. The list of shards (one row for each partition, however many pages) is the top.
``look_up`` finds keys by binary search: in the shard list, in a shard's directory, and in one block,
then reads a record by its byte range.

Null html counts as empty. A null URL has the key of the empty URL. Equal payloads under one page
id (repeated rows) are all responses; different payloads under one page id are captures of their own.
A null page id counts as the smallest. All rows are kept; pages of any length are single records, of
which a task holds one at a time beside its batch of 512. An empty table gives no captures. Extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import zlib
from collections.abc import Iterator
from functools import lru_cache
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rallyframe.llm.common import scratch_path, small, table, written
from rallyframe.llm.files import new_file, open_fs
from rallyframe.llm.urls import url_parts

BLOCK_LINES = 1000
DATE = "1970-01-01T00:00:00Z"
ID = "urn:page:"
_SAFE = str.maketrans({c: f"%{c:02X}" for c in (*range(33), 127)})
CAPTURE = "url_key string, page_id long, path string, offset long, length long"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def url_key(url):
    """Reversed host, a bracket, and the rest of the URL, as a column."""
    host, _ = url_parts(url)
    url = F.coalesce(url, F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3 + F.length(host), F.length(url))).otherwise(url)
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One uncompressed record. A revisit holds the HTTP headers only, the payload's length among them."""
    digest = base32_sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http + payload if kind == "response" else http
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{ID}{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {(url or '').translate(_SAFE)}", f"WARC-Payload-Digest: sha1:{digest}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{ID}{'' if refers_to is None else refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + body + b"\r\n\r\n"


def packed(data: bytes, level: int = 1) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def parsed(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Record headers, HTTP headers and payload of an uncompressed record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    named = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    body = rest[: int(named["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    return named, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


def _id(value: str) -> int | None:
    value = value.strip("<>").removeprefix(ID)
    return int(value) if value else None


def task_count(spark: SparkSession, size: int, least: int = 1 << 20, most: int = 64 << 20) -> int:
    """Tasks for ``size`` bytes: of ``least`` or more each, up to the session's shuffle partitions; beyond these of at most ``most``."""
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(usual, ceil(size / least)), ceil(size / most))


def write_warcs(pages: DataFrame, folder: str, least_revisit: int = 0) -> DataFrame:
    """Write all pages; returns the captures (url_key, page_id, path, offset, length)."""
    html = F.coalesce(F.col("html"), F.lit(""))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.sha1(html.cast("binary")).alias("digest"), url_key(F.col("url")).alias("url_key"))
    large = F.octet_length("html") >= least_revisit
    groups = pages.where(large).groupBy("digest").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).where("n > 1").select("digest", "response", F.lit(True).alias("shared"))
    groups = written(groups, "groups")  # so that the join can split the rows of a payload that very many pages share
    decided = pages.join(groups, "digest", "left").select("page_id", "url", "html", "url_key", "response", (F.col("shared").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response"))).alias("revisit"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, uri = None, None
        for batch in small(batches):
            if out is None:
                uri = new_file(f"{folder}/warc", ".warc.gz")
                fs, path = open_fs(uri)
                out, at = fs.open_output_stream(path, compression=None), 0
                info = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:file:" + uri.rpartition("/")[2].encode() + f">\r\nWARC-Date: {DATE}\r\nContent-Type: application/warc-fields\r\nContent-Length: 0\r\n\r\n\r\n\r\n".encode()
                out.write(packed(info))
                at += len(packed(info))
            offsets, lengths = [], []
            for page, url, text, response, revisit in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "response", "revisit"))):
                data = packed(record("revisit" if revisit else "response", page, url, text.encode(), response))
                out.write(data)
                offsets.append(at)
                lengths.append(len(data))
                at += len(data)
            yield pa.record_batch([batch.column("url_key"), batch.column("page_id"), pa.array([uri] * len(offsets), pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], names=["url_key", "page_id", "path", "offset", "length"])
        if out is not None:
            out.close()

    return written(decided.mapInArrow(write, CAPTURE), "captures")


def _key(url: str, page: int | None) -> tuple[bytes, int]:
    return url.encode(), -(1 << 64) if page is None else page


def build_index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> list[tuple]:
    """Write the index; returns the shard list: (first URL key, first page id, shard URI), sorted."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, directory, lines, first, at = None, [], [], None, 0

        def flush() -> None:
            nonlocal at, lines
            data = packed("\n".join(lines).encode(), 6)
            out.write(data)
            directory.append([*json.loads(lines[0])[:2], at, len(data)])
            at += len(data)
            lines = []

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("url_key", "page_id", "path", "offset", "length"))):
                if out is None:
                    uri, first = new_file(f"{folder}/index", ".cdx"), row[:2]
                    fs, path = open_fs(uri)
                    out = fs.open_output_stream(path, compression=None)
                lines.append(json.dumps(row))
                if len(lines) >= block_lines:
                    flush()
        if out is None:
            return
        if lines:
            flush()
        out.close()
        with fs.open_output_stream(path + ".dir", compression=None) as d:
            d.write(packed("\n".join(map(json.dumps, directory)).encode(), 6))
        yield pa.record_batch([pa.array([first[0]], pa.string()), pa.array([first[1]], pa.int64()), pa.array([uri], pa.string())], names=["url_key", "page_id", "shard"])

    shards = written(captures.repartitionByRange("url_key", "page_id").sortWithinPartitions("url_key", "page_id").mapInArrow(write, "url_key string, page_id long, shard string"), "shards")
    return sorted((tuple(r) for r in shards.collect()), key=lambda r: _key(r[0], r[1]))


class Index:
    """An index as one task sees it; only the directories and blocks that the task's keys need are loaded."""

    def __init__(self, shards: list[tuple]):
        self.shards, self.firsts = shards, [_key(s[0], s[1]) for s in shards]
        self.directory = lru_cache(4)(self._directory)
        self.block = lru_cache(8)(self._block)
        self.file = lru_cache(64)(self._file)

    def _file(self, uri: str):
        fs, path = open_fs(uri)
        return fs.open_input_file(path)

    def _range(self, uri: str, offset: int, length: int) -> bytes:
        return zlib.decompress(self.file(uri).read_at(length, offset), 31)

    def _directory(self, shard: str) -> tuple[list, list]:
        with self._file(shard + ".dir") as f:
            rows = [json.loads(x) for x in zlib.decompress(f.read(), 31).splitlines()]
        return [_key(r[0], r[1]) for r in rows], rows

    def _block(self, shard: str, offset: int, length: int) -> tuple[list, list]:
        rows = [json.loads(x) for x in self._range(shard, offset, length).decode().split("\n")]
        return [_key(r[0], r[1]) for r in rows], rows

    def find(self, url: str, page: int | None) -> list[tuple[str, int, int]]:
        """(path, offset, length) of all captures with this key."""
        key, found = _key(url, page), []
        s = max(0, bisect.bisect_left(self.firsts, key) - 1)
        while s < len(self.shards) and (self.firsts[s] <= key):
            firsts, blocks = self.directory(self.shards[s][2])
            b = max(0, bisect.bisect_left(firsts, key) - 1)
            while b < len(blocks) and firsts[b] <= key:
                keys, rows = self.block(self.shards[s][2], blocks[b][2], blocks[b][3])
                i = bisect.bisect_left(keys, key)
                while i < len(keys) and keys[i] == key:
                    found.append((rows[i][2], rows[i][3], rows[i][4]))
                    i += 1
                b += 1
            s += 1
        return found


def look_up(keys: DataFrame, shards: list[tuple], size: int = 0) -> DataFrame:
    """For each (url_key, page_id): what the records of its captures say, payloads re-read and checked.

    ``size``: bytes of the records to be read, from which the number of tasks follows (keys are small
    beside what they make a task read).
    """
    top = keys.sparkSession.sparkContext.broadcast(shards)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(top.value)
        for batch in batches:
            places = []
            for url, page in zip(batch.column("url_key").to_pylist(), batch.column("page_id").to_pylist()):
                places += index.find(url, page)
            out = []
            for path, offset, length in sorted(places):
                named, http, payload = parsed(index._range(path, offset, length))
                digest, kind = named["WARC-Payload-Digest"].removeprefix("sha1:"), named["WARC-Type"]
                if kind == "response" and (base32_sha1(payload) != digest or len(payload) != int(http["Content-Length"])):
                    raise ValueError(f"{path} at {offset}: the payload does not fit its digest")
                out.append((_id(named["WARC-Record-ID"]), int(http["Content-Length"]), digest, kind, _id(named["WARC-Refers-To"]) if kind == "revisit" else None))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.record_batch([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    tasks = task_count(keys.sparkSession, size)
    sorted_keys = keys.distinct().repartitionByRange(tasks, "url_key", "page_id").sortWithinPartitions("url_key", "page_id")
    return sorted_keys.mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, folder = table(spark, sf_dir, "pages"), scratch_path(spark, "warc")
    captures = write_warcs(pages, folder)
    size = captures.agg(F.sum("length")).first()[0] or 0
    keys = pages.select(url_key(F.col("url")).alias("url_key"), F.col("page_id").cast("long").alias("page_id"))
    return look_up(keys, build_index(captures, folder), size)
