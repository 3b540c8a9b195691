"""Media columns: payloads in archives, read by a custom Spark data source.

``write_archives`` stores each payload as a WAV member (8-bit mono samples, one for each byte) of a
ZIP archive, one archive for each task, in the shared folder, and lists the finished archives in a
manifest table. The data source ``media_archive`` plans byte ranges over the archives of a manifest:
a task opens an archive's directory, takes the members whose headers begin in its range, and
streams their payloads in Arrow batches of bounded size. Each member is read on its own by its
offset and retried on its own; one that stays unreadable gives a row with ``error`` set and no media.

A payload is the text in UTF-8 (null: empty) and bytes 0 up to a positive multiple of 64. A very long text is
one member, which its task holds whole. Equal texts give equal media. Repeated rows and rows with a null id are kept as they are. An empty table
gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zipfile
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from rallyframe.llm.common import scratch_path, table
from rallyframe.llm.files import new_file, open_fs

UNIT = 64
RATE = 16000
RANGE_BYTES = 32 << 20
BATCH_BYTES = 8 << 20
TRIES = 3
LEVEL = 1
SCHEMA = "key long, n_bytes long, archive string, header_offset long, media binary, error string"


def payload_of(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % UNIT if raw else UNIT)


def wav(payload: bytes) -> bytes:
    n = len(payload)
    return b"RIFF" + struct.pack("<I", 36 + n) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", n) + payload


def samples(media: bytes) -> bytes:
    """The samples of a WAV file, found by its chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at = 12
    while at + 8 <= len(media):
        kind, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if kind == b"data":
            return media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def write_archives(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text") -> str:
    """Write all rows' payloads; returns the URI of the manifest (Parquet: archive, bytes, members)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = (b for b in batches if b.num_rows)
        first = next(full, None)
        if first is None:  # a task without rows leaves no archive
            return
        uri, members = new_file(f"{folder}/archives", ".zip"), 0
        fs, path = open_fs(uri)
        with fs.open_output_stream(path, compression=None) as out, zipfile.ZipFile(out, "w") as z:
            for batch in chain([first], full):
                for k, t in zip(batch.column("key"), batch.column("text")):
                    value, body = k.as_py(), t.as_py() or ""
                    info = zipfile.ZipInfo(f"{members}.wav")
                    info.comment = json.dumps([value, len(body.encode())]).encode()
                    z.writestr(info, wav(payload_of(body)), zipfile.ZIP_DEFLATED, compresslevel=LEVEL)
                    members += 1
        size = fs.get_file_info(path).size
        yield pa.record_batch([pa.array([uri]), pa.array([size], pa.int64()), pa.array([members], pa.int64())], names=["archive", "bytes", "members"])

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    rows.mapInArrow(write, "archive string, bytes long, members long").write.parquet(f"{folder}/manifest")
    return f"{folder}/manifest"


class ByteRange(InputPartition):
    def __init__(self, archive: str, first: int, last: int):
        self.archive, self.first, self.last = archive, first, last


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.manifest = options["manifest"]
        self.range_bytes = int(options.get("range_bytes", RANGE_BYTES))
        self.batch_bytes = int(options.get("batch_bytes", BATCH_BYTES))
        self.tries = int(options.get("tries", TRIES))

    def partitions(self) -> list[ByteRange]:
        """Byte ranges over the archives; no member is looked at here."""
        fs, path = open_fs(self.manifest)
        listed = pq.read_table(path, filesystem=fs, columns=["archive", "bytes"]).to_pylist()
        return [ByteRange(r["archive"], at, at + self.range_bytes) for r in sorted(listed, key=lambda r: r["archive"]) for at in range(0, r["bytes"], self.range_bytes)]

    def _member(self, uri: str, offset: int, info: zipfile.ZipInfo, opened: list) -> tuple[bytes | None, str | None]:
        why = None
        for _ in range(self.tries):
            try:
                if not opened:
                    fs, path = open_fs(uri)
                    opened.append(zipfile.ZipFile(fs.open_input_file(path)))
                with opened[0].open(info) as f:  # seeks to the member's own offset and checks its CRC
                    return f.read(), None
            except (OSError, zipfile.BadZipFile, zlib.error, EOFError) as e:
                why = f"{uri} at {offset}: {e}"[:300]
                opened.clear()
        return None, why

    def read(self, part: ByteRange) -> Iterator[pa.RecordBatch]:
        fs, path = open_fs(part.archive)
        opened = [zipfile.ZipFile(fs.open_input_file(path))]
        members = sorted((i for i in opened[0].infolist() if part.first <= i.header_offset < part.last), key=lambda i: i.header_offset)
        rows, size = [], 0
        for info in members:
            key, n = json.loads(info.comment)
            media, why = self._member(part.archive, info.header_offset, info, opened)
            rows.append((key, n, part.archive, info.header_offset, media, why))
            size += len(media or b"")
            if size >= self.batch_bytes:
                yield self._batch(rows)
                rows, size = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string())
        names = ["key", "n_bytes", "archive", "header_offset", "media", "error"]
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def read_archives(spark: SparkSession, manifest: str, **options) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("media_archive").options(manifest=manifest, **options).load()


def feature_of(payload: bytes) -> str:
    """Sample count, least, largest, sum, energy about the middle level, crossings of it, and energy of differences."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64)
    c = x - 128
    up = c >= 0
    return f"n={len(x)};min={x.min()};max={x.max()};sum={x.sum()};energy={(c * c).sum()};crossings={(up[1:] != up[:-1]).sum()};difference={(np.diff(x) ** 2).sum()}"


def media_features(media: DataFrame) -> DataFrame:
    """What ``op7_media`` returns, from the rows of the data source. An unreadable member fails the query: rows are not dropped."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, n, body, why in zip(*(batch.column(c) for c in ("key", "n_bytes", "media", "error"))):
                if why.as_py():
                    raise OSError(why.as_py())
                body = body.as_py()
                p = samples(body)
                out.append((key.as_py(), n.as_py(), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-UNIT:]), len(body), hashlib.sha256(body).hexdigest(), feature_of(p)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.record_batch([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)

    return media.select("key", "n_bytes", "media", "error").mapInArrow(digest, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_archives(table(spark, sf_dir, "documents"), scratch_path(spark, "media"))
    return media_features(read_archives(spark, manifest))
