"""A source of requests that keeps a pace: no trigger takes more than its slots.

The requests lie in Parquet at ``path`` (seq: whole numbers from 0 without gaps; url) and are taken in order. A
trigger every ``interval_ms`` with a spacing of ``spacing_ms`` has floor(interval / spacing) slots, or ``slots`` if
given. An offset is the number of requests taken so far; a batch that is run again from a checkpoint has the
same rows. A trigger's few rows pass through the driver; the list of requests does not: only rows between two
offsets are read. Requests added later are taken when their turn comes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow.compute as pc
import pyarrow.dataset as pads
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

SPACING_MS = 1500


class PacedReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        spacing = int(options.get("spacing_ms", SPACING_MS))
        self.slots = int(options["slots"]) if "slots" in options else int(options["interval_ms"]) // spacing
        if self.slots < 1 or spacing < 1:
            raise ValueError("a trigger must have a slot at least")

    def initialOffset(self) -> dict:
        return {"taken": 0}

    def _rows(self, start: int, end: int) -> list[tuple[int, str]]:
        fs, path = pafs.FileSystem.from_uri(self.path) if "://" in self.path else (pafs.LocalFileSystem(), self.path)
        files = pads.dataset(path, filesystem=fs, format="parquet")
        found = files.to_table(columns=["seq", "url"], filter=(pc.field("seq") >= start) & (pc.field("seq") < end))
        return sorted(zip(found["seq"].to_pylist(), found["url"].to_pylist()))

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows = self._rows(start["taken"], start["taken"] + self.slots)
        return iter(rows), {"taken": start["taken"] + len(rows)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self._rows(start["taken"], end["taken"]))


class PacedRequests(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paced_requests"

    def schema(self) -> str:
        return "seq long, url string"

    def simpleStreamReader(self, schema) -> PacedReader:
        return PacedReader(self.options)


def paced(spark: SparkSession, path: str, **options: int):
    """The stream of requests (seq, url) at ``path``; options: slots, or interval_ms and spacing_ms."""
    spark.dataSource.register(PacedRequests)
    return spark.readStream.format("paced_requests").options(path=path, **{k: str(v) for k, v in options.items()}).load()
