"""Tables that change together: versioned Parquet folders behind one manifest.

A commit writes each changed table to a folder of its own, then one manifest that names the folder of
every table. Readers follow the newest manifest, so they see all changes of a commit or none: what
fails before the manifest is there leaves the old state. A manifest is made under a temporary name and renamed to
its number, which no other writer may have taken: of two commits on one state the second is refused.
The store needs a file system whose rename is atomic and never overwrites (HDFS, local, not plain object stores).
"""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Conflict(Exception):
    """Another commit came first."""


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; only a local master without that setting gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/rallyframe/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written as Parquet to the shared folder and read again: computed once, however often they are used."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Store:
    """The tables below ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The number of the newest manifest; 0 for an empty store."""
        folder = self._path(self.path)
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return max((int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json")), default=0)

    def _manifest(self, version: int) -> dict[str, str]:
        if not version:
            return {}
        stream = self._fs.open(self._path(f"{self.path}/manifest-{version:010d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def tables(self, version: int | None = None) -> dict[str, DataFrame]:
        """All tables of one version (the newest): they belong together."""
        found = self._manifest(self.version() if version is None else version)
        return {name: self.spark.read.parquet(f"{self.path}/{folder}") for name, folder in found.items()}

    def read(self, name: str) -> DataFrame:
        return self.tables()[name]

    def commit(self, changed: dict[str, DataFrame], base: int | None = None) -> int:
        """Write the changed tables and switch to them at once; ``base`` is the version they were made from (the newest)."""
        base = self.version() if base is None else base
        manifest = self._manifest(base)
        for name, df in changed.items():
            folder = f"{name}/{uuid.uuid4().hex}"
            df.write.parquet(f"{self.path}/{folder}")
            manifest[name] = folder
        self._switch(manifest, base + 1)
        return base + 1

    def _switch(self, manifest: dict[str, str], version: int) -> None:
        made, final = self._path(f"{self.path}/.{uuid.uuid4().hex}"), self._path(f"{self.path}/manifest-{version:010d}.json")
        stream = self._fs.create(made, False)
        try:
            stream.write(bytearray(json.dumps(manifest).encode()))
        finally:
            stream.close()
        if self._fs.exists(final) or not self._fs.rename(made, final):
            self._fs.delete(made, False)
            raise Conflict(f"version {version} of {self.path} is taken")

    def vacuum(self, keep: int = 2) -> int:
        """Delete folders that none of the newest ``keep`` manifests names, and older manifests; returns how many went. Not while a commit runs."""
        newest = self.version()
        kept = {f for v in range(max(1, newest - keep + 1), newest + 1) for f in self._manifest(v).values()}
        gone = 0
        for v in range(1, newest - keep + 1):
            gone += bool(self._fs.delete(self._path(f"{self.path}/manifest-{v:010d}.json"), False))
        for table in {f.split("/")[0] for f in kept}:
            for f in self._fs.listStatus(self._path(f"{self.path}/{table}")):
                if f"{table}/{f.getPath().getName()}" not in kept:
                    gone += bool(self._fs.delete(f.getPath(), True))
        return gone
