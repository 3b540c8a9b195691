"""A sink of dossiers: one folder for each team, all checked before any of them can be seen.

Tasks check each row and write its files to a folder of the attempt. The commit checks the batch as a whole
(no folder twice, every attempt's files there) and then moves one pointer, ``CURRENT``, to the new
version; only after that is the old one deleted. A bad row, a double folder or a lost task leaves what was
there: the abort deletes the attempt's folder. What a task that is still running writes after that is seen by
nobody, and the next commit deletes it.

A row is directory and text, and may have name (``dossier.md`` by default). A directory is lower-case letters,
digits and single hyphens, as ``slug`` makes them; a text is not empty, begins with a heading or a doctype, and
holds no control characters but line breaks and tabs.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

DIRECTORY = re.compile(r"[a-z0-9]+(?:-[a-z0-9]+)*")
FILE = re.compile(r"[a-z0-9]+(?:-[a-z0-9]+)*\.(?:md|html)")
CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")


def fault(directory: str | None, name: str | None, text: str | None) -> str | None:
    """What is wrong with a row, or nothing."""
    if not DIRECTORY.fullmatch(directory or "") or len(directory) > 200:
        return f"{directory!r} is no folder name"
    if not FILE.fullmatch(name or ""):
        return f"{name!r} is no file name"
    if not (text or "").lstrip().lower().startswith(("# ", "<!doctype html>")):
        return f"{directory}/{name} does not begin with a heading"
    if found := CONTROL.search(text):
        return f"{directory}/{name} holds the control character {ord(found[0])}"
    return None


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class DossierWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"].rstrip("/")
        self.version = f"v-{uuid.uuid4().hex}"

    def _open(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.path) if "://" in self.path else (pafs.LocalFileSystem(), self.path)

    def write(self, rows: Iterator[Row]) -> Written:
        fs, base = self._open()
        files = []
        for row in rows:
            said = row.asDict()
            directory, name, text = said.get("directory"), said.get("name", "dossier.md"), said.get("text")
            if wrong := fault(directory, name, text):
                raise ValueError(wrong)
            # an attempt that is repeated writes under a name of its own; only the committed one is moved
            made = f"{base}/{self.version}/.parts/{uuid.uuid4().hex}"
            fs.create_dir(f"{base}/{self.version}/.parts", recursive=True)
            with fs.open_output_stream(made, compression=None) as out:
                out.write(text.encode())
            files.append(f"{directory}/{name}\t{made}")
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        fs, base = self._open()
        files = dict(f.split("\t") for m in messages for f in m.files)
        said = [f.split("\t")[0] for m in messages for f in m.files]
        if len(files) < len(said):
            twice = sorted({f for f in said if said.count(f) > 1})
            self.abort(messages)
            raise ValueError(f"several dossiers for {', '.join(twice[:5])}")
        fs.create_dir(f"{base}/{self.version}", recursive=True)
        for name, made in files.items():
            fs.create_dir(f"{base}/{self.version}/{name.split('/')[0]}")
            fs.move(made, f"{base}/{self.version}/{name}")
        if fs.get_file_info(f"{base}/{self.version}/.parts").type != pafs.FileType.NotFound:
            fs.delete_dir(f"{base}/{self.version}/.parts")
        pointer = f"{base}/.{uuid.uuid4().hex}"
        with fs.open_output_stream(pointer, compression=None) as out:
            out.write(self.version.encode())
        fs.move(pointer, f"{base}/CURRENT")
        for old in fs.get_file_info(pafs.FileSelector(base)):
            if old.type == pafs.FileType.Directory and old.base_name.startswith("v-") and old.base_name != self.version:
                fs.delete_dir(old.path)

    def abort(self, messages: list[Written | None]) -> None:
        fs, base = self._open()
        if fs.get_file_info(f"{base}/{self.version}").type != pafs.FileType.NotFound:
            fs.delete_dir(f"{base}/{self.version}")


class DossierSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "dossiers"

    def writer(self, schema: StructType, overwrite: bool) -> DossierWriter:
        return DossierWriter(self.options)


def write(dossiers: DataFrame, path: str) -> None:
    """Replace the dossiers at ``path`` by these (directory, text and, for several files of a folder, name), all or none."""
    dossiers.sparkSession.dataSource.register(DossierSink)
    columns = [c for c in ("directory", "name", "text") if c in dossiers.columns]
    dossiers.select(*columns).write.format("dossiers").mode("append").save(path)


def current(path: str) -> str | None:
    """The folder of the dossiers that are to be read, or None if nothing was ever committed."""
    fs, base = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path.rstrip("/"))
    if fs.get_file_info(f"{base}/CURRENT").type == pafs.FileType.NotFound:
        return None
    with fs.open_input_file(f"{base}/CURRENT") as f:
        return f"{path.rstrip('/')}/{f.read().decode()}"
