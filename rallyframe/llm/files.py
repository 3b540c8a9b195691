"""Files in the folder that driver and executors share, by URI."""

from __future__ import annotations

import uuid

import pyarrow.fs as pafs


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def new_file(folder: str, suffix: str) -> str:
    """The URI of a new file for one attempt of a task; only attempts that are listed in a manifest are read."""
    fs, path = open_fs(folder)
    fs.create_dir(path, recursive=True)
    return f"{folder}/{uuid.uuid4().hex}{suffix}"
