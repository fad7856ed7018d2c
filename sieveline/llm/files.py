"""Files in the shared folder, read and written by any executor through Arrow's file systems."""

from __future__ import annotations

import time

import pyarrow as pa
from pyarrow import fs


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI (or of a plain local path) and the path in it."""
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def create(uri: str) -> pa.NativeFile:
    system, path = open_fs(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    return system.open_output_stream(path)


def read_at(uri: str) -> pa.NativeFile:
    system, path = open_fs(uri)
    return system.open_input_file(path)


def remove(uri: str) -> None:
    system, path = open_fs(uri)
    if system.get_file_info(path).type != fs.FileType.NotFound:
        system.delete_file(path)


def ages(uri: str) -> list[tuple[str, float]]:
    """(name, seconds since it was written) of the files of a folder; none if there is no such folder."""
    system, path = open_fs(uri)
    now = time.time()
    return [(f.base_name, now - f.mtime.timestamp()) for f in system.get_file_info(fs.FileSelector(path, allow_not_found=True)) if f.type == fs.FileType.File]
