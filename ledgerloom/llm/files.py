"""Byte files in the shared folder, from executors as from the driver.

``pyarrow.fs`` reaches local paths, HDFS, S3 and GCS by URI, can seek, and does
not need Spark on the executor. A file is written under an attempt's own name
and then moved, so a task that runs twice leaves one whole file.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyarrow import fs


def _at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def make_dir(path: str) -> None:
    store, p = _at(path)
    store.create_dir(p, recursive=True)


@contextlib.contextmanager
def writing(path: str) -> Iterator:
    """A stream whose file appears at ``path`` when the block ends without error."""
    store, p = _at(path)
    part = f"{p}.{uuid.uuid4().hex}.tmp"
    stream = store.open_output_stream(part, compression=None)
    try:
        yield stream
    except BaseException:
        stream.close()
        store.delete_file(part)
        raise
    stream.close()
    store.move(part, p)


def opened(path: str):
    """A file open for reading at any position."""
    store, p = _at(path)
    return store.open_input_file(p)


def size_of(path: str) -> int | None:
    """None if there is no such file."""
    store, p = _at(path)
    return store.get_file_info(p).size
