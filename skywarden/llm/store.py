"""Files in a folder that all executors share, by URI, from inside tasks."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyarrow import fs


def place(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI (or of an absolute local path)."""
    for hadoop, own in (("s3a://", "s3://"), ("file:/", "file:///")):
        if uri.startswith(hadoop) and not uri.startswith("file:///"):
            uri = own + uri[len(hadoop):]
    return fs.FileSystem.from_uri(uri)


@contextmanager
def committed(uri: str, attempt: int) -> Iterator[pa.NativeFile]:
    """An output stream whose file appears under its name only when it is complete; a repeated task replaces it."""
    system, path = place(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{attempt}.part"
    with system.open_output_stream(part) as out:
        yield out
    system.move(part, path)
