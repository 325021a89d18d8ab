"""Byte access to files of the shared folder from executors."""

from __future__ import annotations

import os
from contextlib import contextmanager
from urllib.parse import urlparse


def _local(uri: str) -> str | None:
    parts = urlparse(uri)
    return parts.path if parts.scheme in ("", "file") else None


def write_whole(uri: str, chunks) -> None:
    """Writes a new file; it gets its name only when complete."""
    path = _local(uri)
    if path is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(f"{path}.part", "wb") as f:
            for c in chunks:
                f.write(c)
        os.replace(f"{path}.part", path)
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with store.open_output_stream(f"{path}.part") as f:
        for c in chunks:
            f.write(c)
    store.move(f"{path}.part", path)


@contextmanager
def opened(uri: str):
    """A file that can be read at any offset: seek() and read()."""
    path = _local(uri)
    if path is not None:
        with open(path, "rb") as f:
            yield f
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_file(path) as f:
        yield f
