"""Files in the shared folder, written and read inside tasks through its own file system."""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from collections.abc import Iterator

import numpy as np
from pyarrow import fs


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or absolute path, and the path in it."""
    return fs.FileSystem.from_uri(folder if ":" in folder.split("/", 1)[0] else f"file://{folder}")


@contextmanager
def committed(store: fs.FileSystem, path: str) -> Iterator:
    """A stream under a temporary name that gets its own name when all is written; a task that dies leaves none."""
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(temporary) as out:
        yield out
    store.move(temporary, path)


def mapped(store: fs.FileSystem, path: str, dtype: str) -> np.ndarray:
    """A file as an array: memory-mapped where the store is a file system of this machine, else read."""
    if store.get_file_info(path).size == 0:
        return np.zeros(0, dtype)
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, dtype, "r")
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)
