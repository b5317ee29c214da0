"""Files that Python tasks write to and read from the shared folder."""

from __future__ import annotations

import os
import re
import uuid
from urllib.parse import unquote, urlparse

import numpy as np


def qualified(spark, folder: str) -> str:
    """The folder as a URI; a path without a scheme is one of the session's default store, as it is for Spark's own readers."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    uri = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return "file://" + uri.removeprefix("file:") if re.match("file:/[^/]", uri) else uri


def local_path(uri: str) -> str | None:
    """The path of a file: URI or a plain path, None for any other store."""
    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        return unquote(parts.path)
    return None


def put(uri: str, write) -> None:
    """write(file) makes the file; it appears under its name only when whole, so a task that runs again does no harm."""
    path = local_path(uri)
    if path is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        part = f"{path}.{uuid.uuid4().hex}.part"
        try:
            with open(part, "wb") as f:
                write(f)
            os.replace(part, path)
        except BaseException:
            if os.path.exists(part):
                os.remove(part)
            raise
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    part = f"{path}.{uuid.uuid4().hex}.part"
    store.create_dir(os.path.dirname(path), recursive=True)
    with store.open_output_stream(part) as f:
        write(f)
    store.move(part, path)


def array(uri: str, dtype: str) -> np.ndarray:
    """The file as an array: memory-mapped, or read where the store has no local path."""
    path = local_path(uri)
    if path is not None:
        return np.memmap(path, dtype=dtype, mode="r") if os.path.getsize(path) else np.zeros(0, dtype)
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype=dtype)


def read_table(uri: str):
    """A parquet file as an Arrow table."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    path = local_path(uri)
    if path is not None:
        return pq.read_table(path)
    store, path = fs.FileSystem.from_uri(uri)
    return pq.read_table(path, filesystem=store)

