"""Flat files in the shared folder, written and read by Python workers through pyarrow's filesystems."""

from __future__ import annotations

import os
import uuid

import numpy as np
from pyarrow import fs as pafs
from pyspark import SparkFiles


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def new_tag() -> str:
    """What ends the names of one attempt's files."""
    return uuid.uuid4().hex[:12]


def open_new(folder: str, name: str, tag: str | None = None) -> tuple[str, object]:
    """A new file under ``folder`` with a name that no other attempt of the task uses; (URI, writable stream)."""
    uri = f"{folder}/{name}-{tag or new_tag()}"
    fs, path = filesystem(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    return uri, fs.open_output_stream(path)


def save_array(folder: str, name: str, values: np.ndarray, tag: str | None = None) -> str:
    uri, out = open_new(folder, name, tag)
    with out:
        out.write(memoryview(np.ascontiguousarray(values)).cast("B") if len(values) else b"")
    return uri


def array_uri(folder: str, name: str, tag: int) -> str:
    return f"{folder}/{name}-{tag:012x}"


def map_array(uri: str, dtype: str) -> np.ndarray:
    """The file as a memory-mapped array.

    A folder mounted on every machine is mapped where it is.  A file in another store is copied once to the folder in
    which Spark keeps an executor's files, where all of its workers map it and which goes with the executor.
    """
    fs, path = filesystem(uri)
    if not isinstance(fs, pafs.LocalFileSystem):
        own = f"{SparkFiles.getRootDirectory()}/{uri.rpartition('/')[2]}"
        if not os.path.exists(own):
            part = f"{own}.{uuid.uuid4().hex[:12]}"
            pafs.copy_files(path, part, source_filesystem=fs, destination_filesystem=pafs.LocalFileSystem())
            os.replace(part, own)
        path = own
    if not os.path.getsize(path):
        return np.zeros(0, dtype)
    return np.memmap(path, dtype, mode="r")
