"""Files read inside tasks by their paths, in pieces, so that memory does not grow with a file."""

from __future__ import annotations

import hashlib
from functools import lru_cache

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

#: Bytes that are held at once.
PIECE = 4 << 20


def listing(spark: SparkSession, path: str) -> DataFrame:
    """path, length of all files below path (or of the file it names); no content is read. Spark lists no files of no bytes."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found.select("path", "length")


@lru_cache(maxsize=64)
def _system(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root)


def opened(path: str):
    """A file with read and seek, by a path as Spark lists it: without escapes, ``file:/...`` or ``scheme://authority/...``."""
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return fs.LocalFileSystem().open_input_file(path)
    if scheme == "file":
        return fs.LocalFileSystem().open_input_file("/" + rest.lstrip("/"))
    authority, _, name = rest.removeprefix("//").partition("/")
    system, base = _system(f"{'s3' if scheme in ('s3a', 's3n') else scheme}://{authority}/")
    return system.open_input_file(f"{base.rstrip('/')}/{name}")


def sha256(path: str, piece: int = PIECE) -> str:
    digest = hashlib.sha256()
    with opened(path) as f:
        while held := f.read(piece):
            digest.update(held)
    return digest.hexdigest()
