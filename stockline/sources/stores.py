"""Small file operations in any store that Spark reads, through Hadoop's file API.

For listings and single small files only; tables go through Spark's readers and
writers.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterable, Iterator

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def store(spark: SparkSession, path: str):
    """(file system, path) objects of Hadoop's API for a path."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if there is no such folder."""
    fs, where = store(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def create_new(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file with this content; False if there is one already."""
    fs, where = store(spark, path)
    if fs.getScheme() == "file":
        # the local file system's own create checks first and creates later
        local = where.toUri().getPath()
        os.makedirs(os.path.dirname(local), exist_ok=True)
        try:
            with open(local, "x", encoding="utf-8") as f:
                f.write(text)
        except FileExistsError:
            return False
        return True
    try:
        out = fs.create(where, False)
    except Py4JJavaError as error:
        if "AlreadyExists" in error.java_exception.getClass().getName():
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that the caller has written itself."""
    fs, where = store(spark, path)
    fs.delete(where, True)


def _files(spark: SparkSession, path: str) -> Iterator[tuple[str, int, int]]:
    """(name below the path, bytes, modification time) of its data files; none for a missing path."""
    fs, where = store(spark, path)
    if not fs.exists(where):
        return
    listing, base = fs.listFiles(where, True), str(fs.makeQualified(where))
    while listing.hasNext():
        status = listing.next()
        name = str(status.getPath()).removeprefix(base)
        # hidden files, which Spark's readers skip too
        if not any(part.startswith(("_", ".")) for part in name.split("/")):
            yield name, status.getLen(), status.getModificationTime()


def file_sizes(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(name, bytes) of the data files under a path."""
    return [(name, size) for name, size, _ in _files(spark, path)]


def fingerprint(spark: SparkSession, paths: Iterable[str]) -> str:
    """A digest of the files under these paths: their names, sizes and modification times.

    Equal as long as no file is added, removed or rewritten.  Only the listing is
    read, never content, so a file rewritten with as many bytes within the
    store's clock resolution goes unnoticed.
    """
    digest = hashlib.sha256()
    for path in sorted(paths):
        digest.update(f"{path}\n".encode())
        digest.update("".join(sorted(f"{n}\t{size}\t{time}\n" for n, size, time in _files(spark, path))).encode())
    return digest.hexdigest()
