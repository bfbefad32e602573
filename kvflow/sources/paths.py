"""Paths on whatever file system they name."""

from __future__ import annotations

import os
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _resolve(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path, hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())


def qualified(spark: SparkSession, path: str) -> str:
    """The path in full: scheme, host, and no relative start."""
    hadoop_path, file_system = _resolve(spark, path)
    return file_system.makeQualified(hadoop_path).toString()


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path, file_system = _resolve(spark, path)
    return file_system.exists(hadoop_path)


def free_path(spark: SparkSession, parent: str, name: str) -> str:
    """``parent/name``, or the first of ``name-1``, ``name-2``, ... that does not exist."""
    wanted = f"{parent.rstrip('/')}/{name}"
    path, serial = wanted, 1
    while path_exists(spark, path):
        path, serial = f"{wanted}-{serial}", serial + 1
    return path


def _claim(spark: SparkSession, marker: str) -> bool:
    """Create an empty file unless there is one; of several at once only one succeeds."""
    hadoop_path, file_system = _resolve(spark, marker)
    file_system.mkdirs(hadoop_path.getParent())
    if file_system.getUri().getScheme() == "file":
        try:
            os.close(os.open(hadoop_path.toUri().getPath(), os.O_CREAT | os.O_EXCL))
            return True
        except FileExistsError:
            return False
    try:
        return file_system.createNewFile(hadoop_path)
    except Py4JJavaError as error:
        if file_system.exists(hadoop_path):
            return False
        raise error


@contextmanager
def reserved_path(spark: SparkSession, parent: str, name: str) -> Iterator[str]:
    """``free_path`` for the one who writes there: until the block ends no other job gets the same path.

    A hidden file ``.<name>.claim`` beside the path is created by whoever comes first, and removed when
    the block ends, however it does; by then the path itself is there if anything was written.
    """
    wanted, folder = name, parent.rstrip("/")
    serial = 0
    while True:
        path, marker = f"{folder}/{wanted}", f"{folder}/.{wanted}.claim"
        if not path_exists(spark, path) and _claim(spark, marker):
            # whoever held the claim before may have written since the first look
            if not path_exists(spark, path):
                break
            delete_path(spark, marker)
        serial += 1
        wanted = f"{name}-{serial}"
    try:
        yield path
    finally:
        delete_path(spark, marker)


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a folder and all in it; nothing happens if there is none."""
    hadoop_path, file_system = _resolve(spark, path)
    file_system.delete(hadoop_path, True)


def file_facts(spark: SparkSession, path: str) -> tuple[int, int] | None:
    """A file's length and the time of its last change in milliseconds; None if it is gone."""
    hadoop_path, file_system = _resolve(spark, path)
    if not file_system.exists(hadoop_path):
        return None
    status = file_system.getFileStatus(hadoop_path)
    return status.getLen(), status.getModificationTime()


def open_file(spark: SparkSession, path: str):
    """A file's stream, and a function that reads ``(place, size)`` bytes of it."""
    hadoop_path, file_system = _resolve(spark, path)
    stream = file_system.open(hadoop_path)

    def read(place: int, size: int) -> bytes:
        stream.seek(place)
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, int(size))) if size else b""

    return stream, read
