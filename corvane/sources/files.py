"""Files by any path that Spark's own file systems know, from the driver; and by URI from tasks."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _fs(spark, path)
    return fs.exists(target)


def size(spark: SparkSession, path: str) -> int:
    fs, target = _fs(spark, path)
    return fs.getFileStatus(target).getLen()


def read_bytes(spark: SparkSession, path: str) -> bytes:
    fs, target = _fs(spark, path)
    stream = fs.open(target)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """All or nothing: the file appears under its name once it is whole."""
    fs, target = _fs(spark, path)
    _, part = _fs(spark, path + ".part")
    stream = fs.create(part, True)
    stream.write(bytearray(data))
    stream.close()
    fs.delete(target, False)
    if not fs.rename(part, target):
        raise OSError(f"{path} could not be put in place")


def read_text(spark: SparkSession, path: str) -> str:
    return read_bytes(spark, path).decode()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    write_bytes(spark, path, text.encode())


def remove(spark: SparkSession, path: str) -> None:
    fs, target = _fs(spark, path)
    fs.delete(target, True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names; removed when the driver ends.

    Only a local session may go without that setting: elsewhere a temporary
    folder would be another one on each machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all nodes share")
        root = "file://" + tempfile.mkdtemp(prefix="corvane-core-")
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(_gone, spark, path)
    return path


def _gone(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended first
        remove(spark, path)


def opened(path: str):
    """A seekable file for reading in a task; plain paths are local."""
    from pyarrow import fs

    filesystem, name = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    return filesystem.open_input_file(name)
