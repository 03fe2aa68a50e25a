"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset a local folder is set, on a local master only.

    On a cluster a folder of one machine would lose rows, so a session without the setting raises ValueError there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            return found.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.sparkContext.setCheckpointDir(base)
    return base


_run: ContextVar[str | None] = ContextVar("run", default=None)


@contextmanager
def run_folder(spark: SparkSession) -> Iterator[str]:
    """What the library writes inside the block goes into a folder of its own, which is deleted behind it.

    Results that are still to be read have to be written elsewhere first. Without such a block everything stays in
    the shared folder. Blocks may be nested.
    """
    path = f"{(_run.get() or shared_folder(spark)).rstrip('/')}/run-{uuid.uuid4().hex}"
    token = _run.set(path)
    try:
        yield path
    finally:
        _run.reset(token)
        deleted(path)


def deleted(path: str) -> None:
    """The folder is gone, or was absent before."""
    system, folder = opened(path)
    if system.get_file_info(folder).type != fs.FileType.NotFound:
        system.delete_dir(folder)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside the block are deleted as each query ends; else they stay until the driver collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{(_run.get() or shared_folder(spark)).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, options: dict[str, str] | None = None, by: Sequence[str] = (), path: str | None = None) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read back: lineage ends there, and a lost executor costs nothing.

    ``by`` are columns whose values become folders, so that a reader of one value reads no other. ``path`` is a fresh one, if
    the caller is to delete it.
    """
    spark = df.sparkSession
    path = path or fresh_path(spark, name)
    df.write.options(**(options or {})).partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a file's or folder's URI, and its path there; for reads in pieces inside tasks."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))
