"""Tables in the folder that the cluster shares, for what is computed once and read more than once."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one of our own only in local mode without such a setting, as in tests."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("veritill.checkpoint.dir", None)
    if not there:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        there = "file://" + tempfile.mkdtemp(prefix="veritill-")
        spark.conf.set("veritill.checkpoint.dir", there)
    return there


_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_scratch: ContextVar[tuple[list[DataFrame], ...]] = ContextVar("scratch", default=())


def stored(df: DataFrame, lasting: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """The same rows from a table written to the shared folder: cuts lineage, outlives executors, is computed once.

    Inside `scratch` the table is deleted at the end of the block, a lasting one at the end of the block around it, if any.
    by: columns with a folder for each of their values, so that a filter on them reads no other rows; they come last.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/veritill-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[out] = path
    blocks = _scratch.get()
    if len(blocks) > lasting:
        blocks[-1 - lasting].append(out)
    return out


def release(*tables: DataFrame) -> None:
    """Deletes stored tables; nothing that still has to be computed may read them."""
    for table in tables:
        if path := _paths.pop(table, None):
            delete(table.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared file system, if it is there."""
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Inside the block Spark deletes the shuffle files of a job when it has ended, not when the driver collects its garbage."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, "true")
    try:
        yield
    finally:
        spark.conf.set(setting, before) if before is not None else spark.conf.unset(setting)


@contextmanager
def scratch() -> Iterator[None]:
    """Deletes the tables that were stored inside the block; what leaves it must be stored as lasting."""
    tables: list[DataFrame] = []
    token = _scratch.set((*_scratch.get(), tables))
    try:
        yield
    finally:
        _scratch.reset(token)
        release(*tables)
