"""Shared helpers of the corpus operators."""

from __future__ import annotations

import contextlib
import contextvars
import os
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch under ``small_batches``.
ARROW_ROWS = 1000
_workspace: contextvars.ContextVar[str | None] = contextvars.ContextVar("workspace", default=None)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder name under the shared folder that the session names, with its scheme. Only a local master may do without one."""
    base = _workspace.get() or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a shared folder on {master or 'a cluster'}: other machines do not see this one's folders")
        base = "file://" + os.path.join(tempfile.gettempdir(), "captrix-shared")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
    base = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    if base.startswith("file:/") and not base.startswith("file://"):
        base = "file://" + base.removeprefix("file:")
    return f"{base.rstrip('/')}/captrix-{uuid.uuid4().hex}"


@contextlib.contextmanager
def workspace(spark: SparkSession) -> Iterator[str]:
    """A folder that holds all stored tables made meanwhile and is deleted afterwards: read nothing from them by then."""
    folder = shared_folder(spark)
    before = _workspace.set(folder)
    try:
        yield folder
    finally:
        _workspace.reset(before)
        remove(spark, folder)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> Iterator[None]:
    """Meanwhile at most so many rows go to Python at once: whole texts are long rows, and each task holds a batch on both sides."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), rows) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stored(df: DataFrame, folder: str, name: str, **options) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = f"{folder}/{name}"
    schema = df.schema
    df.write.mode("overwrite").options(**options).parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store through Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    with contextlib.suppress(Exception):
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def text_of(name: str = "text") -> Column:
    """The text column with null as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))
