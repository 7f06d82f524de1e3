"""Cutting long lineages with reliable checkpoints, and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``.

    Only in a local session, as in tests, a temporary one is made where it is unset.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="scriptorium-"))
    return context.getCheckpointDir()


#: The scope that new folders are made in, if any.
_SCOPE: ContextVar[str | None] = ContextVar("scope", default=None)


def new_folder(spark: SparkSession) -> str:
    """A fresh name below the shared folder, and below the current scope's folder if there is one."""
    return f"{_SCOPE.get() or shared_folder(spark)}/work-{uuid.uuid4().hex}"


@contextmanager
def scope(spark: SparkSession) -> Iterator[str]:
    """Gathers what is stored meanwhile below one folder, which ``removed`` can take away."""
    token = _SCOPE.set(f"{shared_folder(spark)}/scope-{uuid.uuid4().hex}")
    try:
        yield _SCOPE.get()
    finally:
        _SCOPE.reset(token)


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Spark deletes the shuffle files of each query that is made and run meanwhile when it ends.

    Else they stay until the driver happens to collect its garbage.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def removed(spark: SparkSession, folder: str) -> None:
    """Delete a scope's folder. Frames that read from it cannot be evaluated any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(folder)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def unsent(frame: DataFrame) -> DataFrame:
    """The same rows for a join that shuffles them and never sends them to all tasks by way of the driver.

    For a row or more of each document. Spark takes the size of a stored table from its files, in which values
    that repeat take next to nothing, while the driver would hold every row of them.
    """
    return frame.hint("merge")


def cut(frame: DataFrame) -> DataFrame:
    """The same rows, computed once and kept in the shared folder.

    Used for small per-document tables that a plan needs several times. The checkpoint is
    reliable: losing executors does not lose it.
    """
    shared_folder(frame.sparkSession)
    return frame.checkpoint()


def stored(frame: DataFrame, compression: str | None = None) -> DataFrame:
    """The same rows, written once as a columnar table in the shared folder.

    Used for parsed packages: what is read later is a few columns and elements of them, so
    pruning and pushdown pay off.
    """
    path = f"{new_folder(frame.sparkSession)}/table"
    frame.write.parquet(path, compression=compression)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
