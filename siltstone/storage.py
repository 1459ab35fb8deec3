"""The shared folder of a session, and tables written to it to cut a plan's lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Tables written since ``scratch`` began, innermost last.
_held: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; set here only where it is unset and Spark runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="siltstone-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def cut(df: DataFrame, options: dict | None = None) -> DataFrame:
    """The same rows from a table in the shared folder, which outlives executors; options: those of the writer."""
    path = f"{shared_folder(df.sparkSession)}/step-{uuid.uuid4().hex}"
    note(path)
    df.write.options(**(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Return what a finished task has freed to the system: Spark keeps its Python workers for later tasks of other stages."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def note(path: str) -> None:
    """Remember a table that the innermost ``scratch`` is to delete."""
    if _held:
        _held[-1].append(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes, at the end, the tables that operators wrote to cut lineages in the meantime.

    Results must be written (or collected) inside, as plans made inside read those tables.
    """
    _held.append([])
    try:
        yield
    finally:
        for path in _held.pop():
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
