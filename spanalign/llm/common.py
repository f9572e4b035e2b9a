"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import contextlib
import gc
import sys
import tempfile
import types
import uuid

import pyspark.cloudpickle as cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Executors need not have this package installed: its functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules["spanalign"])

_OWN_DIR: list[str] = []


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker, whatever task runs in it."""
    holder = sys.modules.setdefault("_worker_cache", types.ModuleType("_worker_cache"))
    return holder.__dict__.setdefault("entries", {})


def lean(make):
    """make for mapInArrow, after which the worker gives its free memory back to the system: an idle
    worker lives on beside the JVM's next stages."""

    def run(batches):
        import ctypes

        import pyarrow as pa

        yield from make(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(AttributeError, OSError):  # glibc has it
            ctypes.CDLL(None).malloc_trim(0)

    return run


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; only where that is unset, a local one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not _OWN_DIR:
            _OWN_DIR.append("file://" + tempfile.mkdtemp(prefix="spanalign-"))
        base = _OWN_DIR[0]
    return f"{base.rstrip('/')}/t-{uuid.uuid4().hex}"


class Workspace:
    """Intermediate tables of one operator in the shared folder.

    Each is written once and read back, which cuts the lineage: a lost executor never makes an
    earlier stage run again. ``drop`` frees those that the result doesn't read.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.n = spark, shared_dir(spark), 0

    def write(self, df: DataFrame, options: dict | None = None) -> str:
        self.n += 1
        path = f"{self.root}/{self.n:03d}"
        df.write.options(**{"compression": "zstd"} | (options or {})).parquet(path)
        return path

    def read(self, *paths: str, schema=None) -> DataFrame:
        reader = self.spark.read.schema(schema) if schema is not None else self.spark.read
        return reader.parquet(*paths)

    def keep(self, df: DataFrame) -> DataFrame:
        return self.read(self.write(df), schema=df.schema)

    def drop(self, *paths: str) -> None:
        jvm = self.spark._jvm
        for p in paths:
            path = jvm.org.apache.hadoop.fs.Path(p)
            with contextlib.suppress(Exception):
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def clear(self) -> None:
        """Drops all tables, once nothing reads them any more."""
        self.drop(self.root)

    def release(self) -> None:
        """Lets Spark delete the shuffle files of finished queries now, not at the next large collection.

        The scheduler holds on to the last job's stages until another one has run.
        """
        gc.collect()
        self.spark.range(1).count()
        self.spark._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col), F.lit(""))
