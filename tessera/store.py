"""Shared storage for intermediate tables.

Everything that cuts lineage goes through here: a table is written as Parquet under the folder that
the cluster names in ``spark.checkpoint.dir`` and read back, so a lost executor costs a re-read, not
a recomputation, and no task depends on another machine's local disk.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where the session names none, a local master gets a
    temporary folder that goes with the driver; a cluster, whose machines share no such folder, an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tessera-shared-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        where = "file://" + folder
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting that holds inside the block only."""
    was = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, was) if was is not None else spark.conf.unset(key)


#: With it, Spark deletes a plan's shuffle files as soon as its result is written.
CLEAN_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


BATCH_SETTING, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1_000


class Store:
    """A folder of staged tables below the shared folder; names are unique to each instance."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex[:12]}"
        self._seq = 0

    def path(self, name: str) -> str:
        self._seq += 1
        return f"{self.root}/{self._seq:03d}-{name}"

    def stage(self, df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
        """Write ``df`` and return the written table; the shuffle files of its plan go at once."""
        path = self.path(name)
        with setting(self.spark, CLEAN_SETTING, "true"):
            df.write.mode("overwrite").option("compression", codec).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._tessera_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a staged table that nothing reads any more."""
        path = getattr(df, "_tessera_path", None)
        if path:
            delete(self.spark, path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per Spark context, wherever the driver runs from.

    Texts are long, so a batch for Python holds ``BATCH_ROWS`` rows unless the session says otherwise."""
    if spark.conf.get(BATCH_SETTING, "10000") == "10000":
        spark.conf.set(BATCH_SETTING, str(BATCH_ROWS))
    sc = spark.sparkContext
    if getattr(sc, "_tessera_shipped", False):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    fd, name = tempfile.mkstemp(prefix="tessera-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(name, "w") as z:
        for folder, _, files in os.walk(top):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join("tessera", os.path.relpath(full, top)))
    sc.addPyFile(name)
    sc._tessera_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tidy() -> None:
    """In a Python worker, which serves many tasks: give freed memory back to the system."""
    import ctypes
    import gc

    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)
