"""Shared scratch space for intermediate tables.

Intermediate results that several jobs read are written as Parquet below the
folder named by ``spark.checkpoint.dir``, which driver and executors share, so
that losing an executor never loses a stage's output. Only when that setting is
absent in local mode (unit tests, a local shell) is a temporary folder chosen here;
elsewhere that is an error.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Whether Spark deletes the shuffle files of a query when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Most bytes that Spark hands to Python at once.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder all nodes share; its URI without a trailing slash."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        if context.getCheckpointDir() is None:
            if context.master != "local" and not context.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that all nodes share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="keyline-"))
        base = context.getCheckpointDir()
    return base.rstrip("/")


class Scratch:
    """Tables of one computation below the shared folder; ``drop`` frees them early."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str, *, compression: str = "snappy") -> DataFrame:
        with setting(self.spark, CLEANUP, "true"), setting(self.spark, BATCH_BYTES, str(16 << 20)):
            df.write.mode("overwrite").option("compression", compression).parquet(self.path(name))
        # the schema is known, so no job has to open a footer to infer it
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(conf).delete(path, True)

    def free(self) -> None:
        """Let Spark delete the shuffle files of finished jobs now: it does so when the
        driver's garbage is collected, which may be long after a large shuffle."""
        gc.collect()
        self.spark._jvm.System.gc()


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting of the session for the jobs run inside."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 200) -> Iterator[None]:
    """Hand Python few rows at a time in the jobs run inside: for rows that can be large."""
    with setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows)):
        yield
