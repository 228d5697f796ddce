"""Tables written in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


BATCH_BYTES = "4m"
UNBOUNDED = (str(2**31 - 1), "2147483647b", "2g")
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where none is named, a session of one machine (tests) gets a folder of
    its own; one of several machines is refused, as they would not see each other's files."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tracewell-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches are bounded by rows alone unless the session says otherwise; long texts need a bound in bytes."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) in (None, *UNBOUNDED):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is run meanwhile removes its shuffle files as it ends. Else they stay until the driver happens to collect its garbage,
    and a query of many steps holds those of all of them."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


class Scratch:
    """Tables of one run. ``keep`` writes a table and reads it back: its lineage ends there, and lost
    executors cost only the tasks they ran; nothing else reads the shuffle files it took. ``drop`` deletes a table that is not
    read any more."""

    def __init__(self, spark: SparkSession, name: str):
        bound_batches(spark)
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self._tables = 0

    def path(self, name: str) -> str:
        self._tables += 1
        return f"{self.folder}/{self._tables:03d}-{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        with shuffles_removed(self.spark):
            df.write.option("compression", "zstd").parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept._tracewell_path = path
        return kept

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            target = self.spark._jvm.org.apache.hadoop.fs.Path(table._tracewell_path)
            target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)
