"""Corpora that are kept as tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

PARTITIONS = "tracewell.deal.partitions"


def deal(rows: DataFrame) -> DataFrame:
    """The rows dealt out over as many partitions as the session's ``tracewell.deal.partitions`` says.

    A task reads whole row groups, so a table of one row group keeps a single core busy. Where work is heavy per
    byte and tables are small, dealing out pays; by default, and for large tables, rows stay where they are read.
    """
    partitions = rows.sparkSession.conf.get(PARTITIONS, None)
    return rows.repartition(int(partitions)) if partitions else rows


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``. Only a session of one machine can do
    without."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tracewell-"))
    return context.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of this name that nothing else writes to."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def kept_for_good(rows: DataFrame) -> DataFrame:
    """The rows, written in the shared folder, where their lineage ends."""
    shared_folder(rows.sparkSession)
    return rows.checkpoint()
