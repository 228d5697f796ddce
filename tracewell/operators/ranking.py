"""Row numbers over a whole table without a task that sees the whole table."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.sources.tables import kept_for_good

BLOCK = 1 << 16


def with_row_number(rows: DataFrame, name: str, position: str, keys: list[str] = (), partition: list[str] = ()) -> DataFrame:
    """Adds ``name``: 1, 2, … per ``partition`` in the order of ``keys``, then of the integer
    ``position``. Rows are numbered within blocks of 65,536 positions; only the blocks' row counts
    are summed in order, so a partition that holds most of the table is still spread out."""
    partition, keys = list(partition), list(keys)
    block = [*partition, *keys, "_block"]
    placed = rows.withColumn("_block", F.floor(F.col(position) / BLOCK))
    counts = placed.groupBy(*block).agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*partition).orderBy(*keys, "_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*block, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    within = Window.partitionBy(*block).orderBy(position)
    numbered = placed.withColumn("_within", F.row_number().over(within)).join(offsets, block)
    return numbered.withColumn(name, F.col("_offset") + F.col("_within")).drop("_block", "_within", "_offset")


def with_global_number(rows: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Adds ``name``: 1, 2, … in the order of ``keys``, which no two rows share, over the whole table.

    The rows are made once and written in the shared folder, dealt out by ranges of the keys and sorted within each; a row's
    number is its place in its range after the counts of the ranges before, of which the driver has one number each. These
    jobs run when the plan is built."""
    made = kept_for_good(rows)
    nth = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # the row's place in its partition
    ranged = made.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranged = kept_for_good(ranged.withColumns({"_range": F.spark_partition_id(), "_nth": nth}))
    counts = {r["_range"]: r["count"] for r in ranged.groupBy("_range").count().collect()}
    before = list(accumulate((counts.get(i, 0) for i in range(max(counts, default=0))), initial=0))
    offset = F.expr(f"array({', '.join(f'{n}L' for n in before)})[_range]")
    return ranged.withColumn(name, offset + F.col("_nth") + 1).drop("_range", "_nth")
