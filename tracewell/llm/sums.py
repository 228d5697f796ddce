"""Sums of large arrays over tasks: every task sends its array in parts, which are added up part by part."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

PARTS = "part long, rows binary"


def in_parts(total: np.ndarray, rows: int) -> pa.RecordBatch:
    starts = range(0, len(total), rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(list(starts), pa.int64()), pa.array([total[p : p + rows].tobytes() for p in starts], pa.binary())],
        ["part", "rows"])


def _add(table: pa.Table) -> pa.Table:
    total = reduce(np.add, [np.frombuffer(r) for r in table.column("rows").to_pylist()])
    return pa.table({"part": table.column("part").slice(0, 1), "rows": pa.array([total.tobytes()], pa.binary())})


def summed(parts: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """The sum of all tasks' arrays of doubles, which have this shape."""
    total = np.zeros(shape)
    for r in parts.groupBy("part").applyInArrow(_add, PARTS).toLocalIterator():
        rows = np.frombuffer(r["rows"]).reshape(-1, shape[1])
        total[r["part"] : r["part"] + len(rows)] = rows
    return total
