"""Connected components by contraction, as Spark joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.storage import Scratch


def components(edges: DataFrame, scratch: Scratch, made_of: Sequence[DataFrame] = ()) -> DataFrame:
    """``edges(a, b)`` -> ``(node, component)``, the component being the smallest node reachable.

    In each round every node takes the smallest node among itself and its neighbours, and then what that one took;
    edges are drawn between what their ends took, and those within one node vanish. The graph shrinks by a
    factor each round until no edge is left; what nodes took is then followed from the last round back. A node of
    many links costs partial minima only; every round is written to the shared folder. Nulls are not nodes; an empty
    edge table gives an empty result. ``made_of`` are kept tables that only the edges read: they are dropped when these are written.
    """
    level = edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    level = scratch.keep(level, "links")
    scratch.drop(*made_of)
    taken = []
    while True:
        both = level.select(F.inline(F.array(
            F.struct(F.col("a").alias("node"), F.col("b").alias("near")), F.struct(F.col("b").alias("node"), F.col("a").alias("near")))))
        least = scratch.keep(both.groupBy("node").agg(F.min("near").alias("near")).select(
            "node", F.least("node", "near").alias("low")), "least")
        jumped = least.alias("x").join(
            least.select(F.col("node").alias("at"), F.col("low").alias("lower")).alias("y"), F.col("x.low") == F.col("y.at"))
        took = scratch.keep(jumped.select("x.node", F.col("y.lower").alias("took")), "took")
        scratch.drop(least)
        taken.append(took)
        left = took.select(F.col("node").alias("a"), F.col("took").alias("p"))
        right = took.select(F.col("node").alias("b"), F.col("took").alias("q"))
        drawn = level.join(left, "a").select("b", "p").join(right, "b").where("p <> q").select(
            F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()
        drawn = scratch.keep(drawn, "links")
        scratch.drop(level)
        level = drawn
        if level.isEmpty():
            break
    found = taken.pop().withColumnRenamed("took", "component")
    while taken:
        above = found.select(F.col("node").alias("of"), F.col("component").alias("last"))
        found = taken.pop().join(above, F.col("took") == F.col("of"), "left").select(
            "node", F.coalesce("last", "took").alias("component"))
    return found
