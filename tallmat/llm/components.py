"""Connected components by repeated contraction; nothing but row counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallmat.llm.common import fixed_point, saved


def _rooted(pointers: DataFrame) -> DataFrame:
    """Follow ``(node, to)`` pointers, all towards smaller nodes, to their ends by doubling."""

    def jump(now: DataFrame) -> DataFrame:
        onward = now.select(F.col("node").alias("to"), F.col("to").alias("next"))
        return now.drop("moved").join(onward, "to", "left").select(
            "node", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")
        )

    return fixed_point(jump, pointers.withColumn("moved", F.lit(True)), "moved").drop("moved")


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node that is not the smallest of its component.

    ``edges`` has columns ``a`` and ``b`` (integers, never null). In each round a node points to its smallest
    smaller neighbour, pointers are followed to their ends, and edges move to those ends. A node that points
    somewhere takes no part in later rounds, so the graph shrinks fast whatever its diameter. A hub costs
    one row per edge and round; minima are taken before the shuffle. Self-links and repeated links are
    ignored; no edge gives an empty table.
    """
    plain = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    left = saved(plain.where("a < b").distinct())
    total = None
    while left.limit(1).count():
        hooks = _rooted(left.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("to")))
        total = hooks if total is None else total.unionByName(hooks)
        first, second = (hooks.select(F.col("node").alias(c), F.col("to").alias(f"{c}_to")) for c in "ab")
        moved = left.join(first, "a", "left").join(second, "b", "left")
        ends = moved.select(F.coalesce("a_to", "a").alias("a"), F.coalesce("b_to", "b").alias("b")).where("a <> b")
        left = saved(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if total is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return _rooted(total).select("node", F.col("to").alias("component"))
