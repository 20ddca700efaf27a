"""Positions of rows in a global order, without sorting a table in one task."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallmat.stages import materialise


def number_rows(df: DataFrame, *order: Column, name: str = "number") -> DataFrame:
    """Add the 0-based position of each row in ``order`` as a long column ``name``.

    Rows are range-partitioned and sorted, numbered within their partition, and shifted by the sizes of the
    partitions before it; only those sizes, one per partition, are joined. Rows equal in ``order`` get
    different positions in no fixed order. The sorted rows are saved once.
    """
    columns = df.columns
    taken = {c.lower() for c in columns}
    at = "position"
    while at in taken:
        at += "_"
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = materialise(ranged.select("*", F.monotonically_increasing_id().alias(at)))
    part = F.shiftright(at, 33)
    sizes = rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()
    if not sizes:
        return rows.select(*columns, F.lit(0).cast("long").alias(name))
    counts = {row["part"]: row["n"] for row in sizes}
    # An array by partition, as a place in it is found in one step.
    before = F.array(*[F.lit(x).cast("long") for x in accumulate((counts.get(i, 0) for i in range(max(counts))), initial=0)])
    return rows.select(*columns, (F.get(before, part.cast("int")) + F.col(at) % F.lit(1 << 33)).alias(name))
