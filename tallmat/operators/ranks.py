"""Ranking within groups whose size has no bound.

A window over a group sorts the whole group in one task. Here a group is first reduced to its
distinct values with their counts, which are cut into ranges of about equal length; running counts
are taken within a range and over the sums of ranges. So a gene that holds a third of all rows, or
whose values lie close together, is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallmat.operators.axes import Axes, absent_zeros
from tallmat.stages import materialise


def weighted_values(tall: DataFrame, group: str, value: str, axes: Axes | None = None) -> DataFrame:
    """``(group, value double, n)``: stored entries, plus the absent zeros of each group as one row."""
    rows = tall.select(group, F.col(value).cast("double").alias("value"), F.lit(1).cast("bigint").alias("n"))
    if axes is None:
        return rows
    stored = tall.groupBy(group).agg(F.count(F.lit(1)).alias("stored"))
    zeros = (
        axes.population(group)
        .join(stored, group, "left")
        .select(
            group,
            F.lit(0.0).alias("value"),
            absent_zeros(F.col("population"), F.col("stored")).alias("n"),
        )
        .where(F.col("n") > 0)
    )
    return rows.unionByName(zeros)


def distinct_values(weighted: DataFrame, group: str) -> DataFrame:
    """``(group, value, n)`` with one row per distinct value (NULL included)."""
    return weighted.groupBy(group, "value").agg(F.sum("n").alias("n"))


def counts_before(values: DataFrame, group: str) -> DataFrame:
    """Add ``before``: how many entries of the group are smaller. NULL comes first, NaN last.

    ``values`` has one row per distinct value. The tie rank of a value is ``before + 1``, and it takes
    the gap-free positions ``before + 1 .. before + n``. Rows are range-partitioned by group and value and saved;
    the ranges follow the data, so a group of any size and spread is cut into parts of about equal
    length, and only the sums of parts are added up across them.
    """
    ranged = values.select(group, "value", "n").repartitionByRange(group, "value")
    parts = materialise(ranged.withColumn("part", F.spark_partition_id()))
    earlier = Window.rowsBetween(Window.unboundedPreceding, -1)
    within = earlier.partitionBy(group, "part").orderBy("value")
    across = earlier.partitionBy(group).orderBy("part")
    inner = parts.withColumn("inner", F.coalesce(F.sum("n").over(within), F.lit(0)))
    outer = (
        parts.groupBy(group, "part")
        .agg(F.sum("n").alias("part_n"))
        .select(
            F.col(group).alias("_group"),
            F.col("part").alias("_part"),
            F.coalesce(F.sum("part_n").over(across), F.lit(0)).alias("outer"),
        )
    )
    same = F.col(group).eqNullSafe(F.col("_group")) & (F.col("part") == F.col("_part"))
    return inner.join(outer, same).select(group, "value", "n", (F.col("outer") + F.col("inner")).alias("before"))


def weighted_median(values: DataFrame, group: str) -> DataFrame:
    """``(group, median)``: the exact median per group of ``(group, value, n)``, NULLs left out.

    ``values`` has one row per distinct value. NaN is the largest value, as in Spark's own median. A group
    without values has a NULL median.
    """
    positions = materialise(counts_before(values.where(F.col("value").isNotNull() & (F.col("n") > 0)), group))
    totals = positions.groupBy(group).agg(F.sum("n").alias("total"))
    low, high = F.floor((F.col("total") + 1) / 2), F.ceil((F.col("total") + 1) / 2)

    def at(position: Column) -> Column:
        return F.max(F.when((F.col("before") < position) & (position <= F.col("before") + F.col("n")), F.col("value")))

    middle = positions.join(totals, group).groupBy(group).agg(((at(low) + at(high)) / 2).alias("median"))
    return values.select(group).distinct().join(middle, group, "left")


def grouped_median(rows: DataFrame, group: str, zeros: DataFrame | None = None) -> DataFrame:
    """``(group, median)`` of plain rows with ``value``; ``zeros (group, population)`` adds zeros not stored."""
    weighted = rows.select(group, F.col("value").cast("double").alias("value"), F.lit(1).cast("bigint").alias("n"))
    if zeros is not None:
        stored = rows.groupBy(group).agg(F.count(F.lit(1)).alias("stored"))
        absent = absent_zeros(F.col("population"), F.col("stored"))
        extra = zeros.join(stored, group, "left").select(group, F.lit(0.0).alias("value"), absent.alias("n"))
        weighted = weighted.unionByName(extra)
    return weighted_median(distinct_values(weighted, group), group)


def covering_sums(runs: DataFrame, *amounts: str) -> DataFrame:
    """``(position, amounts...)``: for every ``start``, the sums over all runs that cover it.

    ``runs`` has ``start`` and ``n``: a run covers ``start .. start + n - 1``. Each run is cut into intervals whose
    length is a power of two and divides their beginning, at most two of a length; a position lies in one
    interval of each length. Sums are taken by interval, then over the intervals of a position: nothing
    is subtracted, so small runs keep their digits beside huge ones, and no order is needed.
    """
    begin, end = F.col("start"), F.col("start") + F.col("n")

    def pieces(level: Column) -> Column:
        size = F.pow(F.lit(2.0), level).cast("bigint")
        first, last = F.ceil(begin / size).cast("bigint"), F.floor(end / size).cast("bigint")
        left = F.when((first < last) & (first % 2 == 1), first)
        right = F.when((first < last) & (last % 2 == 1) & ~((last - 1 == first) & (first % 2 == 1)), last - 1)
        return F.transform(F.array_compact(F.array(left, right)), lambda i: F.struct(level.alias("level"), i.alias("at")))

    deepest = F.floor(F.log2(F.greatest(F.col("n"), F.lit(1)))).cast("int")
    cut = F.flatten(F.transform(F.sequence(F.lit(0), deepest), pieces))
    sums = (
        runs.where(F.col("n") > 0)
        .select(*amounts, F.explode(cut).alias("piece"))
        .groupBy("piece.level", "piece.at")
        .agg(*[F.sum(a).alias(a) for a in amounts])
    )
    most = runs.agg(F.floor(F.log2(F.greatest(F.max("n"), F.lit(1)))).cast("int")).scalar()
    level = F.explode(F.sequence(F.lit(0), F.coalesce(most, F.lit(0)))).alias("level")
    looked = runs.select(F.col("start").alias("position")).distinct().select("position", level)
    at = F.floor(F.col("position") / F.pow(F.lit(2.0), F.col("level"))).cast("bigint")
    return (
        looked.select("position", "level", at.alias("at"))
        .join(sums, ["level", "at"])
        .groupBy("position")
        .agg(*[F.sum(a).alias(a) for a in amounts])
    )
