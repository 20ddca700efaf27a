"""Normalisation: global (counts per ten thousand, logged) and quantile."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallmat.functions.markers import ERCC, is_marker
from tallmat.operators.axes import Axes, require
from tallmat.operators.baseline import Baselined
from tallmat.operators.ranks import counts_before, covering_sums, distinct_values, weighted_values
from tallmat.operators.shape import densify
from tallmat.stages import materialise


# Cells from which on their totals are joined by a hash table of each partition, without an order of the matrix.
MANY_CELLS = 200_000


def drop_marker_genes(df: DataFrame, markers: Sequence[str]) -> DataFrame:
    """Leave out genes of the given marker families."""
    for marker in markers:
        df = df.where(~is_marker("variable", marker))
    return df


def norm_global(tall: DataFrame, scale: float = 10_000, drop_markers: Sequence[str] = ()) -> DataFrame:
    """``(cell, variable, norm_value)`` with ``log(1 + scale * value / total of the cell)``.

    NULL for all genes of a cell whose total is 0. A zero stays 0, so a sparse matrix stays sparse;
    use :func:`defined_axes` to leave out the cells without a total. The totals are saved, which runs a job: of few
    cells they may be broadcast, of many they meet their rows without a sort of these.
    """
    tall = drop_marker_genes(require(tall, "cell", "variable", "value"), drop_markers)
    totals = materialise(tall.groupBy("cell").agg(F.sum("value").alias("total")))
    if totals.count() >= MANY_CELLS:
        totals = totals.hint("shuffle_hash")
    share = F.try_divide(F.col("value"), F.col("total"))
    return tall.join(totals, "cell", "left").select(
        "cell", "variable", F.log1p(F.lit(float(scale)) * share).alias("norm_value")
    )


def defined_axes(tall: DataFrame, axes: Axes, drop_markers: Sequence[str] = ()) -> Axes:
    """The axes of a globally normalised sparse matrix.

    A cell whose total is 0 has no normalised value for any gene. Leaving it out of the axis keeps its
    absent entries from being taken for zeros.
    """
    tall = drop_marker_genes(tall, drop_markers)
    totals = tall.groupBy("cell").agg(F.sum("value").alias("total"))
    return Axes(axes.cells, drop_marker_genes(axes.genes, drop_markers)).restrict(
        cells=totals.where(F.col("total") != 0).select("cell")
    )


def norm_quantile(
    tall: DataFrame,
    axes: Axes | None = None,
    by: str = "gene",
    drop_markers: Sequence[str] = (ERCC,),
    places: int | None = None,
) -> DataFrame:
    """``(cell, variable, norm_value)``: every value becomes the mean of all values at its rank.

    Values are ranked within each gene over the cells, or with ``by='cell'`` within each cell over
    the genes. The mean at a position is taken over the groups, ties counted separately; a tied value
    gets the mean at the lowest of its positions. NULLs sort first and take part in the ranking.

    The ranks of all rows are never laid out. Each distinct value of a group covers a run of
    positions; the mean at a position that is looked up is taken over the runs that cover it, by
    additions only.

    With ``axes`` the ranking works on the sparse entries, but the result is dense, as the rank of
    a zero need not have mean 0. By cell the stored entries alone are looked up, and the zeros of a cell are
    laid out as what they become, since the table of means has rows for every cell.

    ``places`` rounds the result, each distinct value of a group once; -0.0 becomes 0.0. The table of distinct values and the one of means are written to the scratch folder, which runs jobs.
    """
    lookup, tall, axes, group = _quantile_lookup(tall, axes, by, drop_markers, places)
    same = (F.col(group) == F.col("_group")) & F.col("value").cast("double").eqNullSafe(F.col("_value"))
    if axes is not None and by == "cell":
        # Repeated pairs are merged as densify does, before their value is looked up.
        stored = tall.groupBy("cell", "variable").agg(F.max("value").alias("value"))
        found = stored.join(lookup, same, "left").select("cell", "variable", "norm_value")
        zeros = lookup.where("_value = 0").select(F.col("_group").alias("cell"), F.col("norm_value").alias("zero"))
        return densify(found, axes, "norm_value", zeros)
    dense = tall if axes is None else densify(tall, axes)
    return dense.join(lookup, same, "left").select("cell", "variable", "norm_value")


def norm_quantile_sparse(tall: DataFrame, axes: Axes, drop_markers: Sequence[str] = (ERCC,)) -> Baselined:
    """:func:`norm_quantile` of a sparse matrix by gene, at the cost of its stored entries.

    All zeros of a gene are tied and get one value, its base; a gene without zeros has base 0. Only stored entries are
    looked up and kept, as deviations from the base. ``Baselined.dense()`` is what :func:`norm_quantile` returns;
    gene selection takes the result as it is, and components come from ``Baselined.to_sparse()``.
    """
    lookup, tall, axes, _ = _quantile_lookup(tall, axes, "gene", drop_markers)
    base = axes.genes.select("variable").distinct().join(
        lookup.where("_value = 0").select(F.col("_group").alias("variable"), "norm_value"), "variable", "left"
    )
    base = materialise(base.select("variable", F.coalesce("norm_value", F.lit(0.0)).alias("base")))
    same = (F.col("variable") == F.col("_group")) & F.col("value").cast("double").eqNullSafe(F.col("_value"))
    entries = tall.join(lookup, same, "left").join(base, "variable").select(
        "cell", "variable", (F.col("norm_value") - F.col("base")).alias("deviation")
    )
    return Baselined(entries, base, axes)


def _quantile_lookup(
    tall: DataFrame, axes: Axes | None, by: str, drop_markers: Sequence[str], places: int | None = None
):
    """``(_group, _value, norm_value)``, saved: what each distinct value of a group becomes; and table, axes and group."""
    require(tall, "cell", "variable", "value")
    if by not in ("gene", "cell"):
        raise ValueError(f"by must be 'gene' or 'cell', not {by!r}")
    group = "variable" if by == "gene" else "cell"
    tall = drop_marker_genes(tall, drop_markers)
    if axes is not None:
        axes = Axes(axes.cells, drop_marker_genes(axes.genes, drop_markers))

    values = distinct_values(weighted_values(tall, group, "value", axes), group)
    runs = materialise(counts_before(values, group).withColumn("start", F.col("before")))
    amounts = runs.select(
        "start",
        "n",
        F.coalesce("value", F.lit(0.0)).alias("total"),
        F.when(F.col("value").isNull(), 0).otherwise(1).alias("groups"),
    )
    mean = F.try_divide("total", "groups")
    if places is not None:
        mean = F.round(mean, places) + F.lit(0.0)
    means = covering_sums(amounts, "total", "groups").select(F.col("position").alias("start"), mean.alias("norm_value"))
    # Saved, so that the optimizer knows its size: small for counts, which take few distinct values.
    lookup = materialise(
        runs.join(means, "start", "left").select(
            F.col(group).alias("_group"), F.col("value").alias("_value"), "norm_value"
        )
    )
    return lookup, tall, axes, group
