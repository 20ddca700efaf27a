"""Selection of highly variable genes, by squared coefficient of variation or median deviation.

A :class:`~tallmat.operators.baseline.Baselined` matrix, which brings its own axes, may stand for ``norm`` everywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallmat.operators.axes import Axes, absent_zeros, require
from tallmat.operators.baseline import Baselined
from tallmat.operators.ordering import number_rows
from tallmat.operators.ranks import distinct_values, weighted_median, weighted_values
from tallmat.stages import materialise


def gene_moments(norm: DataFrame | Baselined, axes: Axes | None = None, value: str = "norm_value") -> DataFrame:
    """``(variable, mean, sd, var, co_var, CV2)`` per gene, one aggregation.

    The absent zeros of a sparse matrix enter through the merge rule for means and sums of squares,
    whose terms are all positive, so nothing cancels.
    """
    if isinstance(norm, Baselined):
        stats = gene_moments(norm.entries, norm.axes, "deviation").select("variable", "mean", "sd", "var")
        return _with_variation(norm.shifted(stats, "mean"))
    require(norm, "variable", value)
    stats = norm.groupBy("variable").agg(
        F.count(F.lit(1)).alias("stored"),
        F.count(value).alias("k"),
        F.mean(value).alias("stored_mean"),
        F.var_pop(value).alias("stored_var"),
    )
    if axes is None:
        zeros = F.lit(0)
    else:
        stats = axes.population("variable").join(stats, "variable", "left")
        zeros = absent_zeros(F.col("population"), F.col("stored"))
    k, mean = F.coalesce("k", F.lit(0)), F.coalesce("stored_mean", F.lit(0.0))
    squares = F.coalesce(F.col("stored_var") * k, F.lit(0.0))
    merged = stats.withColumn("zeros", zeros).withColumn("n", k + F.col("zeros"))
    merged = merged.select(
        "variable",
        "n",
        F.try_divide(mean * k, F.col("n")).alias("mean"),
        (squares + F.coalesce(mean * mean * F.try_divide(k * F.col("zeros"), F.col("n")), F.lit(0.0))).alias("m2"),
    )
    return _with_variation(
        merged.select(
            "variable",
            "mean",
            F.sqrt(F.try_divide("m2", F.col("n") - 1)).alias("sd"),
            F.try_divide("m2", F.col("n") - 1).alias("var"),
        )
    )


def _with_variation(stats: DataFrame) -> DataFrame:
    return stats.select(
        "*",
        F.try_divide("sd", "mean").alias("co_var"),
        F.pow(F.try_divide("sd", "mean"), F.lit(2)).alias("CV2"),
    )


def gene_mad(norm: DataFrame | Baselined, axes: Axes | None = None, value: str = "norm_value") -> DataFrame:
    """``(variable, median, MAD)``: exact median and (unscaled) median absolute deviation per gene.

    The matrix is read once, into distinct values with their counts; median and deviations come from those. They
    and the medians are written to the scratch folder, which runs jobs.
    """
    if isinstance(norm, Baselined):
        return norm.shifted(gene_mad(norm.entries, norm.axes, "deviation"), "median")
    require(norm, "variable", value)
    values = materialise(distinct_values(weighted_values(norm, "variable", value, axes), "variable"))
    medians = materialise(weighted_median(values, "variable"))
    deviations = values.join(medians, "variable").select(
        "variable", F.abs(F.col("value") - F.col("median")).alias("value"), "n"
    )
    mads = weighted_median(distinct_values(deviations, "variable"), "variable")
    return medians.join(mads.select("variable", F.col("median").alias("MAD")), "variable")


def hvg_stats(norm: DataFrame | Baselined, axes: Axes | None = None, value: str = "norm_value") -> DataFrame:
    """All per-gene statistics: moments, CV and CV2, median and MAD."""
    return gene_moments(norm, axes, value).join(gene_mad(norm, axes, value), "variable", "left")


def hvg_cv2(
    norm: DataFrame | Baselined,
    n: int | None = 2000,
    order: str = "desc",
    axes: Axes | None = None,
    value: str = "norm_value",
) -> DataFrame:
    """``(variable, CV2, rank)`` of the first ``n`` genes by CV2, of all with ``n=None``. Ranking runs jobs.

    ``order='desc'`` gives the most variable genes, those without a CV2 last. ``order='asc'`` gives the
    least variable ones, those without a CV2 (mean 0) first. Ties go by name.
    """
    if order not in ("desc", "asc"):
        raise ValueError(f"order must be 'desc' or 'asc', not {order!r}")
    by = F.col("CV2").desc_nulls_last() if order == "desc" else F.col("CV2").asc_nulls_first()
    stats = gene_moments(norm, axes, value).select("variable", "CV2")
    top = stats if n is None else stats.orderBy(by, "variable").limit(n)
    ranked = number_rows(top, by, F.col("variable"), name="rank")
    return ranked.select("variable", "CV2", (F.col("rank") + 1).cast("int").alias("rank"))


def hvg_mad(
    norm: DataFrame | Baselined,
    k: float = 3,
    keep: str = "above",
    axes: Axes | None = None,
    value: str = "norm_value",
) -> DataFrame:
    """``(variable, median, MAD)`` of genes with MAD > k, or with ``keep='at_or_below'`` MAD <= k.

    A gene without any value has no MAD; it counts as not above.
    """
    if keep not in ("above", "at_or_below"):
        raise ValueError(f"keep must be 'above' or 'at_or_below', not {keep!r}")
    above = F.coalesce(F.col("MAD") > k, F.lit(False))
    return gene_mad(norm, axes, value).where(above if keep == "above" else ~above)


def select_genes(tall: DataFrame | Baselined, genes: DataFrame) -> DataFrame | Baselined:
    """Rows of the listed genes; how to join is left to the optimizer, which knows the list's size."""
    if isinstance(tall, Baselined):
        return tall.restrict(genes)
    return tall.join(genes.select("variable"), "variable", "left_semi")
