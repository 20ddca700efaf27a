"""Quality summaries per cell and per gene, threshold filters and their reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallmat.functions.markers import ERCC, MITO, is_marker
from tallmat.functions.stats import percent
from tallmat.operators.axes import Axes, absent_zeros, require
from tallmat.stages import materialise


def qc_cells(tall: DataFrame, axes: Axes | None = None, match: str = "contains") -> DataFrame:
    """One row per cell: totals, number of expressed genes, marker counts, sums and percentages.

    With ``axes`` the input is sparse; cells without any stored entry are reported as well.
    """
    require(tall, "cell", "variable", "value")
    value = F.col("value")
    ercc, mito = is_marker("variable", ERCC, match), is_marker("variable", MITO, match)
    stats = tall.groupBy("cell").agg(
        F.sum(value).alias("total"),
        F.count(value).alias("observed"),
        F.count(F.lit(1)).alias("stored"),
        F.count_if(value > 0).alias("expressed"),
        F.count_if(ercc & (value > 0)).alias("ercc_expressed"),
        F.sum(F.when(ercc, value).otherwise(0)).alias("ercc_total"),
        F.count_if(mito & (value > 0)).alias("mito_expressed"),
        F.sum(F.when(mito, value).otherwise(0)).alias("mito_total"),
    )
    if axes is None:
        zeros = F.lit(0)
    else:
        stats = axes.population("cell").join(stats, "cell", "left")
        zeros = absent_zeros(F.col("population"), F.col("stored"))

    def count(name: str) -> Column:
        return F.coalesce(name, F.lit(0))

    def total(name: str) -> Column:
        return F.when(F.col("zeros") > 0, F.coalesce(name, F.lit(0))).otherwise(F.col(name))

    sums = stats.withColumn("zeros", zeros).select(
        "cell",
        total("total").alias("sum_of_all_entries"),
        F.try_divide(total("total"), count("observed") + F.col("zeros")).cast("double").alias("average_of_sum"),
        count("expressed").alias("total_number_of_columns"),
        count("ercc_expressed").alias("total_number_of_ERCC_entry"),
        total("ercc_total").alias("sum_of_ercc"),
        count("mito_expressed").alias("total_number_of_MT_entry"),
        total("mito_total").alias("sum_of_mt"),
    )
    return sums.select(
        "*",
        percent(F.col("sum_of_ercc"), F.col("sum_of_all_entries")).alias("percentage_of_ercc"),
        percent(F.col("sum_of_mt"), F.col("sum_of_all_entries")).alias("percentage_of_mt"),
        F.log1p("sum_of_all_entries").alias("log1p_of_sum_of_all_entries"),
        F.log1p("sum_of_ercc").alias("log1p_of_sum_of_ercc"),
        F.log1p("sum_of_mt").alias("log1p_of_sum_of_mt"),
    )


def qc_genes(tall: DataFrame, axes: Axes | None = None) -> DataFrame:
    """One row per gene: cells expressing it, total, mean, dropouts (explicit or absent zeros)."""
    require(tall, "cell", "variable", "value")
    value = F.col("value")
    stats = tall.groupBy("variable").agg(
        F.count_if(value > 0).alias("expressed"),
        F.sum(value).alias("total"),
        F.count(value).alias("observed"),
        F.count(F.lit(1)).alias("stored"),
        F.count_if(value == 0).alias("zero"),
    )
    if axes is None:
        absent = F.lit(0)
    else:
        stats = axes.population("variable").join(stats, "variable", "left")
        absent = absent_zeros(F.col("population"), F.col("stored"))

    def count(name: str) -> Column:
        return F.coalesce(name, F.lit(0))

    total = F.when(F.col("absent") > 0, F.coalesce("total", F.lit(0))).otherwise(F.col("total"))
    sums = stats.withColumn("absent", absent).select(
        F.col("variable").alias("gene_name"),
        count("expressed").alias("no_cells_by_counts"),
        total.alias("sum_of_cells"),
        F.try_divide(total, count("observed") + F.col("absent")).cast("double").alias("mean_counts"),
        (count("zero") + F.col("absent")).alias("no_of_dropouts"),
    )
    considered = F.col("no_of_dropouts") + F.col("no_cells_by_counts")
    return sums.select(
        "*",
        percent(F.col("no_of_dropouts"), considered).alias("pct_dropout_by_counts"),
        F.log1p("mean_counts").alias("log1p_of_mean_counts"),
        F.log1p("sum_of_cells").alias("log1p_total_counts"),
    )


@dataclass(frozen=True)
class Thresholds:
    """Filter limits. A cell or gene is removed where any of its rules is true; NULL removes nothing."""

    min_genes: int = 10
    min_counts: float = 1000
    max_ercc_percent: float = 10
    max_mito_percent: float = 5
    max_dropout_percent: float = 90
    min_cells: int = 5

    def removes_cell(self, apply_ercc: bool = True, apply_mito: bool = False) -> Column:
        """True for QC rows of cells to drop; the marker limits themselves are dropped."""
        rules = [F.col("total_number_of_columns") < self.min_genes, F.col("sum_of_all_entries") < self.min_counts]
        if apply_ercc:
            rules.append(F.col("percentage_of_ercc") >= self.max_ercc_percent)
        if apply_mito:
            rules.append(F.col("percentage_of_mt") >= self.max_mito_percent)
        return _any(rules)

    def removes_gene(self) -> Column:
        """True for QC rows of genes to drop; the limits themselves are kept."""
        return _any(
            [F.col("pct_dropout_by_counts") > self.max_dropout_percent, F.col("no_cells_by_counts") < self.min_cells]
        )


def _any(rules: list[Column]) -> Column:
    result = F.lit(False)
    for rule in rules:
        result = result | F.coalesce(rule, F.lit(False))
    return result


def kept_cells(
    qc: DataFrame, apply_ercc: bool = True, apply_mito: bool = False, limits: Thresholds = Thresholds()
) -> DataFrame:
    """``(cell)`` of the cells that pass."""
    return qc.where(~limits.removes_cell(apply_ercc, apply_mito)).select("cell")


def kept_genes(qc: DataFrame, limits: Thresholds = Thresholds()) -> DataFrame:
    """``(variable)`` of the genes that pass."""
    return qc.where(~limits.removes_gene()).select(F.col("gene_name").alias("variable"))


def filter_cells(
    tall: DataFrame,
    qc: DataFrame,
    apply_ercc: bool = True,
    apply_mito: bool = False,
    limits: Thresholds = Thresholds(),
) -> DataFrame:
    """Rows of the cells that pass.

    The list of cells has no size bound, so the join is left to the optimizer: a list known or found
    to be small is broadcast, a long one is merged by ``cell``, with skewed cells split.
    """
    return tall.join(kept_cells(qc, apply_ercc, apply_mito, limits), "cell", "left_semi")


def filter_genes(tall: DataFrame, qc: DataFrame, limits: Thresholds = Thresholds()) -> DataFrame:
    """Rows of the genes that pass; the gene list is bounded and broadcast."""
    return tall.join(kept_genes(qc, limits), "variable", "left_semi")


def filter_matrix(
    tall: DataFrame,
    cells_qc: DataFrame | None = None,
    genes_qc: DataFrame | None = None,
    apply_ercc: bool = True,
    apply_mito: bool = False,
    limits: Thresholds = Thresholds(),
) -> DataFrame:
    """Both filters; pass None to leave one out. Works alike on dense and sparse input.

    Gene QC is taken as given: computed before the cell filter unless the caller recomputes it.
    """
    # Genes first: that join needs no shuffle and shrinks what the cell filter moves.
    if genes_qc is not None:
        tall = filter_genes(tall, genes_qc, limits)
    if cells_qc is not None:
        tall = filter_cells(tall, cells_qc, apply_ercc, apply_mito, limits)
    return tall


def filter_axes(
    axes: Axes,
    cells_qc: DataFrame | None = None,
    genes_qc: DataFrame | None = None,
    apply_ercc: bool = True,
    apply_mito: bool = False,
    limits: Thresholds = Thresholds(),
) -> Axes:
    """The axes that go with :func:`filter_matrix` of a sparse matrix."""
    return axes.restrict(
        None if cells_qc is None else kept_cells(cells_qc, apply_ercc, apply_mito, limits),
        None if genes_qc is None else kept_genes(genes_qc, limits),
    )


def removal_report(
    cells_qc: DataFrame,
    genes_qc: DataFrame,
    apply_ercc: bool = True,
    apply_mito: bool = False,
    limits: Thresholds = Thresholds(),
) -> DataFrame:
    """``(axis, removed, total)``, one row for cells and one for genes."""

    def report(qc: DataFrame, axis: str, removed: Column) -> DataFrame:
        return qc.agg(F.count_if(removed).alias("removed"), F.count(F.lit(1)).alias("total")).select(
            F.lit(axis).alias("axis"), "removed", "total"
        )

    return report(cells_qc, "cells", limits.removes_cell(apply_ercc, apply_mito)).unionByName(
        report(genes_qc, "genes", limits.removes_gene())
    )


def shape_counts(tall: DataFrame, axes: Axes | None = None, approximate: bool = False) -> DataFrame:
    """``(cells, genes)``: number of distinct labels, exact or as an estimate. Axes are counted exactly."""
    if approximate and axes is None:
        return tall.agg(
            F.approx_count_distinct("cell").alias("cells"), F.approx_count_distinct("variable").alias("genes")
        )
    # Two separate distinct counts: a joint one would first duplicate every row. Save a table that is costly to make.
    cells = (tall if axes is None else axes.cells).agg(F.count_distinct("cell").alias("cells"))
    genes = (tall if axes is None else axes.genes).agg(F.count_distinct("variable")).scalar()
    return cells.select("cells", genes.alias("genes"))


def histogram_bins(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """``(bin, lower, upper, n)``: equal-width bins from minimum to maximum, the last one closed.

    Empty bins are listed with 0. NULLs are left out. Where all values are equal the range is widened
    by one half on both sides.
    """
    x = F.col(column).cast("double")
    # Saved, as it is read for the span and for the counts.
    data = materialise(df.select(x.alias("x")).where(F.col("x").isNotNull()))
    widen = F.when(F.min("x") == F.max("x"), 0.5).otherwise(0.0)
    span = data.agg(F.struct((F.min("x") - widen).alias("low"), (F.max("x") + widen).alias("high"))).scalar()
    counts = (
        data.select("x", span.alias("span"))
        .select(
            F.least(
                F.lit(bins),
                F.floor((F.col("x") - F.col("span.low")) / (F.col("span.high") - F.col("span.low")) * bins) + 1,
            ).alias("bin")
        )
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    width = (F.col("span.high") - F.col("span.low")) / bins
    return (
        df.sparkSession.range(1, bins + 1)
        .select(F.col("id").alias("bin"), span.alias("span"))
        .join(counts, "bin", "left")
        .select(
            F.col("bin").cast("int").alias("bin"),
            (F.col("span.low") + (F.col("bin") - 1) * width).alias("lower"),
            (F.col("span.low") + F.col("bin") * width).alias("upper"),
            F.coalesce("n", F.lit(0)).alias("n"),
        )
    )
