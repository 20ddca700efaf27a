"""Reshaping: melt, pivot, transpose, dense/sparse conversion, vectors."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegralType, NumericType

from tallmat.functions.labels import clean_label, clean_names
from tallmat.operators.axes import Axes, indexed_genes, require
from tallmat.stages import materialise

# Entries, zeros included where they are laid out, of the cells that one task handles, and of those that are worth a task.
TASK_ENTRIES, FEW_ENTRIES = 2_000_000, 50_000


def clean_columns(df: DataFrame) -> DataFrame:
    """Clean all column names; different names that clean to the same one are numbered."""
    return df.toDF(*clean_names(df.columns))


def clean_labels(df: DataFrame, *columns: str) -> DataFrame:
    """Clean the values of the given label columns."""
    return df.withColumns({name: clean_label(name) for name in columns})


def melt(
    df: DataFrame,
    id_vars: Sequence[str] = ("cell",),
    value_vars: Sequence[str] | None = None,
    var_name: str = "variable",
    value_name: str = "value",
) -> DataFrame:
    """Wide to tall. NULL entries are kept.

    Values of different types are widened: whole numbers to bigint, other numbers to double, and all to string as soon as
    one column is no number.
    """
    values = list(value_vars) if value_vars is not None else [c for c in df.columns if c not in id_vars]
    types = {df.schema[name].dataType for name in values}
    if len(types) > 1:
        df = df.withColumns({name: F.col(f"`{name}`").cast(_common_type(types)) for name in values})
    ids = [F.col(f"`{name}`") for name in id_vars]
    return df.unpivot(ids, [F.col(f"`{name}`") for name in values], var_name, value_name)


def _common_type(types: set[DataType]) -> str:
    if all(isinstance(t, IntegralType) for t in types):
        return "bigint"
    if all(isinstance(t, NumericType) for t in types):
        return "double"
    return "string"


def pivot_values(tall: DataFrame, column: str = "variable") -> list[str]:
    """The sorted distinct labels that become columns of a wide table; a plan has an expression for each."""
    return sorted(row[0] for row in tall.select(column).where(F.col(column).isNotNull()).distinct().collect())


@dataclass(frozen=True)
class Packed:
    """A wide table whose value columns lie in one array: ``rows (label, values)``, ``columns (label, position)``.

    ``index`` is the name of the label column. No plan has an expression per column.
    """

    index: str
    rows: DataFrame
    columns: DataFrame


def to_wide(
    tall: DataFrame,
    values: Sequence[str] | None = None,
    index: str = "cell",
    columns: str = "variable",
    value: str = "norm_value",
    axes: Axes | None = None,
    packed: bool = False,
) -> DataFrame | Packed:
    """Tall to wide, one column per gene; repeated pairs give their maximum.

    The columns are ``values``, or the sorted labels of the axis or the data (which needs a job to list
    them). With ``axes`` absent pairs are 0 and cells without an entry have a row. For machine learning
    use :func:`to_vectors`, which has no per-gene plan expressions.

    ``packed`` gives the same table of a sparse matrix for any number of columns, all labels of the axis, with the
    values of a row in one array.
    """
    require(tall, index, columns, value)
    if packed:
        if axes is None or values is not None:
            raise ValueError("a packed table has the columns of the axes")
        return _packed(tall, axes, index, columns, value)
    if axes is None:
        names = list(values) if values is not None else pivot_values(tall, columns)
        return tall.groupBy(index).pivot(columns, names).agg(F.max(value))
    rows, cols = (axes.cells, axes.genes) if index == "cell" else (axes.genes, axes.cells)
    names = list(values) if values is not None else pivot_values(cols, columns)
    # The row count tells a missing pair from a pair whose value is NULL. Columns are named by position, as labels
    # may differ in case only.
    pivoted = tall.groupBy(index).pivot(columns, names).agg(F.struct(F.max(value).alias("max"), F.count(F.lit(1)).alias("rows")))
    both = pivoted.toDF(index, *[f"p{i}" for i in range(len(names))])
    zero = F.lit(0).cast(tall.schema[value].dataType)
    return rows.select(index).join(both, index, "left").select(
        index,
        *[
            F.when(F.coalesce(F.col(f"p{i}.rows"), F.lit(0)) == 0, zero).otherwise(F.col(f"p{i}.max")).alias(name)
            for i, name in enumerate(names)
        ],
    )


def _packed(tall: DataFrame, axes: Axes, index: str, columns: str, value: str) -> Packed:
    rows, cols = (axes.cells, axes.genes) if index == "cell" else (axes.genes, axes.cells)
    places = indexed_genes(cols.where(F.col(columns).isNotNull()).select(F.col(columns).alias("variable")))
    turned = tall.select(F.col(index).alias("cell"), F.col(columns).alias("variable"), value)
    values = _dense_rows(turned, Axes(rows.select(F.col(index).alias("cell")), places), places, value)
    return Packed(
        index,
        values.select(F.col("cell").alias("label"), F.col("entries").alias("values")),
        places.select(F.col("variable").alias("label"), "position"),
    )


def transpose(
    wide: DataFrame, index: str = "cell", new_index: str = "variable", values: Sequence[str] | None = None
) -> DataFrame:
    """Swap the rows and columns of a wide matrix: melt, then pivot on the former row label."""
    tall = melt(wide, [index], var_name=new_index)
    return to_wide(tall, values, index=new_index, columns=index, value="value")


def sparsify(tall: DataFrame, value: str = "value") -> DataFrame:
    """Drop the zero rows; take :meth:`Axes.of` of the dense table first to remember its extent."""
    return tall.where(F.col(value).isNull() | (F.col(value) != 0))


def _parts(df: DataFrame, entries: int) -> int:
    """Into how many parts to deal cells with so many entries: a task's memory then does not grow with the matrix."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return max(1, min(cores, math.ceil(entries / FEW_ENTRIES)), math.ceil(entries / TASK_ENTRIES))


def _dense_rows(tall: DataFrame, axes: Axes, genes: DataFrame, value: str, zeros: DataFrame | None = None) -> DataFrame:
    """``(cell, entries)``: per cell its values in alphabetical gene order, absent ones as 0, or as ``zeros (cell, zero)`` says.

    The sparse entries are shuffled, never the dense rows: zeros appear after the last shuffle, as
    the gaps between the stored positions are filled. A cell's list is at most as long as the gene
    axis because repeated pairs are merged (to their maximum, as in a pivot) before it is collected. Cells are dealt
    into parts of about ``TASK_ENTRIES`` dense rows, so that the task that lays them out holds no more; counting
    the cells runs a job.
    """
    cells = axes.cells.select("cell")
    parts = _parts(tall, cells.count() * genes.count())
    last = genes.agg(F.coalesce(F.max("position"), F.lit(-1))).scalar()
    stored = (
        tall.join(genes, "variable")
        .select("cell", "position", F.col(value).alias("value"))
        .repartition(parts, "cell")
        .groupBy("cell", "position")
        .agg(F.max("value").alias("value"))
        .groupBy("cell")
        .agg(F.sort_array(F.collect_list(F.struct("position", "value"))).alias("stored"))
    )
    zero = (F.lit(0) if zeros is None else F.col("zero")).cast(tall.schema[value].dataType)

    def absent(count: Column) -> Column:
        return F.array_repeat(zero, count.cast("int"))

    def with_gap(entry: Column, i: Column) -> Column:
        # get() gives NULL before the first entry, where the previous position counts as -1.
        previous = F.coalesce(F.get(F.col("stored"), i - 1)["position"], F.lit(-1))
        return F.concat(absent(entry["position"] - previous - 1), F.array(entry["value"]))

    tail = last - F.coalesce(F.try_element_at("stored", F.lit(-1))["position"], F.lit(-1))
    entries = F.concat(F.flatten(F.transform("stored", with_gap)), absent(tail))
    empty = F.array().cast(stored.schema["stored"].dataType)
    laid = cells.repartition(parts, "cell").join(stored, "cell", "left")
    if zeros is not None:
        laid = laid.join(zeros, "cell", "left")
    return laid.withColumn("stored", F.coalesce("stored", empty)).select("cell", entries.alias("entries"))


def densify(tall: DataFrame, axes: Axes | None = None, value: str = "value", zeros: DataFrame | None = None) -> DataFrame:
    """Sparse to dense tall: every cell with every gene, absent pairs as 0, or as ``zeros (cell, zero)`` says for their cell.

    The output is as large as the matrix. Operators take ``axes`` instead of a densified input;
    use this only where the zero rows themselves are wanted.
    """
    axes = axes or Axes.of(tall)
    # The outer form keeps the optimizer from computing the array twice to test its size.
    genes = indexed_genes(axes.genes)
    rows = _dense_rows(tall, axes, genes, value, zeros).select("cell", F.posexplode_outer("entries").alias("position", value))
    return rows.join(genes, "position").select("cell", "variable", value)


def to_vectors(
    tall: DataFrame,
    axes: Axes | None = None,
    value: str = "norm_value",
    impute: float | None = None,
    output: str = "features",
) -> DataFrame:
    """Tall to ``(cell, vector)`` without a wide table, genes in alphabetical order.

    With ``axes`` absent pairs are 0. Without, every cell must hold every gene. A NULL value fails,
    or is replaced by ``impute``.
    """
    require(tall, "cell", "variable", value)
    if impute is not None:
        tall = tall.withColumn(value, F.coalesce(value, F.lit(impute)))
    if axes is None:
        n_genes = tall.select("variable").distinct().agg(F.count(F.lit(1))).scalar()
        rows = (
            tall.groupBy("cell", "variable")
            .agg(F.max(value).alias("value"))
            .groupBy("cell")
            .agg(F.sort_array(F.collect_list(F.struct("variable", "value"))).alias("stored"))
            .select("cell", F.transform("stored", lambda entry: entry["value"]).alias("entries"))
        )
        incomplete = F.size("entries") != n_genes
    else:
        rows = _dense_rows(tall, axes, indexed_genes(axes.genes), value)
        incomplete = F.lit(False)
    failed = F.raise_error(F.lit("a cell lacks a gene or has a NULL value")).cast("array<double>")
    bad = incomplete | F.exists("entries", lambda x: x.isNull())
    checked = F.when(bad, failed).otherwise(F.col("entries").cast("array<double>"))
    return rows.select("cell", array_to_vector(checked).alias(output))


def to_sparse(
    tall: DataFrame,
    axes: Axes | None = None,
    value: str = "norm_value",
    impute: float | None = None,
    output: str = "features",
) -> DataFrame:
    """Tall to ``(cell, sparse row)`` from the stored entries alone: a struct of ``size``, ``indices`` and ``values``.

    Indices are those of the genes in alphabetical order, rising; what is not stored is 0 and costs nothing. Cells
    without an entry have empty lists. A NULL value fails, or is replaced by ``impute``; repeated pairs give their
    maximum. :func:`tallmat.operators.reduce.pca` takes these rows as they are. The entries are saved first, which runs a
    job, and cells are dealt into parts of about ``TASK_ENTRIES`` of them.
    """
    require(tall, "cell", "variable", value)
    axes = axes or Axes.of(tall)
    genes = indexed_genes(axes.genes)
    size = genes.agg(F.coalesce(F.max("position") + 1, F.lit(0))).scalar()
    given = F.col(value) if impute is None else F.coalesce(value, F.lit(impute))
    failed = F.raise_error(F.lit("a cell has a NULL value")).cast("double")
    entries = tall.select("cell", "variable", F.coalesce(given.cast("double"), failed).alias("value"))
    placed = materialise(entries.join(genes, "variable").select("cell", F.col("position").cast("int").alias("position"), "value"))
    parts = _parts(tall, placed.count())
    stored = (
        placed.repartition(parts, "cell")
        .groupBy("cell", "position")
        .agg(F.max("value").alias("value"))
        .where("value <> 0")
        .groupBy("cell")
        .agg(F.array_sort(F.collect_list(F.struct("position", "value"))).alias("stored"))
    )
    indices = F.coalesce("stored.position", F.array().cast("array<int>"))
    values = F.coalesce("stored.value", F.array().cast("array<double>"))
    row = F.struct(size.cast("int").alias("size"), indices.alias("indices"), values.alias("values"))
    return axes.cells.select("cell").repartition(parts, "cell").join(stored, "cell", "left").select("cell", row.alias(output))
