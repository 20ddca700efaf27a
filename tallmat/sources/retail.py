"""Count matrices derived from order tables, as test and benchmark input.

Genes are kinds of parts, with marker names worked in; cells are customers (sparse, like droplet
data) or suppliers (dense). A value is the quantity ordered.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallmat.operators.shape import densify
from tallmat.sources.counts import Counts
from tallmat.sources.tables import scratch_dir


# Matrices that a benchmark has built beforehand, by directory and cells; empty otherwise.
prepared: dict[tuple[str, str, bool], Counts] = {}


def prepare(spark: SparkSession, directory: str) -> None:
    """Build the matrices of a directory once, for a benchmark of the steps behind them."""
    for key in ((directory, "customer", False), (directory, "supplier", False), (directory, "customer", True)):
        prepared[key] = counts(spark, *key)


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def part_genes(spark: SparkSession, directory: str) -> DataFrame:
    """``(p_partkey, variable)``."""
    kind, size = F.col("p_type"), F.col("p_size")
    name = (
        F.when((kind == "PROMO") & (size <= 25), F.concat(F.lit("ERCC-"), size))
        .when((kind == "SMALL") & (size <= 15), F.concat(F.lit("MT-"), size))
        .when((kind == "LARGE") & (size == 1), F.lit("AMT-1"))
        .otherwise(F.concat(kind, F.lit("-"), size))
    )
    return table(spark, directory, "part").select("p_partkey", name.alias("variable"))


def _entries(lines: DataFrame, genes: DataFrame, cell) -> DataFrame:
    return (
        lines.join(genes, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(cell.alias("cell"), "variable")
        .agg(F.sum("l_quantity").cast("bigint").alias("value"))
    )


def customer_entries(spark: SparkSession, directory: str) -> DataFrame:
    """Non-zero entries with customers as cells."""
    lines = table(spark, directory, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = table(spark, directory, "orders").select("o_orderkey", "o_custkey")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return _entries(joined, part_genes(spark, directory), F.concat(F.lit("C-"), "o_custkey"))


def supplier_entries(spark: SparkSession, directory: str) -> DataFrame:
    """Non-zero entries with suppliers as cells."""
    lines = table(spark, directory, "lineitem").select("l_suppkey", "l_partkey", "l_quantity")
    return _entries(lines, part_genes(spark, directory), F.concat(F.lit("S-"), "l_suppkey"))


def counts(spark: SparkSession, directory: str, cells: str = "customer", dense: bool = False) -> Counts:
    """The matrix, written to the shared scratch folder and read from there."""
    if (directory, cells, dense) in prepared:
        return prepared[directory, cells, dense]
    name = "-".join([*directory.strip("/").split("/")[-1:], cells, "dense" if dense else "sparse"])
    path = f"{scratch_dir(spark)}/counts-{uuid.uuid4().hex}-{name}"
    if dense:
        source = counts(spark, directory, cells)
        # Its rows come cell by cell already.
        return Counts.save(densify(source.entries, source.axes), path, sparse=False, axes=source.axes, clustered=True)
    entries = {"customer": customer_entries, "supplier": supplier_entries}[cells](spark, directory)
    return Counts.save(entries, path, sparse=True)


def segments(spark: SparkSession, directory: str) -> DataFrame:
    """``(cell, prediction)``: the market segment of each customer, used as a cluster label."""
    return table(spark, directory, "customer").select(
        F.concat(F.lit("C-"), "c_custkey").alias("cell"), F.col("c_mktsegment").alias("prediction")
    )
