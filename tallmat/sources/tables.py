"""Saved stages (Parquet), CSV export and metadata. Any Hadoop path works, HDFS included."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallmat.functions.labels import clean_label, clean_names
from tallmat.operators.shape import Packed
from tallmat.stages import materialise, scratch_dir, write_table

__all__ = ["export_csv", "materialise", "read_metadata", "read_table", "scratch_dir", "write_bucketed", "write_table"]


def write_bucketed(df: DataFrame, table: str, buckets: int, key: str = "cell", path: str | None = None) -> None:
    """Save as a catalog table bucketed by ``key``.

    Aggregates by and joins on ``key`` then need no shuffle of the matrix. Bucket by ``cell`` for
    cell QC, filtering and global normalisation. One bucket is read by one task, so prefer
    :func:`write_table` where a single key holds a large part of the rows.
    """
    writer = df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key)
    (writer.option("path", path) if path else writer).saveAsTable(table)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Read a saved stage."""
    return spark.read.parquet(path)


def export_csv(df: DataFrame | Packed, path: str, single_file: bool = False) -> None:
    """Write CSV with a header, in parallel, or as one file where the result is small.

    A packed table is written as lines of text, so its columns may be millions.
    """
    if isinstance(df, Packed):
        _csv_lines(df, single_file).write.mode("overwrite").text(path)
        return
    (df.coalesce(1) if single_file else df).write.mode("overwrite").option("header", True).csv(path)


def _csv_lines(packed: Packed, single_file: bool) -> DataFrame:
    """``(value)``: the lines that :func:`export_csv` writes of a wide table; a partition begins with the header."""

    def field(label: Column) -> Column:
        return F.when(label.isNull(), "").otherwise(F.to_csv(F.struct(label)))

    names = packed.columns.select("position", field(F.col("label")).alias("name"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("position", "name"))), lambda c: c["name"])
    header = names.agg(F.concat_ws(",", F.array(field(F.lit(packed.index))), listed)).scalar()
    numbers = F.transform(F.col("values").cast("array<string>"), lambda v: F.coalesce(v, F.lit("")))
    # With a row for the header alone, as a matrix may have none.
    lines = packed.rows.select(F.concat_ws(",", F.array(field(F.col("label"))), numbers).alias("line")).unionByName(
        packed.rows.sparkSession.range(1).select(F.lit(None).cast("string").alias("line"))
    )
    lines = lines.coalesce(1) if single_file else lines
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    headed = lines.select("line", first.alias("first")).where("first OR line IS NOT NULL")
    return headed.select(F.concat_ws("\n", F.when(F.col("first"), header), "line").alias("value"))


def read_metadata(spark: SparkSession, path: str, cell_column: str | None = None, schema: str | None = None) -> DataFrame:
    """Read annotations: headers cleaned, the cell label column renamed to ``cell`` and cleaned.

    ``cell_column`` is the header of the label column, by default ``cell``. Types are inferred unless
    a ``schema`` is given.
    """
    reader = spark.read.option("header", True)
    df = (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    if cell_column and cell_column != "cell":
        df = df.withColumnRenamed(cell_column, "cell")
    df = df.toDF(*clean_names(df.columns))
    return df.withColumn("cell", clean_label(F.col("cell").cast("string")))
