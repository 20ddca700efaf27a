"""Reading a wide CSV count matrix, in either orientation, straight into the tall form."""

from __future__ import annotations

import csv
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallmat.functions.labels import HEADER_CHARACTERS, clean_label, clean_names, header_names
from tallmat.operators.axes import Axes
from tallmat.operators.shape import melt, to_wide
from tallmat.sources.tables import materialise, read_table, write_table

ORIENTATIONS = ("cells_by_genes", "genes_by_cells")


@dataclass(frozen=True)
class Counts:
    """A tall matrix with its axes.

    ``sparse`` says whether zero entries are left out, ``clustered`` whether the entries of a cell lie
    together already, as they do when a file has one line per cell.
    """

    entries: DataFrame
    axes: Axes
    sparse: bool
    clustered: bool = False

    def implied(self) -> Axes | None:
        """What operators take as ``axes``: the axes of a sparse matrix, None for a dense one."""
        return self.axes if self.sparse else None

    def wide(self, value: str = "value") -> DataFrame:
        """The cells x genes table."""
        return to_wide(self.entries, value=value, axes=self.implied())

    def store(self, path: str) -> Counts:
        """Write entries and axes below ``path`` and return the matrix as read back."""
        return Counts.save(self.entries, path, self.sparse, self.axes, self.clustered)

    @classmethod
    def save(
        cls, entries: DataFrame, path: str, sparse: bool, axes: Axes | None = None, clustered: bool = False
    ) -> Counts:
        """Write a tall table, clustered by cell; its axes are taken from the result unless they are given.

        Entries that are clustered already are written as they come, without a shuffle.
        """
        spark = entries.sparkSession
        write_table(entries, f"{path}/entries", cluster_by=() if clustered else ("cell", "variable"))
        axes = axes or Axes.of(read_table(spark, f"{path}/entries"))
        write_table(axes.cells, f"{path}/cells")
        write_table(axes.genes, f"{path}/genes")
        return cls.load(spark, path, sparse)

    @classmethod
    def load(cls, spark: SparkSession, path: str, sparse: bool) -> Counts:
        """Read what :meth:`store` wrote."""
        entries, cells, genes = (read_table(spark, f"{path}/{name}") for name in ("entries", "cells", "genes"))
        return cls(entries, Axes(cells, genes), sparse, clustered=True)


def read_counts(
    spark: SparkSession,
    path: str,
    orientation: str = "cells_by_genes",
    clean: bool = True,
    keep_zeros: bool = True,
    quoted_body: bool = False,
    bad_as_null: bool = False,
) -> Counts:
    """Read a CSV whose first column holds row labels and whose header holds column labels.

    Header and body are split as text and exploded, so neither the plan nor the driver grows with the number of
    columns, be they genes or cells. ``quoted_body=True`` reads the body with Spark's CSV source instead,
    for files that quote their numbers; there the header is parsed on the driver and the plan has an
    expression per column. An empty field, ``NA`` and ``NaN`` are NULL; other text that is no number fails, or
    becomes NULL with ``bad_as_null=True``. A row with more or fewer fields than the header fails.

    ``clean=False`` leaves the row labels as they are (headers are cleaned always).
    ``keep_zeros=False`` gives the sparse form.
    """
    if orientation not in ORIENTATIONS:
        raise ValueError(f"orientation must be one of {ORIENTATIONS}, not {orientation!r}")
    lines = spark.read.text(path)
    first = lines.limit(1)
    if first.count() == 0:
        raise ValueError(f"{path} is empty")
    header = first.select(F.regexp_replace("value", "^\ufeff", "").alias("value"))

    label: Column = clean_label("label") if clean else F.col("label")
    if quoted_body:
        raw = next(csv.reader([header.first()[0]]))
        names = clean_names(header_names(raw, spark.conf.get("spark.sql.caseSensitive") == "true"))[1:]
        columns = spark.createDataFrame(list(enumerate(names)), "position int, column string")
        body = _csv_body(spark, path, names)
        labels = body.select(label.alias("label"))
        rows = melt(body, ["label"], names, "column", "raw")
    else:
        columns = materialise(_header_columns(header, spark.conf.get("spark.sql.caseSensitive") == "true"))
        body = _text_body(lines, first.scalar(), columns.agg(F.count(F.lit(1))).scalar())
        labels = body.select(label.alias("label"))
        cells = body.select("label", F.posexplode("fields").alias("position", "raw"))
        if not keep_zeros:
            # Most fields are the text '0'; drop them before they are cast and joined.
            cells = cells.where(F.trim("raw") != "0")
        rows = cells.join(columns, "position").select("label", "column", "raw")
    number = F.col("raw").try_cast("double")
    unreadable = number.isNull() & ~F.upper(F.trim("raw")).isin("", "NA", "NAN")
    message = F.concat(F.lit("not a number: "), F.col("raw"))
    value = F.when(~F.isnan(number), number)
    if not bad_as_null:
        value = F.when(unreadable, F.raise_error(message).cast("double")).otherwise(value)
    by_cell = orientation == "cells_by_genes"
    row_axis, column_axis = ("cell", "variable") if by_cell else ("variable", "cell")
    entries = rows.select(
        label.alias(row_axis), F.col("column").alias(column_axis), value.alias("value")
    ).select("cell", "variable", "value")
    if not keep_zeros:
        entries = entries.where(F.col("value").isNull() | (F.col("value") != 0))

    row_labels = labels.groupBy(F.col("label").alias(row_axis)).agg(F.count(F.lit(1)).alias("copies"))
    column_labels = columns.select(F.col("column").alias(column_axis), F.lit(1).cast("bigint").alias("copies"))
    axes = Axes(row_labels, column_labels) if by_cell else Axes(column_labels, row_labels)
    return Counts(entries, axes, sparse=not keep_zeros, clustered=by_cell)


def _header_columns(header: DataFrame, case_sensitive: bool) -> DataFrame:
    """``(position, column)`` of the value columns, named as :func:`header_names` and :func:`clean_names` do.

    Fields are split where a comma is outside quotes. Names that repeat are numbered in windows over equal names,
    so the labels of a million columns stay in Spark.
    """
    fields = F.regexp_extract_all(F.concat(F.lit(","), "value"), F.lit(r',("(?:[^"]|"")*"|[^,]*)'), F.lit(1))
    quoted = F.col("field").startswith('"') & (F.length("field") > 1)
    inner = F.replace(F.expr("substring(field, 2, length(field) - 2)"), F.lit('""'), F.lit('"'))
    named = header.select(F.posexplode(fields).alias("i", "field")).select("i", F.when(quoted, inner).otherwise(F.col("field")).alias("name"))
    same = F.col("name") if case_sensitive else F.lower("name")
    repeats = F.count(F.lit(1)).over(Window.partitionBy(same))
    blank = F.col("name") == ""
    unique = F.when(blank, F.concat(F.lit("_c"), "i")).when(repeats > 1, F.concat("name", F.col("i").cast("string"))).otherwise(F.col("name"))
    cleaned = F.translate(unique, HEADER_CHARACTERS, "_" * len(HEADER_CHARACTERS))
    numbered = named.select("i", cleaned.alias("name")).withColumn(
        "turn", F.row_number().over(Window.partitionBy("name").orderBy("i"))
    )
    # A number that gives a name which is there already is passed over.
    present = numbered.select(F.col("name").alias("there")).distinct()
    base = F.regexp_extract("there", r"^(.*)_(\d+)$", 1)
    taken = present.select(base.alias("base"), F.regexp_extract("there", r"^(.*)_(\d+)$", 2).alias("digits"))
    held = (
        taken.where((F.col("digits") != "") & ~F.col("digits").startswith("0") & (F.length("digits") < 9))
        .groupBy("base")
        .agg(F.array_sort(F.collect_set(F.col("digits").cast("int"))).alias("held"))
    )
    # The smallest number from 2 on of which turn - 1 are free, counting up past the held ones.
    free = F.aggregate("held", F.col("turn"), lambda at, h: F.when((h >= 2) & (h <= at), at + 1).otherwise(at))
    joined = numbered.join(held, F.col("name") == F.col("base"), "left")
    final = F.when(F.col("turn") == 1, F.col("name")).otherwise(
        F.concat("name", F.lit("_"), F.coalesce(free, F.col("turn")).cast("string"))
    )
    return joined.where("i > 0").select((F.col("i") - 1).alias("position"), final.alias("column"))


def _text_body(lines: DataFrame, header: Column, width: Column) -> DataFrame:
    """``(label, fields)`` of every body line. The label may be quoted, the numbers may not."""
    quoted = F.regexp_extract("value", r'^"((?:[^"]|"")*)",', 1)
    is_quoted = F.col("value").startswith('"')
    label = F.when(is_quoted, F.replace(quoted, F.lit('""'), F.lit('"'))).otherwise(
        F.substring_index("value", ",", 1)
    )
    # regexp_replace would copy the long line through the regex engine; cut by length instead.
    skip = F.when(is_quoted, F.length(quoted) + 4).otherwise(F.length(F.substring_index("value", ",", 1)) + 2)
    rest = F.expr("substring(value, skip)")
    fields = F.split(F.col("rest"), ",")
    message = F.concat(F.lit("expected "), width.cast("string"), F.lit(" values in the row of "), F.col("label"))
    checked = F.when(F.size("fields") == width, F.col("fields")).otherwise(
        F.raise_error(message).cast("array<string>")
    )
    return (
        lines.where((F.col("value") != header) & (F.trim("value") != ""))
        .select("value", label.alias("label"), skip.alias("skip"))
        .select("label", rest.alias("rest"))
        .select("label", fields.alias("fields"))
        .select("label", checked.alias("fields"))
    )


def _csv_body(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Wide body read by Spark's CSV source, every field as text."""
    schema = ", ".join(f"`{name.replace('`', '``')}` string" for name in ["label", *columns])
    return (
        spark.read.option("header", True)
        .option("enforceSchema", True)
        .option("maxColumns", len(columns) + 2)
        .option("mode", "FAILFAST")
        .schema(schema)
        .csv(path)
    )
