"""The two axes of a tall matrix, and what may be assumed about them.

A tall matrix ``(cell, variable, value)`` is either *dense* (a row for each cell and gene, zeros
included) or *sparse* (only the non-zero entries are stored). For a sparse one the axes say which
cells and genes exist, so every operator can account for the absent zeros arithmetically instead of
writing them out. Count matrices are mostly zeros, so this saves most of the rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallmat.operators.ordering import number_rows


@dataclass(frozen=True)
class Axes:
    """``cells (cell, copies)`` and ``genes (variable, copies)``.

    ``copies`` is the number of input rows that carried the label: 1, or more where labels repeat.
    """

    cells: DataFrame
    genes: DataFrame

    @classmethod
    def of(cls, tall: DataFrame) -> Axes:
        """The axes spanned by the stored entries themselves."""
        one = F.lit(1).cast("bigint").alias("copies")
        return cls(
            tall.select("cell").distinct().select("cell", one),
            tall.select("variable").distinct().select("variable", one),
        )

    def restrict(self, cells: DataFrame | None = None, genes: DataFrame | None = None) -> Axes:
        """Keep only the listed cells and/or genes."""
        return Axes(
            self.cells if cells is None else self.cells.join(cells, "cell", "left_semi"),
            self.genes if genes is None else self.genes.join(genes, "variable", "left_semi"),
        )

    def cell_total(self) -> Column:
        """Number of cells, as a scalar subquery."""
        return self.cells.agg(F.coalesce(F.sum("copies"), F.lit(0))).scalar()

    def gene_total(self) -> Column:
        """Number of genes, as a scalar subquery."""
        return self.genes.agg(F.coalesce(F.sum("copies"), F.lit(0))).scalar()

    def population(self, key: str) -> DataFrame:
        """``(key, population)``: how many entries each cell or gene has in the dense matrix."""
        if key == "cell":
            return self.cells.select("cell", (F.col("copies") * self.gene_total()).alias("population"))
        return self.genes.select("variable", (F.col("copies") * self.cell_total()).alias("population"))


def absent_zeros(population: Column, stored: Column) -> Column:
    """Zeros left out of a sparse group; fails where the group stores more entries than it can have."""
    zeros = population - F.coalesce(stored, F.lit(0))
    message = F.lit("sparse matrix holds more entries than its axes allow (repeated cell/gene pairs?)")
    return F.when(zeros < 0, F.raise_error(message).cast("bigint")).otherwise(zeros)


def require(df: DataFrame, *names: str) -> DataFrame:
    """Check the tall contract by column name."""
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"missing column(s) {missing}; found {df.columns[:10]}")
    return df


def indexed_genes(genes: DataFrame) -> DataFrame:
    """``(variable, position)``, positions from 0 in alphabetical order; saved, which runs a job."""
    return number_rows(genes.select("variable").distinct(), F.col("variable"), name="position")
