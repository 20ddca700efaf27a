"""Matrices that are constant per gene except at their stored entries.

Quantile normalisation gives the zeros of a gene a value of their own, so its result is dense; but all zeros of a gene get the
same one. Kept as that baseline and the deviations of the stored entries, the matrix stays as small as its input. Spread does
not change when a gene is shifted, so variances, deviations from the median and components come from the deviations alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallmat.operators.axes import Axes, indexed_genes
from tallmat.operators.shape import densify, to_sparse


@dataclass(frozen=True)
class Baselined:
    """``entries (cell, variable, deviation)``, ``baseline (variable, base)`` with a row per gene, and the axes.

    The value of a pair is its gene's base, plus its deviation where one is stored.
    """

    entries: DataFrame
    baseline: DataFrame
    axes: Axes

    def values(self) -> DataFrame:
        """``(cell, variable, norm_value)`` of the stored entries."""
        value = F.col("base") + F.col("deviation")
        return self.entries.join(self.baseline, "variable").select("cell", "variable", value.alias("norm_value"))

    def dense(self) -> DataFrame:
        """``(cell, variable, norm_value)`` of every cell and gene; as large as the matrix."""
        value = F.col("base") + F.col("deviation")
        rows = densify(self.entries, self.axes, "deviation")
        return rows.join(self.baseline, "variable").select("cell", "variable", value.alias("norm_value"))

    def shifted(self, stats: DataFrame, *names: str) -> DataFrame:
        """Statistics per gene of the deviations, with the base added to those that move with it."""
        moved = {name: F.col(name) + F.col("base") for name in names}
        return stats.join(self.baseline, "variable").withColumns(moved).drop("base")

    def restrict(self, genes: DataFrame) -> Baselined:
        """Keep only the listed genes."""
        listed = genes.select("variable")
        kept = (df.join(listed, "variable", "left_semi") for df in (self.entries, self.baseline))
        return Baselined(*kept, self.axes.restrict(genes=listed))

    def to_sparse(self) -> DataFrame:
        """The deviations as sparse rows, for components: these are the same, their scores lower by a constant each."""
        return to_sparse(self.entries, self.axes, "deviation")

    def offset(self) -> np.ndarray:
        """The bases in alphabetical order of the genes, one number per gene, to bring scores back: ``pca(..., offset=...)``."""
        rows = self.baseline.join(indexed_genes(self.axes.genes), "variable").select("position", "base").collect()
        out = np.zeros(len(rows))
        out[[r["position"] for r in rows]] = [r["base"] for r in rows]
        return out
