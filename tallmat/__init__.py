"""Analysis of large cell-by-gene count matrices with Spark DataFrames.

The central table is tall, ``(cell, variable, value)``, dense or sparse. See the README for the
operators; everything returns lazy DataFrames unless its docstring says otherwise.
"""

from tallmat.operators import cluster, de, hvg, neighbors, normalize, qc, reduce, shape
from tallmat.operators.axes import Axes
from tallmat.plans.workflow import Settings, run
from tallmat.sources.counts import Counts, read_counts

__all__ = [
    "Axes",
    "Counts",
    "Settings",
    "cluster",
    "de",
    "hvg",
    "neighbors",
    "normalize",
    "qc",
    "read_counts",
    "reduce",
    "run",
    "shape",
]
