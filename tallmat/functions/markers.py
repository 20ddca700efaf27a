"""Marker-gene predicates: spike-in controls (ERCC) and mitochondrial genes (MT)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two marker families.
ERCC = "ercc"
MITO = "mt"


def is_marker(gene: Column | str, marker: str, match: str = "contains") -> Column:
    """True where the lower-cased gene name contains (or starts with) ``marker``.

    ``match='contains'`` also takes names such as ``AMT3`` or ``MTOR`` for mitochondrial ones;
    ``match='prefix'`` is the strict reading.
    """
    name = F.lower(F.col(gene) if isinstance(gene, str) else gene)
    if match == "contains":
        return name.contains(marker.lower())
    if match == "prefix":
        return name.startswith(marker.lower())
    raise ValueError(f"match must be 'contains' or 'prefix', not {match!r}")
