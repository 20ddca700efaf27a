"""Readers and writers: wide CSV matrices, metadata, saved stages."""

from tallmat.sources.counts import Counts, read_counts
from tallmat.sources.tables import (
    export_csv,
    materialise,
    read_metadata,
    read_table,
    scratch_dir,
    write_table,
)

__all__ = [
    "Counts",
    "export_csv",
    "materialise",
    "read_counts",
    "read_metadata",
    "read_table",
    "scratch_dir",
    "write_table",
]
