"""Column-level building blocks: labels, marker predicates and test statistics."""

from tallmat.functions.labels import clean_label, clean_names, header_names
from tallmat.functions.markers import is_marker
from tallmat.functions.stats import percent, two_tailed_p

__all__ = [
    "clean_label",
    "clean_names",
    "header_names",
    "is_marker",
    "percent",
    "two_tailed_p",
]
