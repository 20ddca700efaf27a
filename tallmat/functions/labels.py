"""Cleaning of column headers and of cell or gene labels."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters replaced in headers, and the pattern replaced in labels.
HEADER_CHARACTERS = ". ()"
LABEL_PATTERN = r"[.\s()]"

_HEADER_TABLE = str.maketrans({char: "_" for char in HEADER_CHARACTERS})


def header_names(raw: Sequence[str | None], case_sensitive: bool = False) -> list[str]:
    """Name CSV columns as Spark's CSV source does.

    A blank header becomes ``_c<position>``; a header that occurs more than once gets its
    position appended at every occurrence.
    """
    fold = (lambda name: name) if case_sensitive else str.lower
    seen = Counter(fold(name) for name in raw if name)
    return [
        f"_c{i}" if not name else f"{name}{i}" if seen[fold(name)] > 1 else name
        for i, name in enumerate(raw)
    ]


def clean_names(names: Sequence[str]) -> list[str]:
    """Replace each of ``. ( )`` and space by ``_``; number later collisions ``_2``, ``_3``, ..."""
    cleaned = [name.translate(_HEADER_TABLE) for name in names]
    taken, used, result = set(cleaned), set(), []
    for name in cleaned:
        unique, number = name, 1
        while unique in used or (number > 1 and unique in taken):
            number += 1
            unique = f"{name}_{number}"
        used.add(unique)
        result.append(unique)
    return result


def clean_label(label: Column | str) -> Column:
    """Replace dots, parentheses and every white-space character of a label by ``_``."""
    return F.regexp_replace(label, LABEL_PATTERN, "_")
