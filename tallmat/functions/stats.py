"""Numeric column expressions shared by the operators. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent(part: Column, whole: Column) -> Column:
    """``part / whole * 100``, NULL where ``whole`` is 0."""
    return F.try_divide(part, whole) * 100


def two_tailed_p(t: Column, df: Column) -> Column:
    """Two-tailed p-value of Student's t, NULL where t is undefined.

    ``p = I_x(df/2, 1/2)`` with ``x = df / (df + t^2)``; the regularised incomplete beta function is
    the one of the commons-math library on Spark's own class path.
    """
    x = df / (df + t * t)
    p = F.reflect(
        F.lit("org.apache.commons.math3.special.Beta"),
        F.lit("regularizedBeta"),
        x.cast("double"),
        (df / 2).cast("double"),
        F.lit(0.5),
    ).cast("double")
    return F.when(t.isNotNull() & ~F.isnan(t) & (df > 0), p)
