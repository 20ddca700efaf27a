"""Differential expression: pooled two-sample t-tests of one cluster against the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallmat.functions.stats import two_tailed_p
from tallmat.operators.axes import Axes, absent_zeros, require


def label_cells(tall: DataFrame, predictions: DataFrame, label: str = "prediction") -> DataFrame:
    """Attach a cluster label to every row; a cell without one gets NULL.

    Also labels ``Axes.cells``. The label table has one row per cell and no size bound, so the join
    strategy is left to the optimizer.
    """
    return tall.join(predictions.select("cell", F.col(label).alias("prediction")), "cell", "left")


def _groups(tall: DataFrame, axes: Axes | None) -> DataFrame:
    """``(variable, groups)``: per gene an array with one entry per cluster.

    An entry holds the number of rows (``size``), of values (``n``), their sum and their sum of squared
    deviations. The array is as long as there are clusters; the rows behind it are aggregated before
    they are shuffled, so neither a large cluster nor a frequent gene lands in one task.
    """
    stats = tall.groupBy("variable", "prediction").agg(
        F.count("cell").alias("size"),
        F.count("value").alias("n"),
        F.sum(F.col("value").cast("double")).alias("total"),
        (F.var_pop("value") * F.count("value")).alias("m2"),
    )
    entry = F.struct(
        "prediction",
        "size",
        "n",
        F.coalesce("total", F.lit(0.0)).alias("total"),
        F.coalesce("m2", F.lit(0.0)).alias("m2"),
    )
    if axes is None:
        return stats.groupBy("variable").agg(F.collect_list(entry).alias("groups"))
    require(axes.cells, "prediction")
    sizes = (
        axes.cells.groupBy("prediction")
        .agg(F.sum("copies").alias("cells"))
        .agg(F.collect_list(F.struct("prediction", "cells")))
        .scalar()
    )
    # Every gene with every cluster; what is stored joins by both, and absent zeros (mean 0, no deviation) are merged.
    every = axes.genes.select("variable", "copies", F.explode(sizes).alias("cluster")).select(
        F.col("variable").alias("gene"),
        F.col("cluster.prediction").alias("label"),
        (F.col("cluster.cells") * F.col("copies")).alias("full"),
    )
    same = (F.col("gene") == F.col("variable")) & F.col("label").eqNullSafe(F.col("prediction"))
    zeros = absent_zeros(F.col("full"), F.col("size"))
    n, total = F.coalesce("n", F.lit(0)), F.coalesce("total", F.lit(0.0))
    shift = F.coalesce(F.try_divide(total * total * F.col("zeros"), n * (n + F.col("zeros"))), F.lit(0.0))
    merged = F.struct(
        F.col("label").alias("prediction"),
        F.col("full").alias("size"),
        (n + F.col("zeros")).alias("n"),
        total.alias("total"),
        (F.coalesce("m2", F.lit(0.0)) + shift).alias("m2"),
    )
    joined = every.join(stats, same, "left").withColumn("zeros", zeros)
    return joined.groupBy(F.col("gene").alias("variable")).agg(F.collect_list(merged).alias("groups"))


def _merge(a: Column, b: Column) -> Column:
    """Moments of two sets of values together; equal means leave the deviation as it is."""
    n = a["n"] + b["n"]
    delta = F.coalesce(b["mean"] - a["mean"], F.lit(0.0))
    share = F.coalesce(F.try_divide(b["n"].cast("double"), n), F.lit(0.0))
    return F.struct(
        (a["size"] + b["size"]).alias("size"),
        n.alias("n"),
        F.when(a["n"] == 0, b["mean"]).when(b["n"] == 0, a["mean"]).otherwise(a["mean"] + delta * share).alias("mean"),
        (a["m2"] + b["m2"] + delta * delta * a["n"] * share).alias("m2"),
    )


def _before_each(groups: Column) -> Column:
    """For each position of an array of moments, the merged moments of all entries before it."""
    kind = "struct<size: bigint, n: bigint, mean: double, m2: double>"
    nothing = F.struct(F.lit(0), F.lit(0), F.lit(None), F.lit(0.0)).cast(kind)
    start = F.struct(nothing.alias("so_far"), F.array().cast(f"array<{kind}>").alias("list"))
    return F.aggregate(
        groups,
        start,
        lambda acc, g: F.struct(
            _merge(acc["so_far"], g).cast(kind).alias("so_far"),
            F.concat(acc["list"], F.array(acc["so_far"])).alias("list"),
        ),
    )["list"]


def _one_vs_rest(groups: DataFrame) -> DataFrame:
    """One row per gene and labelled cluster: its statistics beside those of all other cells.

    The other clusters are those before and those behind it in the list, each merged once along the list, so the
    work is linear in the clusters. Nothing is obtained by subtraction, so a gene that is constant outside the
    cluster keeps a deviation of exactly 0.
    """
    moments = F.transform(
        "groups",
        lambda g: F.struct(
            g["size"].alias("size"), g["n"].alias("n"), F.try_divide(g["total"], g["n"]).alias("mean"), g["m2"].alias("m2")
        ),
    )
    listed = groups.select("variable", "groups", moments.alias("moments")).select(
        "variable",
        "groups",
        _before_each(F.col("moments")).alias("before"),
        F.reverse(_before_each(F.reverse("moments"))).alias("behind"),
    )
    each = (
        listed.select("variable", F.explode(F.arrays_zip("groups", "before", "behind")).alias("at"))
        .select("variable", F.col("at.groups").alias("own"), _merge(F.col("at.before"), F.col("at.behind")).alias("rest"))
        .where(F.col("own.prediction").isNotNull())
    )
    return each.select(
        "variable",
        F.col("own.prediction").alias("prediction"),
        F.col("own.size").alias("in_size"),
        F.try_divide("own.total", "own.n").alias("in_mean"),
        F.sqrt(F.try_divide(F.col("own.m2"), F.col("own.n") - 1)).alias("in_sd"),
        F.col("rest.size").alias("out_size"),
        F.col("rest.mean").alias("out_mean"),
        F.sqrt(F.try_divide(F.col("rest.m2"), F.col("rest.n") - 1)).alias("out_sd"),
    )


def _t_test(stats: DataFrame) -> DataFrame:
    """Add degrees of freedom, pooled deviation, t and its two-tailed p (NULL where undefined)."""
    one = F.lit(1)
    squares = (F.col("in_size") - one) * F.col("in_sd") * F.col("in_sd") + (F.col("out_size") - one) * F.col(
        "out_sd"
    ) * F.col("out_sd")
    error = F.col("sdp") * F.sqrt(F.try_divide(one, F.col("in_size")) + F.try_divide(one, F.col("out_size")))
    return (
        stats.withColumn("df", F.col("in_size") + F.col("out_size") - 2)
        .withColumn("sdp", F.sqrt(F.try_divide(squares, F.col("df"))))
        .withColumn("t_test", F.try_divide(F.col("in_mean") - F.col("out_mean"), error))
        .withColumn("p_val", two_tailed_p(F.col("t_test"), F.col("df")))
    )


def _mark(df: DataFrame, cluster_id, drop_unlabelled: bool) -> DataFrame:
    if drop_unlabelled:
        df = df.where(F.col("prediction").isNotNull())
    return df.withColumn("prediction", F.coalesce(F.col("prediction") == F.lit(cluster_id), F.lit(False)))


def two_group_stats(
    tall: DataFrame, cluster_id=0, axes: Axes | None = None, drop_unlabelled: bool = False
) -> DataFrame:
    """Per gene: size, mean, deviation inside and outside the cluster, df, sdp, t_test, p_val.

    ``tall`` (and ``axes.cells`` for a sparse matrix) carry ``prediction``, see :func:`label_cells`.
    Unlabelled cells count as outside unless dropped.
    """
    require(tall, "cell", "variable", "value", "prediction")
    tall = _mark(tall, cluster_id, drop_unlabelled)
    if axes is not None:
        axes = Axes(_mark(axes.cells, cluster_id, drop_unlabelled), axes.genes)
    return _t_test(_one_vs_rest(_groups(tall, axes)).where("prediction").drop("prediction"))


def diff_expr_top_n(
    tall: DataFrame,
    cluster_id=0,
    n: int = 10,
    alpha: float = 0.05,
    axes: Axes | None = None,
    drop_unlabelled: bool = False,
) -> DataFrame:
    """``(variable, t_test, p_val, rank)`` of the ``n`` genes with the smallest p <= alpha.

    Equal p-values go by the larger \\|t\\|, then by name. No multiple-testing correction is made.
    """
    tested = two_group_stats(tall, cluster_id, axes, drop_unlabelled).where(F.col("p_val") <= alpha)
    order = [F.col("p_val"), F.abs("t_test").desc(), F.col("variable")]
    top = tested.select("variable", "t_test", "p_val").orderBy(*order).limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def one_vs_rest_stats(tall: DataFrame, axes: Axes | None = None, drop_unlabelled: bool = False) -> DataFrame:
    """The statistics of :func:`two_group_stats` for every cluster, from one pass over the matrix."""
    require(tall, "cell", "variable", "value", "prediction")
    if drop_unlabelled:
        tall = tall.where(F.col("prediction").isNotNull())
        if axes is not None:
            axes = Axes(axes.cells.where(F.col("prediction").isNotNull()), axes.genes)
    return _t_test(_one_vs_rest(_groups(tall, axes)))


def diff_expr_all(
    tall: DataFrame,
    n: int = 10,
    alpha: float = 0.05,
    axes: Axes | None = None,
    drop_unlabelled: bool = False,
) -> DataFrame:
    """``(prediction, variable, t_test, p_val, rank)``: the top ``n`` genes of every cluster at once."""
    order = Window.partitionBy("prediction").orderBy("p_val", F.abs("t_test").desc(), "variable")
    return (
        one_vs_rest_stats(tall, axes, drop_unlabelled)
        .where(F.col("p_val") <= alpha)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= n)
        .select("prediction", "variable", "t_test", "p_val", "rank")
    )


def gene_dict(top: DataFrame) -> dict[str, float]:
    """``{gene: p_value}`` of a top-n table, in rank order."""
    return {row["variable"]: row["p_val"] for row in top.orderBy("rank").collect()}
