"""The whole analysis: QC, filter, normalise, select genes, reduce, cluster, test."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallmat.operators import cluster, de, hvg, normalize, qc, reduce, shape
from tallmat.operators.axes import Axes
from tallmat.sources.counts import Counts, read_counts
from tallmat.sources.tables import read_table, scratch_dir, write_table


@dataclass(frozen=True)
class Settings:
    """Choices of :func:`run`."""

    limits: qc.Thresholds = field(default_factory=qc.Thresholds)
    apply_ercc: bool = True
    apply_mito: bool = True
    normalisation: str = "global"
    n_genes: int | None = 2000
    mad_above: float | None = None
    order: str = "desc"
    n_components: int = 50
    n_clusters: int = 6
    with_silhouette: bool = False
    seed: int = 125
    top_genes: int = 10
    alpha: float = 0.05
    match: str = "contains"


class Stages:
    """Saved tables below ``path``, each with a mark that is written after it and holds the fingerprint of its run.

    A table whose mark has the present fingerprint is read; any other is made and written again. A run that was stopped
    half-way left no mark for the table it was writing, so that table is made anew.
    """

    def __init__(self, spark: SparkSession, path: str, fingerprint: str):
        self.spark, self.path, self.fingerprint = spark, path, fingerprint
        self.made: list[str] = []

    def done(self, name: str) -> bool:
        try:
            marks = self.spark.read.schema("fingerprint string").parquet(f"{self.path}/marks/{name}")
        except AnalysisException:
            return False
        return marks.where(F.col("fingerprint") == self.fingerprint).limit(1).count() == 1

    def mark(self, name: str) -> None:
        self.made.append(name)
        write_table(self.spark.createDataFrame([(self.fingerprint,)], "fingerprint string"), f"{self.path}/marks/{name}")

    def table(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        return self.tables((name,), lambda: (make(),))[0]

    def tables(self, names: tuple[str, ...], make: Callable[[], tuple[DataFrame, ...]]) -> tuple[DataFrame, ...]:
        """Tables that one computation gives; made together unless all are there."""
        if not all(self.done(name) for name in names):
            for name, df in zip(names, make(), strict=True):
                write_table(df, f"{self.path}/{name}")
                self.mark(name)
        return tuple(read_table(self.spark, f"{self.path}/{name}") for name in names)


def input_version(spark: SparkSession, source: str) -> str:
    """A digest of the names, sizes and times of the files of an input; their contents are not read."""
    files = spark.read.format("binaryFile").load(source).select("path", "length", F.unix_micros("modificationTime").alias("time"))
    known = files.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("path", "length", "time").cast("decimal(38,0)")).alias("sum")).first()
    return f"{source} {known['n']} {known['sum']}"


def run(
    spark: SparkSession,
    source: str | Counts,
    settings: Settings = Settings(),
    path: str | None = None,
    orientation: str = "cells_by_genes",
    version: str | None = None,
) -> dict[str, DataFrame]:
    """Run all steps on a CSV path or a :class:`Counts`; returns every intermediate and final table.

    Gene QC is computed on the unfiltered matrix and not again. Stages that several later steps read
    are saved below ``path`` (by default in the session's scratch folder) and read back, so nothing
    is computed twice and a lost executor costs one stage at most.

    Run again with the same ``path``, settings and input, it goes on after the stages that were finished. A changed
    file or setting makes all of them anew. ``version`` names the input; a CSV path is known by its files, while a
    :class:`Counts` without a version is taken as new.
    """
    path = path or f"{scratch_dir(spark)}/workflow-{uuid.uuid4().hex}"
    if version is None:
        version = input_version(spark, source) if isinstance(source, str) else uuid.uuid4().hex
    stages = Stages(spark, path, hashlib.sha256(f"{settings!r} {orientation} {version}".encode()).hexdigest())
    if stages.done("counts"):
        counts = Counts.load(spark, f"{path}/counts", sparse=isinstance(source, str) or source.sparse)
    else:
        counts = read_counts(spark, source, orientation, keep_zeros=False) if isinstance(source, str) else source
        counts = counts.store(f"{path}/counts")
        stages.mark("counts")
    tall, axes = counts.entries, counts.implied()

    cells_qc = stages.table("qc_cells", lambda: qc.qc_cells(tall, counts.implied(), settings.match))
    genes_qc = stages.table("qc_genes", lambda: qc.qc_genes(tall, counts.implied()))
    rules = (cells_qc, genes_qc, settings.apply_ercc, settings.apply_mito, settings.limits)
    # Neither the filter nor the join with the cell totals scatters the entries of a cell, so these
    # stages are written as they come.
    filtered = stages.table("filtered", lambda: qc.filter_matrix(tall, *rules))
    if axes is not None:
        kept = qc.filter_axes(axes, *rules)
        axes = Axes(*stages.tables(("kept_cells", "kept_genes"), lambda: (kept.cells, kept.genes)))

    if settings.normalisation == "global":
        norm = normalize.norm_global(filtered)
        norm_axes = None if axes is None else normalize.defined_axes(filtered, axes)
    else:
        norm, norm_axes = normalize.norm_quantile(filtered, axes), None
    norm = stages.table("normalised", lambda normalised=norm: normalised)

    # With both limits a gene must pass both.
    genes = hvg.hvg_cv2(norm, settings.n_genes, settings.order, axes=norm_axes)
    if settings.mad_above is not None:
        spread = hvg.hvg_mad(norm, settings.mad_above, axes=norm_axes).select("variable", "median", "MAD")
        genes = genes.join(spread, "variable")
    genes = stages.table("hvg", lambda chosen=genes: chosen)
    chosen = hvg.select_genes(norm, genes)
    vector_axes = None if norm_axes is None else norm_axes.restrict(genes=genes.select("variable"))
    # A sparse matrix stays sparse up to its components.
    rows = shape.to_vectors(chosen) if vector_axes is None else shape.to_sparse(chosen, vector_axes)
    vectors = stages.table("vectors", lambda: rows)

    def reduced() -> tuple[DataFrame, DataFrame]:
        result = reduce.pca(vectors, settings.n_components)
        return result.components, result.explained

    def clustered() -> tuple[DataFrame, DataFrame]:
        result = cluster.kmeans(
            components.withColumnRenamed("components", "features"),
            settings.n_clusters,
            with_silhouette=settings.with_silhouette,
            seed=settings.seed,
        )
        return result.predictions, spark.createDataFrame([result.metrics], "k int, silhouette double, sse double")

    components, explained = stages.tables(("pca", "explained_variance"), reduced)
    predictions, metrics = stages.tables(("predictions", "metrics"), clustered)

    labelled = de.label_cells(filtered, predictions)
    labelled_axes = None if axes is None else Axes(de.label_cells(axes.cells, predictions), axes.genes)
    top = de.diff_expr_all(labelled, settings.top_genes, settings.alpha, labelled_axes)
    return {
        "qc_cells": cells_qc,
        "qc_genes": genes_qc,
        "removal_report": qc.removal_report(*rules),
        "filtered": filtered,
        "normalised": norm,
        "hvg": genes,
        "pca": components,
        "explained_variance": explained,
        "predictions": predictions,
        "metrics": metrics,
        "cluster_sizes": cluster.cluster_sizes(predictions),
        "diff_expr": stages.table("diff_expr", lambda: top),
    }


def save(results: dict[str, DataFrame], path: str) -> None:
    """Write every table of a run below ``path``."""
    for name, df in results.items():
        write_table(df, f"{path}/{name}")
