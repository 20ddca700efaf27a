"""Registered queries: each operator on whole given tables, as ``(spark, directory) -> DataFrame``.

Doubles are rounded to six places so that results can be compared with another engine.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tallmat.functions.labels import clean_label
from tallmat.operators import cluster, de, hvg, neighbors, normalize, qc, reduce, shape
from tallmat.operators.axes import Axes
from tallmat.operators.baseline import Baselined
from tallmat.plans.workflow import Settings, run
from tallmat.sources import retail
from tallmat.sources.counts import Counts, read_counts
from tallmat.sources.tables import export_csv, materialise, read_metadata, scratch_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Marker genes of the derived matrix, for the pivot query.
PIVOT_GENES = ["AMT-1", "ERCC-1", "ERCC-2", "ERCC-3", "MT-1", "MT-2", "MT-3"]
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
TOP_CLUSTER = "BUILDING"
MAD_LIMIT = 0.6
N_HVG = 50
# Places of rounded doubles.
PLACES = 6


def query(function: Query) -> Query:
    """Register under the function's name."""
    QUERIES[function.__name__] = function
    return function


def rounded(df: DataFrame, places: int = PLACES) -> DataFrame:
    """Round the double columns; adding 0 turns -0.0 into 0.0."""
    return df.select(
        *[
            (F.round(f.name, places) + F.lit(0.0)).alias(f.name) if isinstance(f.dataType, DoubleType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def dense_counts(spark: SparkSession, directory: str) -> DataFrame:
    return retail.counts(spark, directory, dense=True).entries


def filtered(
    spark: SparkSession, directory: str, apply_ercc: bool = True, apply_mito: bool = False, save_qc: bool = False
) -> Counts:
    """The customer matrix after both filters, with the axes that go with it.

    ``save_qc`` writes the summaries first, for callers that use entries and axes.
    """
    counts = retail.counts(spark, directory)
    cells, genes = qc.qc_cells(counts.entries, counts.axes), qc.qc_genes(counts.entries, counts.axes)
    if save_qc:
        cells, genes = materialise(cells), materialise(genes)
    rules = (cells, genes, apply_ercc, apply_mito)
    return Counts(qc.filter_matrix(counts.entries, *rules), qc.filter_axes(counts.axes, *rules), sparse=True)


def saved(counts: Counts) -> Counts:
    """Write a stage that is read more than once, as an analysis does between its steps."""
    axes = Axes(materialise(counts.axes.cells), materialise(counts.axes.genes))
    return Counts(materialise(counts.entries), axes, counts.sparse)


def normalised(counts: Counts) -> Counts:
    return Counts(
        normalize.norm_global(counts.entries), normalize.defined_axes(counts.entries, counts.axes), sparse=True
    )


def labelled(spark: SparkSession, directory: str) -> Counts:
    """The customer matrix with the market segment as cluster label."""
    counts, labels = retail.counts(spark, directory), retail.segments(spark, directory)
    return Counts(
        de.label_cells(counts.entries, labels),
        Axes(de.label_cells(counts.axes.cells, labels), counts.axes.genes),
        sparse=True,
    )


def embedding_vectors(spark: SparkSession, directory: str) -> DataFrame:
    point = F.col("embedding").cast("array<double>")
    return retail.table(spark, directory, "embeddings").select(
        F.col("vec_id").alias("cell"), array_to_vector(point).alias("features"), F.col("label").alias("prediction")
    )


# Quality summaries, filters and reports


@query
def qc_cells(spark: SparkSession, directory: str) -> DataFrame:
    counts = retail.counts(spark, directory)
    return rounded(qc.qc_cells(counts.entries, counts.axes))


@query
def qc_cells_dense(spark: SparkSession, directory: str) -> DataFrame:
    return rounded(qc.qc_cells(dense_counts(spark, directory)))


@query
def qc_cells_prefix(spark: SparkSession, directory: str) -> DataFrame:
    counts = retail.counts(spark, directory)
    return rounded(qc.qc_cells(counts.entries, counts.axes, match="prefix"))


@query
def qc_genes(spark: SparkSession, directory: str) -> DataFrame:
    counts = retail.counts(spark, directory)
    return rounded(qc.qc_genes(counts.entries, counts.axes))


@query
def qc_genes_dense(spark: SparkSession, directory: str) -> DataFrame:
    return rounded(qc.qc_genes(dense_counts(spark, directory)))


@query
def filter_default(spark: SparkSession, directory: str) -> DataFrame:
    return filtered(spark, directory).entries.select("cell", "variable", "value")


@query
def filter_mito(spark: SparkSession, directory: str) -> DataFrame:
    return filtered(spark, directory, apply_mito=True).entries.select("cell", "variable", "value")


@query
def filter_no_markers(spark: SparkSession, directory: str) -> DataFrame:
    return filtered(spark, directory, apply_ercc=False).entries.select("cell", "variable", "value")


@query
def filter_genes_only(spark: SparkSession, directory: str) -> DataFrame:
    counts = retail.counts(spark, directory)
    kept = qc.filter_genes(counts.entries, qc.qc_genes(counts.entries, counts.axes))
    return kept.select("cell", "variable", "value")


@query
def filter_cells_only(spark: SparkSession, directory: str) -> DataFrame:
    counts = retail.counts(spark, directory)
    kept = qc.filter_cells(counts.entries, qc.qc_cells(counts.entries, counts.axes), apply_mito=True)
    return kept.select("cell", "variable", "value")


@query
def filter_dense(spark: SparkSession, directory: str) -> DataFrame:
    tall = dense_counts(spark, directory)
    kept = qc.filter_matrix(tall, qc.qc_cells(tall), qc.qc_genes(tall))
    return kept.select("cell", "variable", "value")


@query
def removal_report(spark: SparkSession, directory: str) -> DataFrame:
    counts = retail.counts(spark, directory)
    return qc.removal_report(qc.qc_cells(counts.entries, counts.axes), qc.qc_genes(counts.entries, counts.axes))


@query
def shape_counts(spark: SparkSession, directory: str) -> DataFrame:
    return qc.shape_counts(materialise(filtered(spark, directory, save_qc=True).entries))


@query
def hist_total_counts(spark: SparkSession, directory: str) -> DataFrame:
    counts = retail.counts(spark, directory)
    return rounded(qc.histogram_bins(qc.qc_cells(counts.entries, counts.axes), "sum_of_all_entries", 50))


@query
def hist_dropouts(spark: SparkSession, directory: str) -> DataFrame:
    counts = retail.counts(spark, directory)
    return rounded(qc.histogram_bins(qc.qc_genes(counts.entries, counts.axes), "pct_dropout_by_counts", 100))


# Reshaping, labels, sources


@query
def melt_qc_wide(spark: SparkSession, directory: str) -> DataFrame:
    counts = retail.counts(spark, directory)
    wide = qc.qc_cells(counts.entries, counts.axes).select(
        "cell", "sum_of_all_entries", "sum_of_ercc", "sum_of_mt", "percentage_of_ercc"
    )
    return rounded(shape.melt(wide))


@query
def pivot_marker_genes(spark: SparkSession, directory: str) -> DataFrame:
    counts = retail.counts(spark, directory)
    return shape.to_wide(counts.entries, PIVOT_GENES, value="value", axes=counts.axes)


@query
def transpose_small(spark: SparkSession, directory: str) -> DataFrame:
    counts = retail.counts(spark, directory)
    customer = retail.table(spark, directory, "customer").select(
        F.concat(F.lit("C-"), "c_custkey").alias("cell"), "c_mktsegment", "c_nationkey"
    )
    nation, region = retail.table(spark, directory, "nation"), retail.table(spark, directory, "region")
    places = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    sums = (
        counts.entries.join(customer, "cell")
        .join(places, F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy("c_mktsegment", "r_name")
        .agg(F.sum("value").alias("value"))
    )
    wide = shape.to_wide(sums, REGIONS, index="c_mktsegment", columns="r_name", value="value")
    return shape.transpose(shape.clean_columns(wide), "c_mktsegment", "r_name", SEGMENTS)


@query
def densify(spark: SparkSession, directory: str) -> DataFrame:
    counts = retail.counts(spark, directory)
    return shape.densify(counts.entries, counts.axes)


@query
def sparsify(spark: SparkSession, directory: str) -> DataFrame:
    return shape.sparsify(dense_counts(spark, directory))


@query
def clean_labels(spark: SparkSession, directory: str) -> DataFrame:
    part = retail.table(spark, directory, "part")
    label = F.concat("p_name", F.lit(" ("), "p_brand", F.lit(".v1)\t"), "p_size")
    return part.select("p_partkey", clean_label(label).alias("label"))


@query
def read_cells_by_genes(spark: SparkSession, directory: str) -> DataFrame:
    counts = retail.counts(spark, directory, "supplier")
    path = f"{scratch_dir(spark)}/wide-{uuid.uuid4().hex}"
    export_csv(counts.wide(), path)
    return read_counts(spark, path).entries.select("cell", "variable", F.col("value").cast("bigint").alias("value"))


@query
def read_genes_by_cells(spark: SparkSession, directory: str) -> DataFrame:
    counts = retail.counts(spark, directory, "supplier")
    path = f"{scratch_dir(spark)}/wide-{uuid.uuid4().hex}"
    wide = shape.to_wide(counts.entries, index="variable", columns="cell", value="value", axes=counts.axes, packed=True)
    export_csv(wide, path)
    tall = read_counts(spark, path, "genes_by_cells").entries
    return tall.select("cell", "variable", F.col("value").cast("bigint").alias("value"))


@query
def read_sparse(spark: SparkSession, directory: str) -> DataFrame:
    counts = retail.counts(spark, directory, "supplier")
    path = f"{scratch_dir(spark)}/wide-{uuid.uuid4().hex}"
    export_csv(counts.wide(), path)
    read = read_counts(spark, path, keep_zeros=False)
    return rounded(qc.qc_genes(read.entries, read.axes)).withColumns(
        {"sum_of_cells": F.col("sum_of_cells").cast("bigint")}
    )


@query
def metadata_round_trip(spark: SparkSession, directory: str) -> DataFrame:
    customer = retail.table(spark, directory, "customer").select(
        F.concat(F.col("c_name"), F.lit(" (v.1)")).alias("Cell id"),
        F.col("c_mktsegment").alias("sp.nme"),
        F.col("c_nationkey").alias("nation (key)"),
    )
    path = f"{scratch_dir(spark)}/metadata-{uuid.uuid4().hex}"
    export_csv(customer, path)
    return read_metadata(spark, path, cell_column="Cell id")


@query
def stage_round_trip(spark: SparkSession, directory: str) -> DataFrame:
    counts = retail.counts(spark, directory)
    return materialise(rounded(qc.qc_genes(counts.entries, counts.axes)))


# Normalisation


@query
def norm_global(spark: SparkSession, directory: str) -> DataFrame:
    return rounded(normalised(saved(filtered(spark, directory, save_qc=True))).entries)


@query
def norm_global_dense(spark: SparkSession, directory: str) -> DataFrame:
    return rounded(normalize.norm_global(dense_counts(spark, directory)))


@query
def norm_quantile(spark: SparkSession, directory: str) -> DataFrame:
    counts = saved(filtered(spark, directory, save_qc=True))
    return normalize.norm_quantile(counts.entries, counts.axes, places=PLACES)


def quantile_baselined(spark: SparkSession, directory: str) -> Baselined:
    counts = saved(filtered(spark, directory, save_qc=True))
    sparse = normalize.norm_quantile_sparse(counts.entries, counts.axes)
    return Baselined(materialise(sparse.entries), sparse.baseline, sparse.axes)


@query
def norm_quantile_sparse(spark: SparkSession, directory: str) -> DataFrame:
    return rounded(quantile_baselined(spark, directory).dense())


@query
def norm_quantile_entries(spark: SparkSession, directory: str) -> DataFrame:
    return rounded(quantile_baselined(spark, directory).values())


@query
def hvg_stats_quantile(spark: SparkSession, directory: str) -> DataFrame:
    return rounded(hvg.hvg_stats(quantile_baselined(spark, directory)))


@query
def pca_baselined_residuals(spark: SparkSession, directory: str) -> DataFrame:
    """Components of the sparse quantile-normalised matrix, held against its dense vectors."""
    matrix = quantile_baselined(spark, directory)
    result = reduce.pca(matrix.to_sparse(), k=5, offset=matrix.offset())
    return residuals(shape.to_vectors(matrix.dense()), result)


@query
def norm_quantile_dense(spark: SparkSession, directory: str) -> DataFrame:
    return normalize.norm_quantile(dense_counts(spark, directory), places=PLACES)


@query
def norm_quantile_by_cell(spark: SparkSession, directory: str) -> DataFrame:
    counts = saved(filtered(spark, directory, save_qc=True))
    return normalize.norm_quantile(counts.entries, counts.axes, by="cell", places=PLACES)


# Gene selection


@query
def hvg_stats(spark: SparkSession, directory: str) -> DataFrame:
    norm = saved(normalised(saved(filtered(spark, directory, save_qc=True))))
    return rounded(hvg.hvg_stats(norm.entries, norm.axes))


@query
def hvg_stats_dense(spark: SparkSession, directory: str) -> DataFrame:
    return rounded(hvg.hvg_stats(normalize.norm_global(dense_counts(spark, directory))))


@query
def hvg_cv2_desc(spark: SparkSession, directory: str) -> DataFrame:
    norm = normalised(saved(filtered(spark, directory, save_qc=True)))
    return rounded(hvg.hvg_cv2(norm.entries, N_HVG, axes=norm.axes))


@query
def hvg_cv2_asc(spark: SparkSession, directory: str) -> DataFrame:
    norm = normalised(saved(filtered(spark, directory, save_qc=True)))
    return rounded(hvg.hvg_cv2(norm.entries, N_HVG, "asc", norm.axes))


@query
def hvg_mad_above(spark: SparkSession, directory: str) -> DataFrame:
    norm = saved(normalised(retail.counts(spark, directory, "supplier")))
    return rounded(hvg.hvg_mad(norm.entries, MAD_LIMIT, axes=norm.axes))


@query
def hvg_mad_below(spark: SparkSession, directory: str) -> DataFrame:
    norm = saved(normalised(retail.counts(spark, directory, "supplier")))
    return rounded(hvg.hvg_mad(norm.entries, MAD_LIMIT, "at_or_below", norm.axes))


@query
def hvg_select(spark: SparkSession, directory: str) -> DataFrame:
    norm = normalised(saved(filtered(spark, directory, save_qc=True)))
    return rounded(hvg.select_genes(norm.entries, hvg.hvg_cv2(norm.entries, N_HVG, axes=norm.axes)))


@query
def to_vectors(spark: SparkSession, directory: str) -> DataFrame:
    norm = normalised(retail.counts(spark, directory, "supplier"))
    vectors = shape.to_vectors(norm.entries, norm.axes)
    values = vectors.select("cell", F.posexplode(vector_to_array("features")).alias("position", "value"))
    return rounded(values)


# Differential expression


@query
def de_stats(spark: SparkSession, directory: str) -> DataFrame:
    counts = labelled(spark, directory)
    return rounded(de.two_group_stats(counts.entries, TOP_CLUSTER, counts.axes))


@query
def de_stats_dense(spark: SparkSession, directory: str) -> DataFrame:
    tall = de.label_cells(dense_counts(spark, directory), retail.segments(spark, directory))
    return rounded(de.two_group_stats(tall, TOP_CLUSTER))


@query
def de_top10_building(spark: SparkSession, directory: str) -> DataFrame:
    counts = labelled(spark, directory)
    return rounded(de.diff_expr_top_n(counts.entries, TOP_CLUSTER, axes=counts.axes))


@query
def de_all_clusters(spark: SparkSession, directory: str) -> DataFrame:
    counts = labelled(spark, directory)
    return rounded(de.diff_expr_all(counts.entries, axes=counts.axes))


# Dimension reduction and clustering


@query
def pca_total_variance(spark: SparkSession, directory: str) -> DataFrame:
    vectors = embedding_vectors(spark, directory)
    result = reduce.pca(vectors, k=64)
    values = result.components.select(F.posexplode(vector_to_array("components")).alias("component", "value"))
    spread = values.groupBy("component").agg(F.var_samp("value").alias("var"))
    return rounded(spread.agg(F.sum("var").alias("total_variance"), F.count(F.lit(1)).alias("components")))


@query
def pca_components(spark: SparkSession, directory: str) -> DataFrame:
    norm = normalised(retail.counts(spark, directory, "supplier"))
    vectors = materialise(shape.to_vectors(norm.entries, norm.axes))
    return rounded(reduce.coordinates(reduce.pca(vectors, k=10).components))


@query
def pca_explained(spark: SparkSession, directory: str) -> DataFrame:
    return rounded(reduce.pca(embedding_vectors(spark, directory), k=50).explained)


def residuals(vectors: DataFrame, result: reduce.PcaResult) -> DataFrame:
    """Per component how far it is from an eigenvector of the covariance, and from the other components.

    The covariance of every coordinate with a component's score must be its variance times its loading.
    """
    spark = vectors.sparkSession
    scores = result.components.select("cell", F.posexplode(vector_to_array("components")).alias("component", "score"))
    values = vectors.select("cell", F.posexplode(vector_to_array("features")).alias("gene", "x"))
    joint = values.join(scores, "cell").groupBy("component", "gene").agg(F.covar_samp("x", "score").alias("c"))
    loadings = spark.createDataFrame(
        [(i, j, float(v)) for j, row in enumerate(result.loadings) for i, v in enumerate(row)],
        "component int, gene int, loading double",
    )
    spread = scores.groupBy("component").agg(F.var_samp("score").alias("variance"))
    off = joint.join(loadings, ["component", "gene"]).join(spread, "component").groupBy("component").agg(
        F.sqrt(F.sum(F.pow(F.col("c") - F.col("variance") * F.col("loading"), F.lit(2)))).alias("residual"),
        F.sum(F.col("loading") * F.col("loading")).alias("length"),
    )
    other = loadings.select(F.col("component").alias("other"), "gene", F.col("loading").alias("l2"))
    overlap = loadings.join(other, "gene").where("component <> other").groupBy("component", "other").agg(
        F.abs(F.sum(F.col("loading") * F.col("l2"))).alias("o")
    )
    worst = overlap.groupBy("component").agg(F.max("o").alias("overlap"))
    return rounded(off.join(worst, "component").select("component", "residual", "length", "overlap"), 5)


@query
def pca_residuals(spark: SparkSession, directory: str) -> DataFrame:
    vectors = embedding_vectors(spark, directory)
    return residuals(vectors, reduce.pca(vectors, k=10))


@query
def pca_sparse_residuals(spark: SparkSession, directory: str) -> DataFrame:
    """The same of components from sparse rows, held against the dense vectors."""
    norm = saved(normalised(retail.counts(spark, directory, "supplier")))
    sparse = shape.to_sparse(norm.entries, norm.axes)
    return residuals(shape.to_vectors(norm.entries, norm.axes), reduce.pca(sparse, k=5))


@query
def pca_sparse_explained(spark: SparkSession, directory: str) -> DataFrame:
    """Shares of variance from sparse rows, less the variance of the scores over the total variance of the dense vectors."""
    norm = saved(normalised(retail.counts(spark, directory, "supplier")))
    result = reduce.pca(shape.to_sparse(norm.entries, norm.axes), k=5)
    dense = shape.to_vectors(norm.entries, norm.axes).select(F.posexplode(vector_to_array("features")).alias("gene", "x"))
    total = dense.groupBy("gene").agg(F.var_samp("x").alias("v")).agg(F.sum("v")).scalar()
    scores = result.components.select(F.posexplode(vector_to_array("components")).alias("component", "score"))
    shares = scores.groupBy("component").agg((F.var_samp("score") / total).alias("share")).join(result.explained, "component")
    return rounded(shares.select("component", (F.col("explained") - F.col("share")).alias("gap")))


@query
def to_sparse(spark: SparkSession, directory: str) -> DataFrame:
    norm = normalised(retail.counts(spark, directory))
    rows = shape.to_sparse(norm.entries, norm.axes).select("cell", "features.*")
    entries = F.explode_outer(F.arrays_zip("indices", "values")).alias("e")
    return rounded(rows.select("cell", "size", entries).select("cell", "size", F.col("e.indices").alias("position"), F.col("e.values").alias("value")))


@query
def kmeans_nearest(spark: SparkSession, directory: str) -> DataFrame:
    """Cells whose centre is not the nearest, and what the reported SSE lacks of the sum of squared distances."""
    result = cluster.kmeans(embedding_vectors(spark, directory).drop("prediction"), k=6)
    centers = [[float(v) for v in c] for c in result.model.clusterCenters()]
    point = vector_to_array("features")
    squares = F.array(
        *[
            F.aggregate(
                F.zip_with(point, F.array(*map(F.lit, c)), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v
            )
            for c in centers
        ]
    )
    each = result.predictions.select("cell", "prediction", squares.alias("d"))
    own = F.get("d", F.col("prediction"))
    found = each.agg(
        F.count(F.lit(1)).alias("cells"),
        F.count_if(own > F.array_min("d") + 1e-9).alias("misplaced"),
        F.sum(own).alias("sse"),
    )
    return rounded(found.select("cells", "misplaced", (F.col("sse") - F.lit(result.metrics[2])).alias("sse_gap")), 4)


@query
def sweep_bounds(spark: SparkSession, directory: str) -> DataFrame:
    """For each k of the sweep: SSE within that of one cluster, silhouette between -1 and 1."""
    vectors = embedding_vectors(spark, directory)
    values = vectors.select(F.posexplode(vector_to_array("features")).alias("i", "x"))
    whole = values.groupBy("i").agg((F.var_pop("x") * F.count("x")).alias("s")).agg(F.sum("s")).scalar()
    inside = (F.col("sse") > 0) & (F.col("sse") < whole) & F.col("silhouette").between(-1, 1)
    return cluster.kmeans_sweep(vectors).select("k", inside.alias("inside"))


@query
def sweep_against_fits(spark: SparkSession, directory: str) -> DataFrame:
    """For some k of the sweep: whether a single fit's SSE is reached within a hundredth, and what SSE and silhouette lack of
    those that the cells' assignment to the centres gives."""
    vectors = embedding_vectors(spark, directory).drop("prediction")
    rows = []
    for k, fit in cluster.sweep(vectors, (2, 6, 19)).items():
        cells = materialise(cluster.assigned(vectors, fit.centers))
        centers = F.array(*[F.array(*map(F.lit, map(float, c))) for c in fit.centers])
        squares = F.aggregate(
            F.zip_with(vector_to_array("features"), F.get(centers, F.col("prediction")), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v
        )
        sse = cells.agg(F.sum(squares)).first()[0]
        near = fit.sse <= 1.01 * cluster.kmeans(vectors, k).metrics[2]
        rows.append((k, near, fit.sse - sse, fit.silhouette - cluster.silhouette(cells)))
    return rounded(spark.createDataFrame(rows, "k int, sse_near boolean, sse_gap double, silhouette_gap double"))


@query
def vector_components(spark: SparkSession, directory: str) -> DataFrame:
    return rounded(reduce.components(embedding_vectors(spark, directory), 0, 1, 63, vector="features"))


@query
def prepare_features(spark: SparkSession, directory: str) -> DataFrame:
    customer = retail.table(spark, directory, "customer").select(
        F.col("c_custkey").alias("cell"), "c_mktsegment", "c_acctbal", "c_nationkey"
    )
    values = vector_to_array(F.col("features"))
    ready = cluster.prepare_features(customer).select("cell", values.alias("v"))
    return rounded(ready.select("cell", *[F.col("v")[i].alias(f"f{i}") for i in range(3)]))


@query
def kmeans_k6(spark: SparkSession, directory: str) -> DataFrame:
    result = cluster.kmeans(embedding_vectors(spark, directory).drop("prediction"), k=6)
    return result.predictions.agg(
        F.count_distinct("cell").alias("cells"),
        F.count_distinct("prediction").alias("clusters"),
        F.min("prediction").alias("first"),
        F.max("prediction").alias("last"),
    )


@query
def kmeans_sweep(spark: SparkSession, directory: str) -> DataFrame:
    return rounded(cluster.kmeans_sweep(embedding_vectors(spark, directory)))


@query
def silhouette_labels(spark: SparkSession, directory: str) -> DataFrame:
    vectors = embedding_vectors(spark, directory)
    cells = vectors.agg(F.count(F.lit(1)).alias("cells"))
    return rounded(cells.withColumn("silhouette", F.lit(cluster.silhouette(vectors))))


@query
def cluster_sizes(spark: SparkSession, directory: str) -> DataFrame:
    return cluster.cluster_sizes(embedding_vectors(spark, directory))


@query
def attach_metadata(spark: SparkSession, directory: str) -> DataFrame:
    counts = retail.counts(spark, directory)
    summary = qc.qc_cells(counts.entries, counts.axes).select("cell", "sum_of_all_entries")
    return cluster.attach(summary, retail.segments(spark, directory), "prediction")


# Neighbours


@query
def knn_exact(spark: SparkSession, directory: str) -> DataFrame:
    return rounded(neighbors.knn_graph(embedding_vectors(spark, directory), k=15), 5)


@query
def knn_approx(spark: SparkSession, directory: str) -> DataFrame:
    """Cells, edges, edges whose distance is wrong, and whether nine in ten of the true neighbours were found."""
    vectors = embedding_vectors(spark, directory)
    found, true = neighbors.knn_approx(vectors, k=15), neighbors.knn_graph(vectors, k=15)
    point = vector_to_array("features")
    here, there = (vectors.select(F.col("cell").alias(c), point.alias(f"{c}_point")) for c in ("cell", "neighbor"))
    squares = F.aggregate(F.zip_with("cell_point", "neighbor_point", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    wrong = found.join(here, "cell").join(there, "neighbor").agg(F.count_if(F.abs(F.sqrt(squares) - F.col("distance")) > 1e-9).alias("wrong"))
    hits = found.join(true.select("cell", "neighbor"), ["cell", "neighbor"]).agg(F.count(F.lit(1)).alias("hits"))
    sizes = found.agg(F.count_distinct("cell").alias("cells"), F.count(F.lit(1)).alias("edges"))
    total = true.agg(F.count(F.lit(1)).alias("total"))
    return sizes.select("cells", "edges", wrong.scalar().alias("wrong"), (hits.scalar() >= 0.9 * total.scalar()).alias("found"))


@query
def fuzzy_weights(spark: SparkSession, directory: str) -> DataFrame:
    knn = neighbors.knn_graph(embedding_vectors(spark, directory), k=15)
    return rounded(neighbors.fuzzy_weights(knn), 5)


@query
def fuzzy_graph(spark: SparkSession, directory: str) -> DataFrame:
    knn = neighbors.knn_graph(embedding_vectors(spark, directory), k=15)
    return rounded(neighbors.fuzzy_graph(knn), 5)


@query
def perplexity_affinities(spark: SparkSession, directory: str) -> DataFrame:
    knn = neighbors.knn_graph(embedding_vectors(spark, directory), k=90)
    return rounded(neighbors.conditional_affinities(knn, perplexity=30), 5)


@query
def perplexity_joint(spark: SparkSession, directory: str) -> DataFrame:
    knn = neighbors.knn_graph(embedding_vectors(spark, directory), k=90)
    joint = neighbors.perplexity_affinities(knn, perplexity=30)
    return rounded(joint.groupBy("cell").agg(F.sum("p").alias("p"), F.count(F.lit(1)).alias("edges")), 5)


# The whole chain


@query
def workflow(spark: SparkSession, directory: str) -> DataFrame:
    settings = Settings(apply_mito=False, n_genes=N_HVG, n_components=10, n_clusters=6)
    path = f"{scratch_dir(spark)}/workflow-{uuid.uuid4().hex}"
    results = run(spark, retail.counts(spark, directory), settings, path)
    genes = results["filtered"].agg(F.count_distinct("variable")).scalar()
    return results["predictions"].agg(
        F.count_distinct("cell").alias("cells"),
        F.max(genes).alias("genes"),
        F.count_distinct("prediction").alias("clusters"),
    )
