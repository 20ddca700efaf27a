"""NULLs, zero divisors, repeated labels, single groups and skewed groups."""

from __future__ import annotations

import math
import random
import re
import statistics

import pytest
from conftest import TALL, table
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tallmat.operators import cluster, de, hvg, normalize, qc, ranks, reduce, shape
from tallmat.operators.axes import Axes

NORM = "cell string, variable string, norm_value double"


def test_null_and_negative_values_count_as_neither_expressed_nor_dropout(spark):
    tall = spark.createDataFrame([("a", "G", None), ("a", "H", -2), ("a", "K", 0), ("b", "G", 3)], TALL)
    genes = table(qc.qc_genes(tall), "gene_name")
    assert genes["H"]["no_cells_by_counts"] == genes["H"]["no_of_dropouts"] == 0
    assert genes["H"]["pct_dropout_by_counts"] is None
    assert genes["G"] | {} == genes["G"] and genes["G"]["mean_counts"] == 3 and genes["G"]["no_cells_by_counts"] == 1
    cells = table(qc.qc_cells(tall), "cell")
    assert cells["a"]["sum_of_all_entries"] == -2 and cells["a"]["average_of_sum"] == -1
    # log1p is undefined at -2, and the NULL percentage of a gene removes nothing by itself.
    assert cells["a"]["log1p_of_sum_of_all_entries"] is None
    kept = qc.kept_genes(qc.qc_genes(tall), qc.Thresholds(min_cells=0)).collect()
    assert {row[0] for row in kept} == {"G", "H"}


def test_repeated_labels_are_merged_alike_in_both_forms(spark):
    rows = [("a", "G", 1), ("a", "H", 0), ("a", "G", 0), ("a", "H", 4), ("b", "G", 0), ("b", "H", 2)]
    dense = spark.createDataFrame(rows, TALL)
    axes = Axes(
        spark.createDataFrame([("a", 2), ("b", 1)], "cell string, copies bigint"),
        spark.createDataFrame([("G", 1), ("H", 1)], "variable string, copies bigint"),
    )
    sparse = shape.sparsify(dense)
    assert table(qc.qc_cells(dense), "cell") == table(qc.qc_cells(sparse, axes), "cell")
    assert table(qc.qc_genes(dense), "gene_name") == table(qc.qc_genes(sparse, axes), "gene_name")
    assert table(hvg.gene_moments(dense, None, "value"), "variable") == table(
        hvg.gene_moments(sparse, axes, "value"), "variable"
    )
    assert table(hvg.gene_mad(dense, None, "value"), "variable") == table(hvg.gene_mad(sparse, axes, "value"), "variable")
    # The pivot keeps the maximum.
    assert table(shape.to_wide(dense, value="value"), "cell")["a"] == {"G": 1, "H": 4}


def test_more_entries_than_the_axes_allow_fail(spark):
    tall = spark.createDataFrame([("a", "G", 1), ("a", "G", 2), ("a", "G", 3)], TALL)
    axes = Axes.of(tall)
    with pytest.raises(PySparkException, match="more entries"):
        qc.qc_cells(tall, axes).collect()
    with pytest.raises(PySparkException, match="more entries"):
        hvg.gene_moments(tall, axes, "value").collect()


def test_gene_with_mean_zero_has_no_cv2(spark):
    norm = spark.createDataFrame([("a", "Z", 0.0), ("b", "Z", 0.0), ("a", "G", 1.0), ("b", "G", 3.0)], NORM)
    assert [r["variable"] for r in hvg.hvg_cv2(norm, 1, "desc").collect()] == ["G"]
    assert [r["variable"] for r in hvg.hvg_cv2(norm, 1, "asc").collect()] == ["Z"]
    single = spark.createDataFrame([("a", "G", 2.0)], NORM)
    assert hvg.gene_moments(single).first()["var"] is None


def test_gene_without_values_has_no_mad_and_is_not_above(spark):
    norm = spark.createDataFrame([("a", "N", None), ("b", "N", None), ("a", "G", 1.0), ("b", "G", 3.0)], NORM)
    assert table(hvg.gene_mad(norm), "variable") == {"N": {"median": None, "MAD": None}, "G": {"median": 2, "MAD": 1}}
    assert [r["variable"] for r in hvg.hvg_mad(norm, 0.5).collect()] == ["G"]
    assert [r["variable"] for r in hvg.hvg_mad(norm, 0.5, "at_or_below").collect()] == ["N"]


def test_nulls_take_part_in_quantile_ranks(spark):
    rows = [("a", "G", None), ("b", "G", 4), ("c", "G", 6), ("a", "H", 1), ("b", "H", 2), ("c", "H", 9)]
    got = table(normalize.norm_quantile(spark.createDataFrame(rows, TALL)), "cell", "variable")
    # Position 1 holds NULL and 1, position 2 holds 4 and 2, position 3 holds 6 and 9.
    expected = {"a": (1.0, 1.0), "b": (3.0, 3.0), "c": (7.5, 7.5)}
    assert got == {(c, g): {"norm_value": v} for c, vs in expected.items() for g, v in zip("GH", vs)}


def quantile_by_sorting(rows, by):
    groups = {}
    for cell, gene, value in rows:
        groups.setdefault(gene if by == "gene" else cell, []).append(value)
    columns = {}
    for values in groups.values():
        for i, v in enumerate(sorted(values)):
            columns.setdefault(i, []).append(v)
    means = {i: statistics.fmean(vs) for i, vs in columns.items()}
    return {
        (c, g): {"norm_value": round(means[sorted(groups[g if by == "gene" else c]).index(v)], 6)} for c, g, v in rows
    }


@pytest.mark.parametrize("by", ["gene", "cell"])
def test_quantile_equals_sorting_on_ragged_skewed_groups(spark, by):
    rng = random.Random(5)
    # G0 holds a third of all rows; values are negative, zero, fractional and huge.
    genes = ["G0"] * 40 + [f"G{i}" for i in range(1, 9) for _ in range(10)]
    seen, rows = {}, []
    for gene in genes:
        seen[gene] = seen.get(gene, 0) + 1
        rows.append((f"c{seen[gene]:02d}", gene, rng.choice([0.0, -1.5, 2.25, 1e9, rng.random(), rng.randint(0, 9)])))
    rows = [(c, g, float(v)) for c, g, v in rows]
    tall = spark.createDataFrame(rows, "cell string, variable string, value double")
    assert table(normalize.norm_quantile(tall, by=by), "cell", "variable") == quantile_by_sorting(rows, by)


@pytest.mark.parametrize("sparse", [False, True])
def test_grouped_median_equals_sorting(spark, sparse):
    rng = random.Random(7)
    groups = {}
    for i in range(30):
        n = rng.choice([1, 2, 3, 10, 41])
        share = rng.choice([0.0, 0.3, 0.5, 0.9])
        pool = [rng.uniform(-2, 2), 1.0, 1.0000001, rng.uniform(0, 1e-9), -5.0]
        groups[f"g{i}"] = [0.0 if rng.random() < share else rng.choice(pool) for _ in range(n)]
    rows = [(g, v) for g, values in groups.items() for v in values if v != 0 or not sparse]
    stored = spark.createDataFrame(rows, "variable string, value double")
    zeros = None
    if sparse:
        zeros = spark.createDataFrame([(g, len(v)) for g, v in groups.items()], "variable string, population bigint")
    got = {r["variable"]: r["median"] for r in ranks.grouped_median(stored, "variable", zeros).collect()}
    assert got == {g: pytest.approx(statistics.median(v)) for g, v in groups.items()}


def test_median_of_close_and_non_finite_values(spark):
    inf, nan = float("inf"), float("nan")
    groups = {
        "narrow": [1000 + i * 0.005 for i in range(1001)],
        "nan": [0.5, 2.0, 3.0, nan, nan],
        "infinite": [-inf, -inf, 1.0, inf],
        "mixed": [inf, 2.0, -inf],
    }
    rows = [(g, v) for g, values in groups.items() for v in values]
    df = spark.createDataFrame(rows, "variable string, value double")
    got = {r["variable"]: r["median"] for r in ranks.grouped_median(df, "variable").collect()}
    plain = {r["variable"]: r["m"] for r in df.groupBy("variable").agg(F.median("value").alias("m")).collect()}
    assert got == plain and got["nan"] == 3.0
    values = ranks.distinct_values(df.select("variable", "value", F.lit(1).alias("n")), "variable")
    before = {(r["variable"], repr(r["value"])): r["before"] for r in ranks.counts_before(values, "variable").collect()}
    assert before["narrow", "1002.5"] == 500 and before["nan", "nan"] == 3 and before["infinite", "1.0"] == 2


def test_sums_of_covering_runs(spark):
    rng = random.Random(4)
    runs = [(rng.randrange(200), rng.randrange(1, 90), rng.choice([1e16, 0.1, 3.0])) for _ in range(300)]
    df = spark.createDataFrame(runs, "start bigint, n bigint, x double")
    got = {r["position"]: r["x"] for r in ranks.covering_sums(df, "x").collect()}
    for p in {s for s, _, _ in runs}:
        assert got[p] == pytest.approx(sum(x for s, n, x in runs if s <= p < s + n), rel=1e-12)


def test_small_groups_keep_their_digits_beside_huge_ones(spark):
    rows = [(f"c{i}", "BIG", 1e16) for i in range(3)] + [(f"c{i}", "SMALL", i / 10) for i in range(1, 9)]
    tall = spark.createDataFrame(rows, "cell string, variable string, value double")
    small = {r["cell"]: r["norm_value"] for r in normalize.norm_quantile(tall).where("variable = 'SMALL'").collect()}
    assert [small[f"c{i}"] for i in range(4, 9)] == [0.4, 0.5, 0.6, 0.7, 0.8]


def test_many_clusters_equal_single_tests(spark):
    rng = random.Random(6)
    rows = [(f"c{i}", f"g{j}", rng.randrange(9)) for i in range(60) for j in range(3)]
    tall = spark.createDataFrame(rows, TALL)
    labels = spark.createDataFrame([(f"c{i}", i % 12 if i % 13 else None) for i in range(60)], "cell string, prediction int")
    labelled = de.label_cells(tall, labels)
    every = table(de.one_vs_rest_stats(labelled), "prediction", "variable")
    for cluster_id in (0, 5, 11):
        for gene, stats in table(de.two_group_stats(labelled, cluster_id), "variable").items():
            assert every[cluster_id, gene] == pytest.approx(stats)


def test_de_with_everything_in_or_out_of_the_cluster(spark, dense, labels):
    tall = de.label_cells(dense, labels.withColumn("prediction", F.lit(0)))
    inside = de.two_group_stats(tall, 0)
    assert inside.where("p_val IS NOT NULL OR out_size <> 0").count() == 0 and inside.count() == 5
    assert de.diff_expr_top_n(tall, 0).count() == 0
    assert de.two_group_stats(tall, 3).count() == 0
    assert de.diff_expr_top_n(tall, 3).count() == 0


def test_constant_genes_have_no_p_value(spark):
    rows = [(f"c{i}", "flat", 1 if i < 3 else 2) for i in range(6)] + [(f"c{i}", "one", i) for i in range(2)]
    tall = spark.createDataFrame(rows, TALL)
    labels = spark.createDataFrame([(f"c{i}", i // 2) for i in range(6)], "cell string, prediction int")
    stats = table(de.one_vs_rest_stats(de.label_cells(tall, labels)), "prediction", "variable")
    assert stats[0, "one"]["p_val"] is None and stats[0, "one"]["out_size"] == 0
    two = labels.withColumn("prediction", F.when(F.col("cell") < "c3", 0).otherwise(1))
    flat = table(de.two_group_stats(de.label_cells(tall, two), 0), "variable")["flat"]
    assert flat["sdp"] == 0 and flat["t_test"] is None and flat["p_val"] is None


def test_unlabelled_cells_are_outside_unless_dropped(dense, labels):
    tall = de.label_cells(dense, labels.where("cell <> 'c6'"))
    assert table(de.two_group_stats(tall, 0), "variable")["G1"]["out_size"] == 3
    assert table(de.two_group_stats(tall, 0, drop_unlabelled=True), "variable")["G1"]["out_size"] == 2
    assert {r[0] for r in de.one_vs_rest_stats(tall).select("prediction").distinct().collect()} == {0, 1}


def test_swapping_the_groups_flips_t_but_not_p(dense, labels):
    tall = de.label_cells(dense, labels)
    a, b = (table(de.two_group_stats(tall, i), "variable") for i in (0, 1))
    for gene in a:
        assert a[gene]["t_test"] == -b[gene]["t_test"] and a[gene]["p_val"] == b[gene]["p_val"]


@pytest.mark.parametrize("t, df, p", [(2.5, 20, 0.0212335454), (2.5, 21, 0.0207782639), (4.0, 498, 7.2956460e-05)])
def test_p_values(spark, t, df, p):
    from tallmat.functions.stats import two_tailed_p

    got = spark.range(1).select(two_tailed_p(F.lit(t), F.lit(df)).alias("p")).first()["p"]
    assert got == pytest.approx(p, rel=1e-7)


def test_tiny_p_values_do_not_vanish(spark):
    from tallmat.functions.stats import two_tailed_p

    got = spark.range(1).select(two_tailed_p(F.lit(60.0), F.lit(498)).alias("p")).first()["p"]
    assert 0 < got < 1e-200


def test_vectors_refuse_nulls_and_gaps(spark):
    rows = [("a", "G", 1.0), ("a", "H", None), ("b", "G", 1.0), ("b", "H", 2.0)]
    tall = spark.createDataFrame(rows, NORM)
    with pytest.raises(PySparkException):
        shape.to_vectors(tall).collect()
    filled = {r["cell"]: list(r["features"]) for r in shape.to_vectors(tall, impute=0.0).collect()}
    assert filled == {"a": [1.0, 0.0], "b": [1.0, 2.0]}
    with pytest.raises(PySparkException):
        shape.to_vectors(tall.where("cell <> 'a' OR variable = 'G'")).collect()


def test_missing_columns_are_named(dense):
    with pytest.raises(ValueError, match="value"):
        qc.qc_cells(dense.drop("value"))


def test_histogram(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (5.0,), (10.0,), (None,)], "x double")
    got = table(qc.histogram_bins(df, "x", 5), "bin")
    assert [got[i]["n"] for i in range(1, 6)] == [2, 0, 1, 0, 1]
    assert (got[1]["lower"], got[5]["upper"]) == (0, 10)
    flat = table(qc.histogram_bins(df.where("x = 1"), "x", 4), "bin")
    assert (flat[1]["lower"], flat[4]["upper"], sum(b["n"] for b in flat.values())) == (0.5, 1.5, 1)


def test_prepare_features_mixes_strings_numbers_and_vectors(spark):
    from pyspark.ml.linalg import Vectors

    rows = [("a", "x", 1.0, Vectors.dense(7.0, 8.0)), ("b", "y", 2.0, Vectors.dense(9.0, 0.0)), ("c", "x", 3.0, Vectors.dense(1.0, 1.0))]
    df = spark.createDataFrame(rows, ["cell", "kind", "n", "v"])
    got = {r["cell"]: r["features"].toArray().tolist() for r in cluster.prepare_features(df).collect()}
    assert got == {"a": [1, 7, 8, 0], "b": [2, 9, 0, 1], "c": [3, 1, 1, 0]}


@pytest.fixture(scope="module")
def blobs(spark):
    from pyspark.ml.linalg import Vectors

    rng = random.Random(3)
    rows = [(f"p{i}", Vectors.dense([rng.gauss(20 * (i % 3), 1), rng.gauss(0, 1), rng.gauss(0, 0.1)])) for i in range(90)]
    return spark.createDataFrame(rows, ["cell", "features"]).cache()


def test_kmeans_and_sweep(blobs):
    result = cluster.kmeans(blobs, 3, with_silhouette=True, prediction_col="group")
    assert result.metrics[0] == 3 and result.metrics[1] > 0.9
    sizes = cluster.cluster_sizes(result.predictions, "group").collect()
    assert [tuple(r) for r in sizes] == [(0, 30), (1, 30), (2, 30)]
    assert cluster.kmeans(blobs, 3).metrics[1] == 0.0
    sweep = [tuple(r) for r in cluster.kmeans_sweep(blobs, range(2, 5)).orderBy("k").collect()]
    assert [k for k, _, _ in sweep] == [2, 3, 4]
    assert sweep[0][2] > sweep[1][2] > sweep[2][2]


def test_pca_keeps_the_variance_and_fixes_the_sign(blobs):
    result = reduce.pca(blobs, 3)
    explained = [tuple(r) for r in result.explained.orderBy("component").collect()]
    assert explained[0][1] > 0.95 and explained[2][2] == pytest.approx(1.0)
    plane = reduce.coordinates(result.components)
    assert plane.columns == ["cell", "x", "y"]
    x = {r["cell"]: r["x"] for r in plane.collect()}
    # The first axis is the direction of the blobs, pointing up.
    assert x["p2"] > x["p1"] > x["p0"]
    spread = reduce.components(result.components, 0, 1, 2).agg(*[F.var_samp(f"c{i}") for i in range(3)]).first()
    dims = [statistics.variance(r["features"][i] for r in blobs.collect()) for i in range(3)]
    assert math.isclose(sum(spread), sum(dims))


def test_norm_quantile_by_cell_looks_up_stored_entries_only(spark):
    """Repeated pairs, NULLs, negative values, a cell without entries and one without zeros; no dense row is joined by value."""
    rows = [("a", "x", 3), ("a", "x", 5), ("a", "y", None), ("b", "x", -2), ("b", "y", 7), ("b", "z", 7), ("b", "w", 1), ("c", "w", 4)]
    tall = spark.createDataFrame(rows, TALL)
    axes = Axes(
        spark.createDataFrame([("a", 2), ("b", 1), ("c", 1), ("d", 1)], "cell string, copies bigint"),
        spark.createDataFrame([(g, 1) for g in "wxyz"], "variable string, copies bigint"),
    )
    found = normalize.norm_quantile(tall, axes, by="cell")
    lookup, *_ = normalize._quantile_lookup(tall, axes, "cell", ())
    same = (F.col("cell") == F.col("_group")) & F.col("value").cast("double").eqNullSafe(F.col("_value"))
    dense = shape.densify(tall, axes).join(lookup, same, "left").select("cell", "variable", "norm_value")
    assert table(found, "cell", "variable") == table(dense, "cell", "variable")
    assert found.count() == 16
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < re.search(r"\b_value#", plan).start()
    places = normalize.norm_quantile(tall, axes, by="cell", places=1)
    rounded = found.withColumn("norm_value", F.round("norm_value", 1) + F.lit(0.0))
    assert table(places, "cell", "variable") == table(rounded, "cell", "variable")
