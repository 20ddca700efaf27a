"""Hand-checked values on a 6 x 5 matrix, dense and sparse."""

from __future__ import annotations

import pytest
from conftest import table
from pyspark.sql import functions as F

from tallmat.operators import de, hvg, normalize, qc, shape
from tallmat.operators.axes import Axes


@pytest.fixture(params=["dense", "sparse"])
def matrix(request, dense, sparse, axes):
    """(tall, axes) in both forms."""
    return (dense, None) if request.param == "dense" else (sparse, axes)


def test_qc_cells(matrix):
    got = table(qc.qc_cells(*matrix), "cell")
    names = [
        "sum_of_all_entries", "average_of_sum", "total_number_of_columns", "total_number_of_ERCC_entry", "sum_of_ercc",
        "total_number_of_MT_entry", "sum_of_mt", "percentage_of_ercc", "percentage_of_mt",
        "log1p_of_sum_of_all_entries", "log1p_of_sum_of_ercc", "log1p_of_sum_of_mt",
    ]
    expected = {
        "c1": [8, 1.6, 3, 1, 2, 1, 1, 25, 12.5, 2.197225, 1.098612, 0.693147],
        "c2": [8, 1.6, 3, 0, 0, 1, 4, 0, 50, 2.197225, 0, 1.609438],
        "c3": [10, 2, 4, 1, 1, 2, 7, 10, 70, 2.397895, 0.693147, 2.079442],
        "c4": [11, 2.2, 3, 0, 0, 1, 1, 0, 9.090909, 2.484907, 0, 0.693147],
        "c5": [12, 2.4, 3, 0, 0, 2, 11, 0, 91.666667, 2.564949, 0, 2.484907],
        "c6": [0, 0, 0, 0, 0, 0, 0, None, None, 0, 0, 0],
    }
    assert got == {cell: dict(zip(names, values)) for cell, values in expected.items()}


def test_prefix_match_leaves_out_false_positives(matrix):
    got = table(qc.qc_cells(*matrix, match="prefix").select("cell", "sum_of_mt"), "cell")
    assert got["c5"]["sum_of_mt"] == 2


def test_qc_genes(matrix):
    got = table(qc.qc_genes(*matrix), "gene_name")
    names = [
        "no_cells_by_counts", "sum_of_cells", "mean_counts", "no_of_dropouts", "pct_dropout_by_counts",
        "log1p_of_mean_counts", "log1p_total_counts",
    ]
    expected = {
        "AMT3": [3, 17, 2.833333, 3, 50, 1.343735, 2.890372],
        "ERCC-1": [2, 3, 0.5, 4, 66.666667, 0.405465, 1.386294],
        "G1": [4, 17, 2.833333, 2, 33.333333, 1.343735, 2.890372],
        "G2": [3, 5, 0.833333, 3, 50, 0.606136, 1.791759],
        "MT-1": [4, 7, 1.166667, 2, 33.333333, 0.77319, 2.079442],
    }
    assert got == {gene: dict(zip(names, values)) for gene, values in expected.items()}


def test_filter(matrix):
    tall, axes = matrix
    cells, genes = qc.qc_cells(tall, axes), qc.qc_genes(tall, axes)

    def kept(df, column="cell"):
        return {row[0] for row in df.select(column).distinct().collect()}

    loose = qc.Thresholds(min_genes=1, min_counts=1, min_cells=1)
    assert kept(qc.filter_matrix(tall, cells)) == set()
    assert kept(qc.filter_matrix(tall, cells, limits=loose)) == {"c2", "c4", "c5"}
    assert kept(qc.filter_matrix(tall, cells, apply_ercc=False, limits=loose)) == {"c1", "c2", "c3", "c4", "c5"}
    assert kept(qc.filter_matrix(tall, cells, apply_mito=True, limits=loose)) == set()
    assert kept(qc.filter_matrix(tall, None, genes), "variable") == set()
    assert kept(qc.filter_matrix(tall, None, genes, limits=loose), "variable") == {"G1", "G2", "ERCC-1", "MT-1", "AMT3"}
    dropout = qc.Thresholds(max_dropout_percent=50, min_cells=1)
    assert kept(qc.filter_matrix(tall, None, genes, limits=dropout), "variable") == {"G1", "G2", "MT-1", "AMT3"}
    assert qc.filter_matrix(tall).count() == tall.count()
    report = table(qc.removal_report(cells, genes, limits=loose), "axis")
    assert report == {"cells": {"removed": 3, "total": 6}, "genes": {"removed": 0, "total": 5}}


def test_norm_global(dense, sparse, axes):
    got = table(shape.to_wide(normalize.norm_global(dense)), "cell")
    assert got["c1"] == {"G1": 8.740497, "G2": 0, "ERCC-1": 7.824446, "MT-1": 7.131699, "AMT3": 0}
    assert got["c5"] == {"G1": 6.726633, "G2": 0, "ERCC-1": 0, "MT-1": 7.419181, "AMT3": 8.922792}
    assert set(got["c6"].values()) == {None}
    kept = normalize.defined_axes(sparse, axes)
    wide = table(shape.to_wide(normalize.norm_global(sparse), axes=kept), "cell")
    assert wide == {cell: values for cell, values in got.items() if cell != "c6"}


def test_norm_quantile(matrix):
    got = table(shape.to_wide(normalize.norm_quantile(*matrix)), "cell")
    expected = {
        "c1": (3.25, 0, 0.5, 0), "c2": (2.25, 2.25, 0, 2.25), "c3": (0, 3.25, 5.5, 2.25),
        "c4": (5.5, 3.25, 0.5, 0), "c5": (0.5, 0, 3.25, 5.5), "c6": (0, 0, 0, 0),
    }
    assert got == {cell: dict(zip(("G1", "G2", "MT-1", "AMT3"), values)) for cell, values in expected.items()}


def test_hvg_stats(dense, sparse, axes):
    expected = {
        "MT-1": (5.874225, 3.313021, 10.976105, 0.563993, 0.318088, 7.131699, 0.318154),
        "G1": (6.517786, 3.742777, 14.008379, 0.574241, 0.329752, 8.229778, 0.662246),
        "G2": (4.447849, 4.064106, 16.516956, 0.913724, 0.834891, 7.131699, 0.469704),
        "AMT3": (5.146897, 4.703851, 22.126216, 0.91392, 0.835249, 8.2943, 0.628492),
        "ERCC-1": (2.94664, 4.047821, 16.384852, 1.373707, 1.887071, 0, 0),
    }
    names = ("mean", "sd", "var", "co_var", "CV2", "median", "MAD")
    expected = {gene: dict(zip(names, values)) for gene, values in expected.items()}
    assert table(hvg.hvg_stats(normalize.norm_global(dense)), "variable") == expected
    kept = normalize.defined_axes(sparse, axes)
    assert table(hvg.hvg_stats(normalize.norm_global(sparse), kept), "variable") == expected


def test_hvg_selection_in_both_directions(dense):
    norm = normalize.norm_global(dense)

    def names(df):
        return [row["variable"] for row in df.orderBy("rank").collect()]

    assert names(hvg.hvg_cv2(norm, 2)) == ["ERCC-1", "AMT3"]
    assert names(hvg.hvg_cv2(norm, 2, "asc")) == ["MT-1", "G1"]
    above = {row["variable"] for row in hvg.hvg_mad(norm, 0.5).collect()}
    below = {row["variable"] for row in hvg.hvg_mad(norm, 0.5, "at_or_below").collect()}
    assert (above, below) == ({"G1", "AMT3"}, {"G2", "MT-1", "ERCC-1"})
    chosen = hvg.select_genes(norm, hvg.hvg_cv2(norm, 2))
    assert chosen.count() == 12
    with pytest.raises(ValueError):
        hvg.hvg_cv2(norm, 2, "up")
    with pytest.raises(ValueError):
        hvg.hvg_mad(norm, 1, "below")


def labelled(matrix, labels):
    tall, axes = matrix
    return de.label_cells(tall, labels), axes and Axes(de.label_cells(axes.cells, labels), axes.genes)


def test_two_group_stats(matrix, labels):
    tall, axes = labelled(matrix, labels)
    got = table(de.two_group_stats(tall, 0, axes), "variable")
    names = ("in_size", "out_size", "in_mean", "out_mean", "in_sd", "out_sd", "df", "sdp", "t_test", "p_val")
    expected = {
        "G1": (3, 3, 5.333333, 0.333333, 2.516611, 0.57735, 4, 1.825742, 3.354102, 0.02846),
        "MT-1": (3, 3, 0.666667, 1.666667, 0.57735, 1.527525, 4, 1.154701, -1.06066, 0.348641),
        "AMT3": (3, 3, 1.333333, 4.333333, 2.309401, 4.50925, 4, 3.582364, -1.025645, 0.363032),
        "ERCC-1": (3, 3, 0.666667, 0.333333, 1.154701, 0.57735, 4, 0.912871, 0.447214, 0.677869),
        "G2": (3, 3, 1, 0.666667, 1, 1.154701, 4, 1.080123, 0.377964, 0.724659),
    }
    assert got == {gene: dict(zip(names, values)) for gene, values in expected.items()}
    top = de.diff_expr_top_n(tall, 0, 10, axes=axes)
    assert de.gene_dict(top) == {"G1": pytest.approx(0.0284602)}


def test_one_pass_equals_one_test_per_cluster(matrix, labels):
    tall, axes = labelled(matrix, labels)
    every = table(de.one_vs_rest_stats(tall, axes), "prediction", "variable")
    for cluster_id in (0, 1):
        single = table(de.two_group_stats(tall, cluster_id, axes), "variable")
        assert single == {gene: values for (cluster, gene), values in every.items() if cluster == cluster_id}
    ranks = de.diff_expr_all(tall, n=2, alpha=1.0, axes=axes)
    assert ranks.count() == 4 and ranks.agg(F.max("rank")).first()[0] == 2


def test_vectors_are_the_wide_rows(matrix):
    tall, axes = matrix
    wide = table(shape.to_wide(tall, value="value", axes=axes), "cell")
    vectors = shape.to_vectors(tall, axes, value="value").collect()
    assert {row["cell"]: list(row["features"]) for row in vectors} == {
        cell: [float(values[g]) for g in sorted(values)] for cell, values in wide.items()
    }
    assert len(vectors) == 6


def test_norm_global_of_many_cells_joins_without_a_sort(dense, monkeypatch):
    few = sorted(map(tuple, normalize.norm_global(dense).collect()), key=repr)
    monkeypatch.setattr(normalize, "MANY_CELLS", 1, raising=False)
    norm = normalize.norm_global(dense)
    assert sorted(map(tuple, norm.collect()), key=repr) == few
    assert "SortMergeJoin" not in norm._jdf.queryExecution().sparkPlan().toString() and "ShuffledHashJoin" in norm._jdf.queryExecution().sparkPlan().toString()
