"""Approximate neighbours: recall, exact small tables, copies, metrics and odd input."""

from __future__ import annotations

import numpy as np
import pytest

from tallmat.operators import neighbors

POINTS = "cell long, features array<double>"


def graph(df):
    return {(r["cell"], r["neighbor"]): (r["distance"], r["rank"]) for r in df.collect()}


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], POINTS)


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(40, 10))[rng.integers(0, 40, 2500)] * 3 + rng.normal(size=(2500, 10))
    x[100:140] = x[100]
    return x, frame(spark, x).repartition(5).persist()


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_recall_and_distances(clustered, metric):
    x, df = clustered
    found, true = graph(neighbors.knn_approx(df, 10, metric=metric)), graph(neighbors.knn_graph(df, 10, metric=metric))
    assert len(found) == len(true) == 25_000
    assert len(found.keys() & true.keys()) > 0.95 * len(true)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    for (a, b), (distance, _) in list(found.items())[::97]:
        right = np.linalg.norm(x[a] - x[b]) if metric == "euclidean" else 1 - unit[a] @ unit[b]
        assert distance == pytest.approx(right, abs=1e-9)
    ranks = {}
    for (a, _), (distance, rank) in found.items():
        ranks.setdefault(a, []).append((rank, distance))
    for rows in ranks.values():
        rows.sort()
        assert [r for r, _ in rows] == list(range(1, 11)) and all(p[1] <= q[1] + 1e-12 for p, q in zip(rows, rows[1:], strict=False))


def test_copies_are_neighbours_at_distance_zero(clustered):
    _, df = clustered
    found = graph(neighbors.knn_approx(df, 10))
    assert all(d == 0 for (a, _), (d, _) in found.items() if 100 <= a < 140)


def test_descent_improves_the_first_lists(clustered):
    x, df = clustered
    true = graph(neighbors.knn_graph(df, 10)).keys()
    first, later = (len(graph(neighbors.knn_approx(df, 10, rounds=r)).keys() & true) for r in (0, 4))
    assert later > first


def test_small_tables_are_exact(spark):
    rng = np.random.default_rng(8)
    for n in (1, 2, 30):
        df = frame(spark, rng.normal(size=(n, 3)))
        assert graph(neighbors.knn_approx(df, 5)) == graph(neighbors.knn_graph(df, 5))
    assert neighbors.knn_approx(frame(spark, np.empty((0, 2))).limit(0), 3).count() == 0


def test_a_null_coordinate_fails(spark):
    df = spark.createDataFrame([(1, [1.0, None]), (2, [1.0, 2.0])], POINTS)
    with pytest.raises(Exception, match="not finite"):
        neighbors.knn_approx(df, 1).collect()
