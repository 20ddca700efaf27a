from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallmat.operators import neighbors


def brute_force(points, k):
    """{cell: [(neighbor, distance)]} by comparing everything with everything."""
    names = [name for name, _ in points]
    x = np.array([p for _, p in points], dtype=float)
    result = {}
    for i, name in enumerate(names):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        others = sorted((round(d[j], 9), names[j]) for j in range(len(names)) if j != i)
        result[name] = others[:k]
    return result


def found(graph):
    result = {}
    for row in graph.orderBy("cell", "rank").collect():
        result.setdefault(row["cell"], []).append((round(row["distance"], 9), row["neighbor"]))
        assert row["rank"] == len(result[row["cell"]])
    return result


def frame(spark, points):
    return spark.createDataFrame([(name, [float(v) for v in p]) for name, p in points], "cell string, features array<double>")


@pytest.mark.parametrize("block", [8, 64, 2048])
def test_knn_equals_brute_force_for_any_block_size(spark, block):
    rng = np.random.default_rng(1)
    # Three clusters, far apart, so that most partitions are skipped.
    points = [(f"p{i:03d}", rng.normal(loc=40 * (i % 3), size=4)) for i in range(150)]
    assert found(neighbors.knn_graph(frame(spark, points), k=5, block=block)) == brute_force(points, 5)


def test_knn_sends_a_point_once_to_a_group_of_partitions(spark, monkeypatch):
    rng = np.random.default_rng(4)
    points = [(f"p{i:03d}", rng.normal(size=8)) for i in range(400)]
    written = []
    save = neighbors.materialise
    monkeypatch.setattr(neighbors, "materialise", lambda df: written.append(save(df)) or written[-1])
    assert found(neighbors.knn_graph(frame(spark, points), k=3, block=8)) == brute_force(points, 3)
    # No table before the graph, whose cells have three rows, holds a point more than once.
    assert max(df.count() for df in written[:-1]) <= 400
    monkeypatch.setattr(neighbors, "GROUP_BYTES", 8 * 8 * 40)
    assert found(neighbors.knn_graph(frame(spark, points), k=3, block=8)) == brute_force(points, 3)


def numbers(spark, points):
    return spark.createDataFrame([(name, [float(v) for v in p]) for name, p in points], "cell long, features array<double>")


def test_a_list_of_neighbours_leaves_the_search_once(spark, monkeypatch):
    """However many groups a point meets: the graph is written as it is found, without joining or ranking rows of groups."""
    rng = np.random.default_rng(6)
    points = [(i, rng.normal(size=8)) for i in range(400)]
    written = []
    save = neighbors.materialise
    monkeypatch.setattr(neighbors, "materialise", lambda df: written.append(df) or save(df))
    monkeypatch.setattr(neighbors, "GROUP_BYTES", 8 * 8 * 40)
    assert found(neighbors.knn_graph(numbers(spark, points), k=5, block=8)) == brute_force(points, 5)
    plan = written[-1]._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "MapInArrow" in plan


def test_copies_and_repeated_labels_among_numbered_cells(spark):
    rng = np.random.default_rng(7)
    points = [(i, rng.normal(size=3)) for i in range(200)]
    points += [(1000 + i, points[i % 3][1]) for i in range(7)]
    assert found(neighbors.knn_graph(numbers(spark, points), k=4, block=16)) == brute_force(points, 4)
    # A label of two points has a list of both.
    twice = [(0, (0, 0)), (0, (9, 9)), (1, (0, 1)), (2, (9, 7)), (3, (40, 40))]
    graph = {tuple(r) for r in neighbors.knn_graph(numbers(spark, twice), k=3).select("cell", "neighbor", "distance").collect()}
    assert {e for e in graph if e[0] == 0} == {(0, 1, 1.0), (0, 2, 2.0)}


@pytest.mark.parametrize("scale, shift", [(1.0, 0.0), (1e-25, 0.0), (1e18, 0.0), (1e-3, 1e6)])
def test_lists_equal_brute_force_where_single_precision_does_not_do(scale, shift):
    rng = np.random.default_rng(8)
    x = shift * rng.integers(0, 3, (300, 1)) + scale * rng.normal(size=(300, 5))
    lists = neighbors._Lists(np.arange(60), x[:60], np.full(60, np.inf), 7)
    for start in range(0, 300, 50):
        lists.meet(np.arange(start, start + 50), x[start : start + 50], np.ones(60, dtype=bool))
    rows = [(n, o) for b in lists.batches() for n, o in zip(b["number"].to_pylist(), b["others"].to_pylist())]
    for number, others in rows:
        d = np.sqrt(((x - x[number]) ** 2).sum(axis=1))
        assert others == [j for _, j in sorted((d[j], j) for j in range(300) if j != number)[:7]]
    assert len(rows) == 60


def test_edges_are_added_up_before_they_are_laid_out_both_ways(spark):
    rows = [(1, 2, 0.5), (2, 1, 0.25), (1, 3, 0.125), (3, 3, 1.0), (4, 1, 2.0), (4, 1, 2.0), (None, 5, 1.0), (5, None, 2.0)]
    both = neighbors._both_ways(spark.createDataFrame(rows, "cell long, neighbor long, p double"), "p")
    expected = {(1, 2, 0.5, 0.25), (2, 1, 0.25, 0.5), (1, 3, 0.125, 0.0), (3, 1, 0.0, 0.125), (3, 3, 1.0, 1.0)}
    expected |= {(4, 1, 4.0, 0.0), (1, 4, 0.0, 4.0), (None, 5, 1.0, 2.0), (5, None, 2.0, 1.0)}
    found_rows = [tuple(r) for r in both.collect()]
    assert len(found_rows) == len(expected) and set(found_rows) == expected
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate") < plan.index("Aggregate")


def test_knn_with_ties_on_a_grid(spark):
    points = [(f"g{x}{y}", (x, y)) for x in range(7) for y in range(7)]
    assert found(neighbors.knn_graph(frame(spark, points), k=6, block=8)) == brute_force(points, 6)


def test_knn_with_a_third_of_all_points_identical(spark):
    rng = np.random.default_rng(2)
    points = [(f"c{i:02d}", (1.0, 1.0)) for i in range(30)] + [(f"r{i:02d}", rng.normal(size=2)) for i in range(60)]
    assert found(neighbors.knn_graph(frame(spark, points), k=4, block=8)) == brute_force(points, 4)


def test_knn_with_fewer_points_than_neighbours(spark):
    points = [("a", (0, 0)), ("b", (3, 4)), ("c", (3, 4))]
    assert found(neighbors.knn_graph(frame(spark, points), k=15)) == brute_force(points, 15)
    assert neighbors.knn_graph(frame(spark, points).where("false"), k=3).count() == 0


@pytest.fixture(scope="module")
def knn(spark):
    rng = np.random.default_rng(3)
    points = [(f"p{i:03d}", rng.normal(size=3)) for i in range(80)]
    return neighbors.knn_graph(frame(spark, points), k=15).cache()


def test_fuzzy_weights_add_up_to_log2_k(knn):
    sums = neighbors.fuzzy_weights(knn).groupBy("cell").agg(F.sum("weight").alias("s"), F.max("weight").alias("m"))
    for row in sums.collect():
        assert row["s"] == pytest.approx(math.log2(15), abs=1e-6)
        assert row["m"] == 1.0


def test_fuzzy_graph_is_the_symmetric_union(knn):
    directed = {(r["cell"], r["neighbor"]): r["weight"] for r in neighbors.fuzzy_weights(knn).collect()}
    graph = {(r["cell"], r["neighbor"]): r["weight"] for r in neighbors.fuzzy_graph(knn).collect()}
    assert set(graph) == {key for a, b in directed for key in ((a, b), (b, a))}
    for (a, b), weight in graph.items():
        x, y = directed.get((a, b), 0.0), directed.get((b, a), 0.0)
        assert weight == pytest.approx(x + y - x * y)
        assert weight == pytest.approx(graph[b, a])


def test_affinities_have_the_perplexity(knn):
    p = neighbors.conditional_affinities(knn, perplexity=5)
    entropy = p.groupBy("cell").agg(F.sum("p").alias("s"), F.sum(-F.col("p") * F.log2("p")).alias("h"))
    for row in entropy.collect():
        assert row["s"] == pytest.approx(1.0)
        assert 2 ** row["h"] == pytest.approx(5.0, abs=1e-6)
    joint = neighbors.perplexity_affinities(knn, perplexity=5).agg(F.sum("p")).first()[0]
    assert joint == pytest.approx(1.0)


def test_lists_of_different_length_are_weighted_separately(spark):
    rows = [("a", "b", 1.0, 1), ("a", "c", 2.0, 2), ("a", "d", 3.0, 3), ("b", "a", 1.0, 1), ("b", "c", 4.0, 2)]
    knn = spark.createDataFrame(rows, "cell string, neighbor string, distance double, rank int")
    sums = {r["cell"]: r["s"] for r in neighbors.fuzzy_weights(knn).groupBy("cell").agg(F.sum("weight").alias("s")).collect()}
    assert sums["a"] == pytest.approx(math.log2(3), abs=1e-6)
    assert sums["b"] == pytest.approx(1.0, abs=1e-6)
