"""Principal components from dense and sparse rows, convergence, and sums on two levels."""

from __future__ import annotations

import warnings

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tallmat.operators import reduce, shape
from tallmat.operators.axes import Axes


def exact(x, k):
    sizes, turn = np.linalg.eigh(np.cov(x.T))
    turn = turn[:, ::-1][:, :k]
    turn = turn * np.where(turn[np.abs(turn).argmax(axis=0), np.arange(k)] < 0, -1.0, 1.0)
    return turn, sizes[::-1][:k] / sizes.sum()


def matrix(seed=1, cells=80, genes=30):
    rng = np.random.default_rng(seed)
    factors = rng.normal(size=(cells, 4)) @ (rng.normal(size=(4, genes)) * np.array([[8.0], [4.0], [2.0], [1.0]]))
    x = np.round(np.where(rng.random((cells, genes)) < 0.3, 5 + factors + rng.normal(size=(cells, genes)), 0.0), 6)
    x[3], x[:, 7] = 0.0, 0.0
    return x


@pytest.fixture(scope="module")
def forms(spark):
    x = matrix()
    rows = [(f"c{i:03}", f"g{j:03}", float(v)) for i, r in enumerate(x) for j, v in enumerate(r)]
    tall = spark.createDataFrame(rows, "cell string, variable string, norm_value double")
    axes = Axes.of(tall)
    return x, shape.to_vectors(tall), shape.to_sparse(shape.sparsify(tall, "norm_value"), axes)


def scores(result):
    rows = result.components.select("cell", vector_to_array("components").alias("c")).orderBy("cell").collect()
    return np.array([r["c"] for r in rows])


def test_sparse_rows_hold_the_stored_entries(forms):
    x, _, sparse = forms
    for r in sparse.collect():
        row = x[int(r["cell"][1:])]
        assert r["features"]["size"] == 30 and r["features"]["indices"] == np.flatnonzero(row).tolist()
        assert r["features"]["values"] == row[row != 0].tolist()


@pytest.mark.parametrize("k", [1, 4, 30])
def test_sparse_components_equal_dense_and_exact_ones(forms, k):
    x, dense, sparse = forms
    turn, shares = exact(x, k)
    for rows in (dense, sparse):
        result = reduce.pca(rows, k=k)
        assert result.convergence.converged and result.convergence.residual <= 1e-8
        leading = min(k, 4)
        assert np.allclose(result.loadings[:, :leading], turn[:, :leading], atol=1e-6)
        assert np.allclose([r["explained"] for r in result.explained.orderBy("component").collect()], shares, atol=1e-9)
        assert np.allclose(scores(result)[:, :leading], x @ turn[:, :leading], atol=1e-5)
    a, b = reduce.pca(dense, k=4), reduce.pca(sparse, k=4)
    assert np.allclose(scores(a), scores(b), atol=1e-7)


def test_no_dense_row_in_the_plan_of_sparse_components(forms):
    _, _, sparse = forms
    saved = sparse.select("cell", "features")
    plan = saved._jdf.queryExecution().toString()
    assert "array_repeat" not in plan and "sequence" not in plan


def test_an_unconverged_basis_is_marked_or_fails(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(v) for v in rng.normal(size=90)]) for i in range(300)]
    df = spark.createDataFrame(rows, "cell int, v array<double>").selectExpr("cell", "v")
    from pyspark.ml.functions import array_to_vector

    vectors = df.select("cell", array_to_vector("v").alias("features"))
    with pytest.warns(UserWarning, match="not exact"):
        result = reduce.pca(vectors, k=5, max_rounds=1)
    assert not result.convergence.converged and result.convergence.rounds == 1 and result.convergence.residual > 1e-3
    with pytest.raises(ArithmeticError):
        reduce.pca(vectors, k=5, max_rounds=2, strict=True)
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        whole = reduce.pca(vectors, k=5)
    assert whole.convergence.rounds < 80
    turn, _ = exact(np.array([r[1] for r in rows]), 5)
    assert np.allclose(np.abs((whole.loadings * turn).sum(axis=0)), 1.0, atol=1e-6)


@pytest.mark.parametrize("parts", [1, 7, 50])
def test_no_task_adds_up_more_than_the_root_of_the_parts(spark, monkeypatch, parts):
    x = matrix(3, 200, 12)
    monkeypatch.setattr(reduce, "CHUNK", 5)

    class Rows:
        mean, n, columns = x.mean(axis=0), len(x), ("x",)
        rows = spark.createDataFrame([(r.tolist(),) for r in x], "x array<double>").repartition(parts)
        square, centred = staticmethod(reduce._Dense.square), staticmethod(reduce._Dense.centred)

    q = np.linalg.qr(np.random.default_rng(0).normal(size=(12, 3)))[0]
    product, most = reduce._product(Rows(), q, parts)
    assert np.allclose(product, np.cov(x.T) @ q) and most <= (parts if parts <= 16 else int(np.ceil(np.sqrt(parts))) + 1)


def test_sparse_rows_of_odd_tables(spark, sparse, axes):
    rows = {r["cell"]: r["features"] for r in shape.to_sparse(sparse, axes, "value").collect()}
    assert rows["c6"]["indices"] == [] and rows["c6"]["size"] == 5
    again = sparse.unionByName(sparse)
    assert {r["cell"]: r["features"] for r in shape.to_sparse(again, axes, "value").collect()} == rows
    missing = sparse.unionByName(spark.createDataFrame([("c6", "G1", None)], sparse.schema))
    assert shape.to_sparse(missing, axes, "value", impute=2.0).where("cell = 'c6'").first()["features"]["values"] == [2.0]
    with pytest.raises(Exception, match="NULL value"):
        shape.to_sparse(missing, axes, "value").collect()
    assert shape.to_sparse(sparse.limit(0), value="value").count() == 0


@pytest.mark.parametrize("rows", ["sparse", "dense"])
def test_cells_are_dealt_into_parts_of_bounded_size(spark, monkeypatch, rows):
    """However few partitions a shuffle has, no task gets many more entries than allowed."""
    monkeypatch.setattr(shape, "TASK_ENTRIES", 400, raising=False)
    data = [(f"c{i}", f"g{j}", float(1 + (i * j) % 7)) for i in range(200) for j in range(20)]
    tall = spark.createDataFrame(data, "cell string, variable string, value double")
    usual = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        out = shape.to_sparse(tall, value="value") if rows == "sparse" else shape.densify(tall)
        found = out.groupBy(F.spark_partition_id().alias("part")).agg(F.count_distinct("cell").alias("cells")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", usual)
    assert sum(r["cells"] for r in found) == 200 and max(r["cells"] for r in found) <= 60
