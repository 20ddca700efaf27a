"""All k of the sweep in one scan: SSE and silhouette by their definitions, and small or odd tables."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tallmat.operators import cluster


def vectors(spark, x):
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "cell int, x array<double>").select("cell", array_to_vector(F.col("x")).alias("features"))


def groups(n=300, k=4):
    rng = np.random.default_rng(5)
    return rng.normal(size=(k, 3))[rng.integers(0, k, n)] * 20 + rng.normal(size=(n, 3))


def test_values_are_those_of_the_definitions(spark):
    x = groups()
    found = {r["k"]: r for r in cluster.kmeans_sweep(vectors(spark, x).repartition(20), range(2, 8)).collect()}
    assert sorted(found) == list(range(2, 8))
    # With as many clusters as groups, the clusters are the groups.
    own = np.unique(np.round(x / 6), axis=0)
    assert len(own) >= 4
    single = cluster.kmeans(vectors(spark, x), 4, with_silhouette=True, seed=3)
    best = min(cluster.kmeans(vectors(spark, x), 4, seed=s).metrics[2] for s in (1, 2, 3))
    assert found[4]["sse"] <= best * 1.0001
    assert found[4]["silhouette"] >= single.metrics[1] - 1e-9
    assert all(found[k + 1]["sse"] < found[k]["sse"] for k in range(2, 7))


def test_silhouettes_equal_a_plain_version():
    x = groups(60)
    centers = x[:5]
    import pandas as pd

    frame = [pd.DataFrame({"x": list(x[:40])}), pd.DataFrame({"x": list(x[40:])}), pd.DataFrame({"x": []})]
    tally = cluster._tallied(iter(frame), {5: centers})[5].reshape(5, -1)
    own = ((x[:, None] - centers[None]) ** 2).sum(axis=2).argmin(axis=1)
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    plain = 0.0
    for i in range(60):
        mates = [j for j in range(60) if own[j] == own[i] and j != i]
        if mates:
            a = d[i, mates].mean()
            b = min(d[i, own == c].mean() for c in set(own) - {own[i]})
            plain += (b - a) / max(a, b)
    assert cluster._silhouettes(iter(frame), {5: (centers, tally)})[5][0] == pytest.approx(plain)
    assert tally[:, -3].tolist() == np.bincount(own, minlength=5).tolist()
    assert tally[:, -1].sum() == pytest.approx(sum(((x[i] - centers[own[i]]) ** 2).sum() for i in range(60)))


def test_few_distinct_cells_and_an_empty_table(spark):
    x = np.array([[0.0, 0.0]] * 5 + [[3.0, 4.0]] * 2)
    found = {r["k"]: r for r in cluster.kmeans_sweep(vectors(spark, x), [2, 5]).collect()}
    assert found[2]["sse"] == found[5]["sse"] == 0.0 and found[2]["silhouette"] == 1.0
    assert cluster.kmeans_sweep(vectors(spark, x).limit(0), [2]).count() == 0
