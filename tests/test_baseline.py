"""Quantile normalisation that stays sparse, and the steps that take it."""

from __future__ import annotations

import numpy as np
import pytest

from conftest import table
from tallmat.operators import hvg, normalize, reduce, shape
from tallmat.operators.axes import Axes


@pytest.fixture(scope="module")
def both(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 5, (40, 12)) * (rng.random((40, 12)) < 0.4)
    x[:, 0] = rng.integers(1, 9, 40)  # no zero
    x[:, 1] = 0
    x[:, 2] = np.where(rng.random(40) < 0.3, -2, x[:, 2])
    rows = [(f"c{i:02}", f"g{j:02}", int(v)) for i, r in enumerate(x) for j, v in enumerate(r)]
    dense = spark.createDataFrame(rows, "cell string, variable string, value bigint")
    axes = Axes.of(dense)
    return normalize.norm_quantile(dense), normalize.norm_quantile_sparse(shape.sparsify(dense), axes), int((x != 0).sum())


def test_densified_it_is_the_dense_result(both):
    dense, sparse, stored = both
    assert table(sparse.dense(), "cell", "variable") == table(dense, "cell", "variable")
    assert sparse.entries.count() == stored and sparse.baseline.count() == 12
    values = table(sparse.values(), "cell", "variable")
    every = table(dense, "cell", "variable")
    assert len(values) == stored and all(every[k] == v for k, v in values.items())


def test_gene_statistics_are_those_of_the_dense_result(both):
    dense, sparse, _ = both
    assert table(hvg.hvg_stats(sparse), "variable") == table(hvg.hvg_stats(dense), "variable")
    top = hvg.hvg_cv2(sparse, 4)
    assert table(top, "variable") == table(hvg.hvg_cv2(dense, 4), "variable")
    chosen, plain = hvg.select_genes(sparse, top), hvg.select_genes(dense, top)
    assert table(chosen.dense(), "cell", "variable") == table(plain, "cell", "variable")
    assert table(hvg.hvg_mad(sparse, 0.5), "variable") == table(hvg.hvg_mad(dense, 0.5), "variable")


def test_components_are_those_of_the_dense_result(both):
    dense, sparse, _ = both
    a = reduce.pca(shape.to_vectors(dense), k=3)
    b = reduce.pca(sparse.to_sparse(), k=3, offset=sparse.offset())
    scores = [np.array([r["components"].toArray() for r in p.components.orderBy("cell").collect()]) for p in (a, b)]
    assert np.allclose(*scores, atol=1e-6) and np.allclose(a.loadings, b.loadings, atol=1e-6)
