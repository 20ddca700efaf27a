"""A query gets as many neighbours as it asked for, though the leaves it visits hold few rows."""

from __future__ import annotations

import numpy as np

from tallmat.llm import kmtree


def test_visits_go_on_until_enough_rows():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 5))
    tree = kmtree.grow(x, 40, float(np.sqrt((x * x).sum(axis=1)).max()))
    leaf = tree.assign(x)
    sizes = dict(zip(*(v.tolist() for v in np.unique(leaf, return_counts=True)), strict=True))
    for query in x[:50]:
        few = tree.visit(query, 1)
        more = tree.visit(query, 1, sizes, 21)
        assert len(few) == 1 and more[:1] == few
        assert sum(sizes.get(n, 0) for n in more) >= 21 > sum(sizes.get(n, 0) for n in more[:-1])
    assert sorted(tree.visit(x[0], 1, sizes, 10_000)) == list(range(sum(not kids for kids in tree.children)))


def test_every_query_gets_all_it_asked_for(spark, monkeypatch):
    monkeypatch.setattr(kmtree, "LEAF_ROWS", 3)
    monkeypatch.setattr(kmtree, "calibrate", lambda *_: (1, 1.0))
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.normal(size=6)]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = kmtree.search(df, df.where("vec_id % 20 = 0"), k=20).groupBy("query_id").count().collect()
    assert {r["query_id"]: r["count"] for r in found} == {i: 20 for i in range(0, 300, 20)}
