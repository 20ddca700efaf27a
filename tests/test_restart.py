"""A workflow that is run again goes on after the stages that were finished."""

from __future__ import annotations

import random

import pytest

from tallmat.operators import cluster, reduce
from tallmat.plans import workflow


def test_workflow_goes_on_where_it_stopped(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    genes = [f"G{j}" for j in range(12)]
    lines = [f"c{i}," + ",".join(str(rng.randint(0, 9 + 20 * (i % 2) * (j % 2))) for j in range(12)) for i in range(30)]
    source, path = tmp_path / "counts.csv", str(tmp_path / "run")
    source.write_text("\n".join(["cell," + ",".join(genes), *lines]))
    limits = workflow.qc.Thresholds(min_genes=1, min_counts=1, min_cells=1)
    settings = workflow.Settings(limits=limits, apply_ercc=False, apply_mito=False, n_genes=8, n_components=2, n_clusters=2)
    made = []
    mark = workflow.Stages.mark
    monkeypatch.setattr(workflow.Stages, "mark", lambda self, name: (made.append(name), mark(self, name)))

    def stop(*_, **__):
        raise RuntimeError("stopped")

    fit = cluster.kmeans
    monkeypatch.setattr(cluster, "kmeans", stop)
    with pytest.raises(RuntimeError, match="stopped"):
        workflow.run(spark, str(source), settings, path)
    assert "pca" in made and "predictions" not in made
    made.clear()
    monkeypatch.setattr(cluster, "kmeans", fit)
    monkeypatch.setattr(reduce, "pca", stop)
    first = workflow.run(spark, str(source), settings, path)
    assert made == ["predictions", "metrics", "diff_expr"]
    rows = {name: sorted(map(str, df.collect())) for name, df in first.items()}
    made.clear()
    again = workflow.run(spark, str(source), settings, path)
    assert not made and {name: sorted(map(str, df.collect())) for name, df in again.items()} == rows
    # Another file under the same name is another input.
    source.write_text(source.read_text() + "\nc99," + ",".join("3" * 12))
    with pytest.raises(RuntimeError, match="stopped"):
        workflow.run(spark, str(source), settings, path)
    assert "counts" in made and "filtered" in made
