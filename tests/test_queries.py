"""Every registered query against its SQL in another engine, and the whole chain from a CSV."""

from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as contract  # noqa: E402
from tallmat import Settings, qc, run  # noqa: E402
from tallmat.sources import counts as counts_module  # noqa: E402
from tallmat.sources import export_csv, retail, write_table  # noqa: E402

TABLES = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for name in os.listdir(TABLES):
        connection.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{TABLES}/{name}'")
    return connection


def canonical(rows):
    return sorted(repr(tuple(float(v) if isinstance(v, float) else v for v in row)) for row in rows)


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    df = contract.queries()[name](spark, TABLES)
    columns = sorted(df.columns)
    expected = duck.sql(contract.oracle_sql()[name])
    assert sorted(expected.columns) == columns
    order = [expected.columns.index(c) for c in columns]
    ours = canonical(tuple(row[c] for c in columns) for row in df.collect())
    theirs = canonical(tuple(row[i] for i in order) for row in expected.fetchall())
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(contract.queries()) - set(contract.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert contract.queries()[name](spark, TABLES).count() > 0


def test_entry(spark):
    assert contract.entry(spark).columns == ["prediction", "variable", "t_test", "p_val", "rank"]


@pytest.mark.parametrize("normalisation", ["global", "quantile"])
def test_workflow_from_csv(spark, tmp_path, normalisation):
    counts = retail.counts(spark, TABLES, "supplier")
    export_csv(counts.wide(), str(tmp_path / "matrix"))
    settings = Settings(
        limits=qc.Thresholds(min_counts=1),
        apply_ercc=False,
        apply_mito=False,
        normalisation=normalisation,
        n_genes=30,
        n_components=4,
        n_clusters=2,
        with_silhouette=True,
        mad_above=0.1 if normalisation == "global" else None,
    )
    results = run(spark, str(tmp_path / "matrix"), settings, str(tmp_path / "out"))
    kept = results["filtered"].select("cell").distinct().count()
    assert 0 < kept <= 10
    assert results["predictions"].count() == results["pca"].count() == kept
    assert results["explained_variance"].count() == 4
    assert results["cluster_sizes"].agg({"count": "sum"}).first()[0] == kept
    assert results["diff_expr"].where("p_val > 0.05 OR rank > 10").count() == 0
    assert results["metrics"].first()["k"] == 2


def test_dense_counts_are_written_without_a_sort(spark, tmp_path):
    """The dense rows come from one row per cell, so writing them shuffles no dense row; a cell lies in one file."""
    spark.createDataFrame([(i, "PROMO", 30 + i) for i in range(3)], "p_partkey long, p_type string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    spark.range(40).selectExpr("id AS o_orderkey", "id % 9 AS o_custkey").write.parquet(str(tmp_path / "orders.parquet"))
    lines = spark.range(40).selectExpr("id AS l_orderkey", "id % 3 AS l_partkey", "id % 5 + 1 AS l_quantity")
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    read = retail.counts(spark, str(tmp_path), dense=True)
    rows = read.entries.withColumn("file", F.input_file_name())
    assert rows.count() == 27 and rows.groupBy("cell").agg(F.count_distinct("file").alias("n")).where("n > 1").count() == 0
    assert read.entries.agg(F.sum("value")).first()[0] == lines.agg(F.sum("l_quantity")).first()[0]
    seen = []
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(counts_module, "write_table", lambda df, path, cluster_by=(): seen.append(cluster_by) or write_table(df, path, cluster_by))
        retail.counts(spark, str(tmp_path), dense=True)
    assert seen.count(("cell", "variable")) == 1
