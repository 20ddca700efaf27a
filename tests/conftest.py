from __future__ import annotations

import os

import pytest
from pyspark.sql import SparkSession

# 6 cells x 5 genes; c6 is empty, AMT3 contains "mt" without being mitochondrial.
GENES = ["G1", "G2", "ERCC-1", "MT-1", "AMT3"]
GOLDEN = {
    "c1": [5, 0, 2, 1, 0],
    "c2": [3, 1, 0, 0, 4],
    "c3": [0, 2, 1, 3, 4],
    "c4": [8, 2, 0, 1, 0],
    "c5": [1, 0, 0, 2, 9],
    "c6": [0, 0, 0, 0, 0],
}
LABELS = {"c1": 0, "c2": 0, "c4": 0, "c3": 1, "c5": 1, "c6": 1}
TALL = "cell string, variable string, value bigint"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master(f"local[{os.environ.get('BENCH_CPUS', '8')}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def dense(spark):
    rows = [(cell, gene, value) for cell, values in GOLDEN.items() for gene, value in zip(GENES, values)]
    return spark.createDataFrame(rows, TALL).cache()


@pytest.fixture(scope="session")
def axes(dense):
    from tallmat.operators.axes import Axes

    return Axes.of(dense)


@pytest.fixture(scope="session")
def sparse(dense):
    from tallmat.operators.shape import sparsify

    return sparsify(dense)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame(list(LABELS.items()), "cell string, prediction int")


def table(df, *keys):
    """Rows as {key: {column: value}}, doubles rounded to 6 places."""
    out = {}
    for row in df.collect():
        values = {k: round(v, 6) if isinstance(v, float) else v for k, v in row.asDict().items()}
        key = tuple(values.pop(k) for k in keys)
        assert key not in out, f"repeated {key}"
        out[key[0] if len(keys) == 1 else key] = values
    return out
