"""Saved stages: intermediate tables in a folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, cluster_by: tuple[str, ...] = ()) -> None:
    """Write Parquet, replacing what is there.

    ``cluster_by`` brings rows together by its first column, in no order. Keyed by ``('cell', 'variable')`` the
    rows of a cell lie together, so aggregates by cell collapse before their shuffle, while a cell with very
    many rows still spreads over several files, as adaptive execution cuts large partitions. Neither
    ranges are sampled, which would compute the rows twice, nor are labels compared: rows go by the hash of the key.
    """
    if cluster_by:
        df = df.hint("rebalance", cluster_by[0]).sortWithinPartitions(F.xxhash64(cluster_by[0]))
    df.write.mode("overwrite").parquet(path)


def scratch_dir(spark: SparkSession) -> str:
    """The folder for intermediate results: one per application below ``spark.checkpoint.dir``.

    A cluster must name that folder, as executors do not see the driver's disk. Only a session that runs in
    one process, as in tests, falls back to a temporary folder. Files stay until the folder is cleared;
    all of an application's lie in one subfolder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        configured = tempfile.mkdtemp(prefix="tallmat-")
        spark.sparkContext.setCheckpointDir(configured)
    return f"{configured.rstrip('/')}/{spark.sparkContext.applicationId}"


def materialise(df: DataFrame, path: str | None = None, cluster_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` and read it back, which cuts its lineage.

    Unlike a cached table the result survives the loss of executors, and its size is known to the
    optimizer, so a small result is broadcast in later joins and a large one is not.
    """
    spark = df.sparkSession
    path = path or f"{scratch_dir(spark)}/stage-{uuid.uuid4().hex}"
    write_table(df, path, cluster_by)
    return spark.read.schema(df.schema).parquet(path)
