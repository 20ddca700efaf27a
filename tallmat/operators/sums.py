"""Vectors that tasks compute from their own rows, added up without gathering them in one task."""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Ship this module's functions to the executors themselves, so that these need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Partial sums that one task adds up in any case.
FEW = 16
KIND = "chunk long, salt long, most long, part binary"


def partition_count(df: DataFrame) -> int:
    """Partitions of a saved table, as a scan of it has them."""
    return df.select(F.spark_partition_id().alias("p")).agg(F.coalesce(F.max("p"), F.lit(0))).first()[0] + 1


def summed(
    rows: DataFrame, shared: Any, work: Callable[[Iterator[pd.DataFrame], Any], dict[int, np.ndarray]], partitions: int
) -> tuple[dict[int, np.ndarray], int]:
    """The sums, by chunk, of what ``work`` makes of the rows of each task and ``shared``; and the most parts a task added.

    Where there are more than ``FEW`` partitions parts are added on two levels, so that no task sees more than about the
    square root of their number. The driver gets one vector per chunk.
    """
    sent = rows.sparkSession.sparkContext.broadcast(shared)
    groups = max(1, math.isqrt(max(0, partitions - 1)) + 1)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = work(batches, sent.value)
        salt = TaskContext.get().partitionId() % groups
        yield pd.DataFrame({"chunk": list(parts), "salt": salt, "most": 1, "part": [p.tobytes() for p in parts.values()]})

    def add(parts: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(len(parts["part"].iloc[0]) // 8)
        for part in parts["part"]:
            total += np.frombuffer(part)
        return parts.iloc[:1].assign(part=[total.tobytes()], most=max(len(parts), int(parts["most"].max())))

    parts = rows.mapInPandas(partial, KIND)
    if partitions > FEW:
        parts = parts.groupBy("chunk", "salt").applyInPandas(add, KIND)
    sums = parts.groupBy("chunk").applyInPandas(add, KIND).collect()
    # The files that hold it on the executors go with it.
    sent.destroy()
    return {r["chunk"]: np.frombuffer(r["part"]) for r in sums}, max((r["most"] for r in sums), default=0)
