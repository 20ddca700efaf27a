"""Small helpers that several operators share."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallmat.sources.tables import materialise

# A word, where a contract counts words: anything between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def saved(df: DataFrame) -> DataFrame:
    """Write to the shared checkpoint folder and read back: survives lost executors, gives true sizes."""
    return materialise(df)


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Column names that ``df`` does not have, compared without case."""
    taken = {c.lower() for c in df.columns}
    names = []
    for stem in stems:
        while stem.lower() in taken:
            stem = f"_{stem}"
        taken.add(stem.lower())
        names.append(stem)
    return names


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


# Bytes of an Arrow batch of texts. Spark's own limit of 64 MB, held by both sides of a Python worker, is much for
# an executor with little memory.
BATCH_BYTES = 4 << 20


# Rows that the Parquet reader decodes at a time. With Spark's own 4,096 one batch of long texts takes arrays of
# many megabytes, for which the heap of an executor grows and stays large.
READ_ROWS = 512


def small_batches(spark: SparkSession) -> None:
    """Limit Arrow batches by bytes for the session, unless it has set a limit itself."""
    key, usual = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20
    if str(spark.conf.get(key, str(usual))).lower() in (str(usual), "64mb", "64m"):
        spark.conf.set(key, str(BATCH_BYTES))


def short_reads(spark: SparkSession) -> None:
    """Limit Parquet batches by rows for the session, unless it has set a limit itself."""
    key = "spark.sql.parquet.columnarReaderBatchSize"
    if spark.conf.get(key, "4096") == "4096":
        spark.conf.set(key, str(READ_ROWS))


def let_go(spark: SparkSession) -> None:
    """Free what finished work left on the executors.

    Broadcasts and shuffle files go when the driver's garbage collector finds that nothing refers to them, and a
    driver with little to do collects seldom, so a long session would keep them all.
    """
    spark.sparkContext._jvm.System.gc()


def gathered(batches: Iterator[pa.RecordBatch], size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches joined until they hold about ``size`` bytes, for work that gains from more rows at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= size:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def give_back() -> None:
    """Return free memory of a Python worker, which outlives its tasks, to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def each_text(texts: pa.Array) -> Iterator[str | None]:
    """The texts of a batch one by one, so that a batch is never held twice; free memory then goes back."""
    for i in range(len(texts)):
        yield texts[i].as_py()
    give_back()


def word_count(text: Column) -> Column:
    """Words of a text, 0 where it is null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fixed_point(step: Callable[[DataFrame], DataFrame], start: DataFrame, changed: str, most: int = 64) -> DataFrame:
    """Apply ``step``, saving each result, until no row has a true ``changed`` column."""
    now = saved(start)
    for _ in range(most):
        if now.where(changed).limit(1).count() == 0:
            return now
        now = saved(step(now))
    raise RuntimeError(f"no fixed point after {most} rounds")
