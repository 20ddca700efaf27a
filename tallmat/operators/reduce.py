"""Principal components and their use as coordinates."""

from __future__ import annotations

import sys
import warnings
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallmat.operators.sums import partition_count, summed
from tallmat.stages import materialise

# Ship this module's functions to the executors themselves, so that these need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Further directions that are carried along, rounds at most, and the residual, relative to the largest variance,
# at which rounds end.
OVERSAMPLE, MAX_ROUNDS, TOLERANCE = 32, 200, 1e-8
# Rows of a product that are added up in one task, and stored entries that are multiplied at a time.
CHUNK, ENTRIES = 1024, 1 << 18
SEED = 17


class Convergence(NamedTuple):
    """How the rounds ended: their number, the residual relative to the largest variance, whether that is small enough, and
    the largest number of partial sums that one task added up."""

    rounds: int
    residual: float
    converged: bool
    most_parts: int


class PcaResult(NamedTuple):
    """Components per cell, explained variance per component, the loadings (genes x components), and how rounds ended."""

    components: DataFrame
    explained: DataFrame
    loadings: np.ndarray
    convergence: Convergence


class _Dense:
    """Rows as arrays of all values, centred where they are used."""

    columns = ("x",)

    def __init__(self, vectors: DataFrame, input_col: str):
        self.rows = materialise(vectors.select("cell", vector_to_array(F.col(input_col)).alias("x")))
        row = vectors.select(
            Summarizer.metrics("mean", "variance", "count").summary(F.col(input_col)).alias("s")
        ).select("s.mean", "s.variance", "s.count").first()
        self.mean, self.n = row["mean"].toArray(), max(int(row["count"]), 2)
        self.total = float(row["variance"].toArray().sum())

    @staticmethod
    def square(batch: pd.DataFrame, mean: np.ndarray, q: np.ndarray) -> np.ndarray:
        x = np.stack(batch["x"].to_numpy()) - mean
        return x.T @ (x @ q)

    @staticmethod
    def centred(product: np.ndarray, mean: np.ndarray, q: np.ndarray, n: int) -> np.ndarray:
        return product

    @staticmethod
    def projected(batch: pd.DataFrame, q: np.ndarray) -> np.ndarray:
        return np.stack(batch["x"].to_numpy()) @ q


class _Sparse:
    """Rows as positions and values of their stored entries; the mean comes in afterwards, so zeros cost nothing."""

    columns = ("indices", "values")

    def __init__(self, vectors: DataFrame, input_col: str):
        self.rows = materialise(vectors.select("cell", F.col(f"{input_col}.indices").alias("indices"), F.col(f"{input_col}.values").alias("values")))
        head = vectors.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(f"{input_col}.size"), F.lit(0)).alias("size")).first()
        entry = self.rows.select(F.explode(F.arrays_zip("indices", "values")).alias("e"))
        moments = entry.groupBy("e.indices").agg(
            F.count(F.lit(1)).alias("c"), F.avg("e.values").alias("m"), F.var_pop("e.values").alias("v")
        ).collect()
        self.n = max(head["n"], 2)
        at, c, m, v = (np.array([r[i] for r in moments], dtype=t) for i, t in enumerate((np.int64, float, float, float)))
        self.mean = np.zeros(head["size"])
        self.mean[at] = m * c / self.n
        # Moments of the stored entries, merged with a group of zeros.
        self.total = float((v * c + m * m * c * (self.n - c) / self.n).sum()) / (self.n - 1)

    @staticmethod
    def slices(batch: pd.DataFrame) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
        """Rows of a batch with a bounded number of entries each: their row numbers, positions and values."""
        ends = np.cumsum(batch["indices"].map(len).to_numpy(dtype=np.int64))
        start = 0
        while start < len(batch):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + ENTRIES, side="right")))
            part = batch.iloc[start:stop]
            row = np.repeat(np.arange(stop - start), part["indices"].map(len).to_numpy(dtype=np.int64))
            yield slice(start, stop), row, np.concatenate(part["indices"].to_list()).astype(np.int64), np.concatenate(part["values"].to_list())
            start = stop

    @staticmethod
    def times(row: np.ndarray, at: np.ndarray, value: np.ndarray, q: np.ndarray, n: int) -> np.ndarray:
        return np.stack([np.bincount(row, value * column[at], n) for column in q.T], axis=1)

    @classmethod
    def square(cls, batch: pd.DataFrame, mean: np.ndarray, q: np.ndarray) -> np.ndarray:
        total = np.zeros_like(q)
        for part, row, at, value in cls.slices(batch):
            image = cls.times(row, at, value, q, part.stop - part.start)
            total += cls.times(at, row, value, image, len(q))
        return total

    @staticmethod
    def centred(product: np.ndarray, mean: np.ndarray, q: np.ndarray, n: int) -> np.ndarray:
        return product - n * np.outer(mean, mean @ q)

    @classmethod
    def projected(cls, batch: pd.DataFrame, q: np.ndarray) -> np.ndarray:
        out = np.zeros((len(batch), q.shape[1]))
        for part, row, at, value in cls.slices(batch):
            out[part] = cls.times(row, at, value, q, part.stop - part.start)
        return out


def _product(matrix: _Dense | _Sparse, q: np.ndarray, partitions: int) -> tuple[np.ndarray, int]:
    """Covariance times ``q``, and the most partial sums that a task added up.

    Every task multiplies its own rows; their products are added by chunk of genes.
    """
    square = type(matrix).square

    def work(batches: Iterator[pd.DataFrame], shared: tuple[np.ndarray, np.ndarray]) -> dict[int, np.ndarray]:
        mean, q = shared
        total = np.zeros_like(q)
        for batch in batches:
            if len(batch):
                total += square(batch, mean, q)
        return {s: total[s : s + CHUNK] for s in range(0, len(q), CHUNK)}

    sums, most = summed(matrix.rows.select(*matrix.columns), (matrix.mean, q), work, partitions)
    whole = np.concatenate([sums[s] for s in sorted(sums)]).reshape(q.shape)
    return matrix.centred(whole, matrix.mean, q, matrix.n) / (matrix.n - 1), most


def _orthonormal(m: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what ``m`` adds to bases; may have fewer columns."""
    for _ in range(2):
        for basis in against:
            m = m - basis @ (basis.T @ m)
    if not m.size:
        return m[:, :0]
    left, size, _ = np.linalg.svd(m, full_matrices=False)
    left = left[:, size > 1e-10 * max(size[0], 1e-300)]
    for basis in against:
        left = left - basis @ (basis.T @ left)
    return np.linalg.qr(left)[0]


def _leading(
    product: Callable[[np.ndarray], tuple[np.ndarray, int]], start: np.ndarray, k: int, max_rounds: int
) -> tuple[np.ndarray, np.ndarray, Convergence]:
    """The ``k`` leading directions of a symmetric matrix, their sizes, largest first, and how rounds ended.

    Each round multiplies the residuals of the directions that are not exact yet and takes the best directions among the
    former ones, these residuals and the last step (locally optimal block conjugate gradients), which needs far fewer
    passes over the rows than multiplying the directions again and again.
    """
    q = _orthonormal(start)
    image, most = product(q)
    step = step_image = q[:, :0]
    basis, images, done = q, image, 1
    while True:
        sizes, turn = np.linalg.eigh((basis.T @ images + images.T @ basis) / 2)
        turn = turn[:, ::-1][:, : q.shape[1]]
        sizes = sizes[::-1][: q.shape[1]]
        moved = turn.copy()
        moved[: q.shape[1]] = 0
        moved = _orthonormal(moved, turn) if done > 1 else moved[:, :0]
        q, image, step, step_image = basis @ turn, images @ turn, basis @ moved, images @ moved
        off = image - q * sizes
        norms, scale = np.linalg.norm(off, axis=0), max(sizes[0], 1e-300)
        residual = float(norms[:k].max() / scale)
        open_columns = norms > 0.1 * TOLERANCE * scale
        more = _orthonormal(off[:, open_columns] / norms[open_columns], q, step)
        if residual <= TOLERANCE or done >= max_rounds or not more.shape[1]:
            return q[:, :k], sizes[:k], Convergence(done, residual, residual <= TOLERANCE, most)
        more_image, parts = product(more)
        done, most = done + 1, max(most, parts)
        basis, images = np.hstack([q, more, step]), np.hstack([image, more_image, step_image])


def pca(
    vectors: DataFrame,
    k: int = 2,
    input_col: str = "features",
    max_rounds: int = MAX_ROUNDS,
    strict: bool = False,
    offset: np.ndarray | None = None,
) -> PcaResult:
    """Project ``(cell, vector)`` on ``k`` principal components: ``(cell, components)``.

    ``input_col`` holds vectors, or the sparse rows of :func:`tallmat.operators.shape.to_sparse`; these are never made
    dense, and a round costs as much as there are stored entries. The leading directions are found by repeated
    multiplication of a narrow matrix with the covariance, which is never formed: the driver holds some matrices of
    genes times ``k`` plus a few, and tasks multiply their own rows, one pass over them a round. The sign of a component is arbitrary; here the loading of largest
    magnitude is made positive. As in Spark ML the uncentred vectors are projected, so a component need not have mean 0.

    ``offset`` holds a number per gene that all rows lack, such as the baseline of a matrix kept as deviations: directions
    do not depend on it, and scores are those of the rows with it.

    Rounds end when the residual of the ``k`` directions is small. If it is not after ``max_rounds``, the result says so in
    ``convergence`` and a warning is given; with ``strict`` an ``ArithmeticError`` is raised. Runs jobs; the rows are saved.
    """
    matrix = (_Sparse if isinstance(vectors.schema[input_col].dataType, StructType) else _Dense)(vectors, input_col)
    partitions = partition_count(matrix.rows)
    width = min(len(matrix.mean), k + OVERSAMPLE)
    start = np.random.default_rng(SEED).normal(size=(len(matrix.mean), width))
    loadings, sizes, record = _leading(lambda q: _product(matrix, q, partitions), start, k, max_rounds)
    if not record.converged:
        told = f"components are not exact: relative residual {record.residual:.1e} after {record.rounds} rounds"
        if strict:
            raise ArithmeticError(told)
        warnings.warn(told, stacklevel=2)
    loadings = loadings * np.where(loadings[np.abs(loadings).argmax(axis=0), np.arange(loadings.shape[1])] < 0, -1.0, 1.0)
    project, columns = type(matrix).projected, matrix.columns
    shift = 0.0 if offset is None else offset @ loadings

    @F.pandas_udf("array<double>")
    def projected(*values: pd.Series) -> pd.Series:
        batch = pd.DataFrame(dict(zip(columns, values, strict=True)))
        return pd.Series(list(project(batch, loadings) + shift)) if len(batch) else pd.Series([], dtype=object)

    shares = np.maximum(sizes[:k], 0.0) / matrix.total if matrix.total > 0 else np.zeros(k)
    scores = matrix.rows.select("cell", array_to_vector(projected(*columns)).alias("components"))
    return PcaResult(scores, explained_variance(shares, vectors), loadings, record)


def explained_variance(shares: np.ndarray, vectors: DataFrame) -> DataFrame:
    """``(component, explained, cumulative)`` from shares of variance."""
    listed = [(i, float(x), float(c)) for i, (x, c) in enumerate(zip(shares, np.cumsum(shares), strict=True))]
    return vectors.sparkSession.createDataFrame(listed, "component int, explained double, cumulative double")


def components(df: DataFrame, *index: int, vector: str = "components") -> DataFrame:
    """Chosen vector elements as columns ``c0``, ``c1``, ... beside ``cell``."""
    values = df.select("cell", vector_to_array(vector).alias("values"))
    return values.select("cell", *[F.col("values")[i].alias(f"c{i}") for i in index])


def coordinates(df: DataFrame, x: int = 0, y: int = 1, vector: str = "components") -> DataFrame:
    """``(cell, x, y)``: two components as a plane, for joins, plots and clustering."""
    return components(df, x, y, vector=vector).toDF("cell", "x", "y")
