"""k-means with silhouette and elbow sweep, feature preparation, and joins of labels."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from tallmat.operators.sums import partition_count, summed
from tallmat.stages import materialise

# Ship this module's functions to the executors themselves, so that these need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The sweep: cells that starting centres are taken from, starts and rounds on these, rounds on all cells, and how little
# centres move in the end.
SAMPLE, STARTS, SAMPLE_ROUNDS, ROUNDS, TOLERANCE = 5_000, 8, 20, 20, 1e-4

class KMeansResult(NamedTuple):
    """The model, ``(cell, features, prediction)``, and ``(k, silhouette, sse)``."""

    model: KMeansModel
    predictions: DataFrame
    metrics: tuple[int, float, float]


def prepare_features(df: DataFrame, impute: float | None = None) -> DataFrame:
    """``(cell, features)`` from any mix of numeric, string and vector columns.

    Strings are indexed by frequency, unseen ones kept as an extra index. A NULL number fails, or is
    replaced by ``impute``.
    """
    fields = [f for f in df.schema.fields if f.name != "cell"]
    strings = [f.name for f in fields if isinstance(f.dataType, StringType)]
    others = [f.name for f in fields if not isinstance(f.dataType, StringType)]
    if impute is not None:
        numeric = [f.name for f in fields if isinstance(f.dataType, NumericType)]
        df = df.withColumns({name: F.coalesce(F.col(f"`{name}`"), F.lit(impute)) for name in numeric})
    indexed = [f"{name}_index" for name in strings]
    stages = []
    if strings:
        stages.append(StringIndexer(inputCols=strings, outputCols=indexed, handleInvalid="keep"))
    stages.append(VectorAssembler(inputCols=others + indexed, outputCol="features"))
    return Pipeline(stages=stages).fit(df).transform(df).select("cell", "features")


def silhouette(predictions: DataFrame, features_col: str = "features", prediction_col: str = "prediction") -> float:
    """Mean silhouette with squared Euclidean distance, from per-cluster sums (no pairs of cells)."""
    return ClusteringEvaluator(featuresCol=features_col, predictionCol=prediction_col).evaluate(predictions)


def sum_of_squares(model: KMeansModel, predictions: DataFrame, features_col: str, prediction_col: str) -> float:
    """Summed squared distances of the cells to their centres, as they are in the end.

    The cost that training reports is that of the centres before their last move.
    """
    centers = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in model.clusterCenters()])
    point, own = vector_to_array(features_col), F.get(centers, F.col(prediction_col))
    squares = F.aggregate(F.zip_with(point, own, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    return predictions.agg(F.coalesce(F.sum(squares), F.lit(0.0))).first()[0]


def kmeans(
    df: DataFrame,
    k: int = 2,
    features_col: str = "features",
    prediction_col: str = "prediction",
    with_silhouette: bool = False,
    seed: int = 125,
) -> KMeansResult:
    """Cluster the cells. The silhouette is 0 unless asked for. Persist ``df`` when calling repeatedly."""
    model = KMeans(featuresCol=features_col, predictionCol=prediction_col, k=k, seed=seed).fit(df)
    predictions = model.transform(df).select("cell", features_col, prediction_col)
    score = silhouette(predictions, features_col, prediction_col) if with_silhouette else 0.0
    return KMeansResult(model, predictions, (k, score, sum_of_squares(model, predictions, features_col, prediction_col)))


def _squares(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2.0 * (x @ centers.T) + (centers * centers).sum(axis=1)[None, :]


def _first_centers(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Up to ``k`` starting centres, spread out: each is the best of a few points drawn by their distance from those before."""
    rng = np.random.default_rng(seed)
    centers = [x[rng.integers(len(x))]]
    nearest = ((x - centers[0]) ** 2).sum(axis=1)
    while len(centers) < k and nearest.sum() > 0:
        drawn = rng.choice(len(x), size=2 + int(np.log(k)), p=nearest / nearest.sum())
        after = np.minimum(nearest, np.maximum(_squares(x, x[drawn]).T, 0.0))
        best = after.sum(axis=1).argmin()
        centers.append(x[drawn[best]])
        nearest = np.minimum(nearest, ((x - centers[-1]) ** 2).sum(axis=1))
    return np.stack(centers)


def _tallied(batches: Iterator[pd.DataFrame], centers: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """For every k, by cluster: sums of coordinates, number of cells, squared lengths, and squared distances to the centre."""
    out = {k: np.zeros((len(c), c.shape[1] + 3)) for k, c in centers.items()}
    for batch in batches:
        if not len(batch):
            continue
        x = np.stack(batch["x"].to_numpy())
        lengths = (x * x).sum(axis=1)
        for k, c in centers.items():
            own = _squares(x, c).argmin(axis=1)
            off = ((x - c[own]) ** 2).sum(axis=1)
            tally = out[k]
            tally[:, : x.shape[1]] += (own == np.arange(len(c))[:, None]).astype(float) @ x
            for j, weights in enumerate((None, lengths, off)):
                tally[:, x.shape[1] + j] += np.bincount(own, weights, len(c))
    return {k: t.ravel() for k, t in out.items()}


def _sample_centers(
    x: np.ndarray, ks: list[int], seed: int, moved: Callable[[np.ndarray, np.ndarray], np.ndarray]
) -> dict[int, np.ndarray]:
    """For every k the centres that fit the sample best, of some starts that each take the same rounds."""
    best: dict[int, tuple[float, np.ndarray]] = {}
    for start in range(STARTS):
        first = _first_centers(x, max(ks), seed + start)
        centers = {k: first[:k] for k in ks}
        for _ in range(SAMPLE_ROUNDS):
            tallies = _tallied(iter([pd.DataFrame({"x": list(x)})]), centers)
            for k, c in centers.items():
                sse = tallies[k].reshape(len(c), -1)[:, -1].sum()
                if k not in best or sse < best[k][0]:
                    best[k] = (sse, c)
            centers = {k: after for k, c in centers.items() if not np.array_equal(after := moved(c, tallies[k]), c)}
            if not centers:
                break
    return {k: c for k, (_, c) in best.items()}


def _silhouettes(batches: Iterator[pd.DataFrame], shared: dict[int, tuple[np.ndarray, np.ndarray]]) -> dict[int, np.ndarray]:
    """For every k, the sum of the cells' silhouettes, from the tallies of the clusters."""
    out = {k: np.zeros(1) for k in shared}
    for batch in batches:
        if not len(batch):
            continue
        x = np.stack(batch["x"].to_numpy())
        lengths, rows = (x * x).sum(axis=1), np.arange(len(x))
        for k, (centers, tally) in shared.items():
            own = _squares(x, centers).argmin(axis=1)
            sums, sizes, squares = tally[:, : x.shape[1]], tally[:, -3], tally[:, -2]
            total = np.maximum(sizes * lengths[:, None] + squares - 2.0 * (x @ sums.T), 0.0)
            with np.errstate(divide="ignore", invalid="ignore"):
                mean = np.where(sizes > 0, total / sizes, np.inf)
                inner = total[rows, own] / (sizes[own] - 1)
                mean[rows, own] = np.inf
                outer = mean.min(axis=1)
                score = (outer - inner) / np.maximum(inner, outer)
            out[k] += np.where((sizes[own] > 1) & np.isfinite(score), score, 0.0).sum()
    return out


def kmeans_sweep(
    df: DataFrame,
    ks: Iterable[int] = range(2, 20),
    features_col: str = "features",
    seed: int = 125,
    max_rounds: int = ROUNDS,
) -> DataFrame:
    """``(k, silhouette, sse)`` for every k, for an elbow plot, as :func:`sweep` finds them."""
    found = [(k, f.silhouette, f.sse) for k, f in sweep(df, ks, features_col, seed, max_rounds).items()]
    return df.sparkSession.createDataFrame(found, "k int, silhouette double, sse double")


class SweepFit(NamedTuple):
    """Centres of one k, and what they reach over all cells."""

    centers: np.ndarray
    silhouette: float
    sse: float


def sweep(
    df: DataFrame,
    ks: Iterable[int] = range(2, 20),
    features_col: str = "features",
    seed: int = 125,
    max_rounds: int = ROUNDS,
) -> dict[int, SweepFit]:
    """Clusterings for every k; all advance together, in one scan of the cells a round.

    The driver holds the centres of every k and gets sums by cluster. Centres start from at most ``SAMPLE`` cells (those of
    smallest hash), where the best of ``STARTS`` fits of each k is chosen; then every round assigns all cells to the centres of each k
    that still moves. After ``max_rounds``, or when none moves further than ``TOLERANCE``, one more scan gives the sums
    of squared distances and another the silhouettes (squared Euclidean distance, 0 for a cell alone in its cluster).
    A k beyond the number of distinct cells gets as many clusters as there are such cells.
    """
    ks = sorted(set(ks))
    rows = materialise(df.select(vector_to_array(features_col).alias("x")))
    sample = rows.orderBy(F.xxhash64("x"), "x").limit(SAMPLE).collect()
    if not sample or not ks:
        return {}
    partitions = partition_count(rows)
    x = np.array([r["x"] for r in sample])

    def moved(centers: np.ndarray, tally: np.ndarray) -> np.ndarray:
        tally = tally.reshape(len(centers), -1)
        sizes = tally[:, -3:-2]
        return np.where(sizes > 0, tally[:, :-3] / np.maximum(sizes, 1.0), centers)

    centers = _sample_centers(x, ks, seed, moved)
    moving = dict(centers)
    for _ in range(max_rounds):
        tallies, _ = summed(rows, moving, _tallied, partitions)
        after = {k: moved(c, tallies[k]) for k, c in moving.items()}
        centers |= after
        moving = {k: c for k, c in after.items() if np.sqrt(((c - moving[k]) ** 2).sum(axis=1)).max() > TOLERANCE}
        if not moving:
            break
    tallies, _ = summed(rows, centers, _tallied, partitions)
    shared = {k: (c, tallies[k].reshape(len(c), -1)) for k, c in centers.items()}
    scores, _ = summed(rows, shared, _silhouettes, partitions)
    return {k: SweepFit(c, float(scores[k][0] / t[:, -3].sum()), float(t[:, -1].sum())) for k, (c, t) in shared.items()}


def assigned(df: DataFrame, centers: np.ndarray, features_col: str = "features") -> DataFrame:
    """``(cell, features, prediction)``: every cell with the number of its nearest centre."""

    @F.pandas_udf("int")
    def nearest(x: pd.Series) -> pd.Series:
        return pd.Series(_squares(np.stack(x.to_numpy()), centers).argmin(axis=1).astype("int32")) if len(x) else pd.Series([], dtype="int32")

    return df.select("cell", features_col, nearest(vector_to_array(features_col)).alias("prediction"))


def cluster_sizes(predictions: DataFrame, prediction_col: str = "prediction") -> DataFrame:
    """``(prediction, count)`` in order of the label."""
    return predictions.groupBy(prediction_col).count().orderBy(prediction_col)


def attach(df: DataFrame, other: DataFrame, *columns: str) -> DataFrame:
    """Left-join metadata or predictions on ``cell``; all columns of ``other`` unless some are named."""
    return df.join(other.select("cell", *columns) if columns else other, "cell", "left")
