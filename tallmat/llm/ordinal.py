"""Quality grades by ordinal cumulative-link regression on hashed text."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallmat.llm.common import each_text, saved, small_batches

BUCKETS = 1 << 20
# Labelled rows used for fitting, those of smallest hash.
MAX_ROWS = 20_000
# A bucket takes part if so many fitted rows have it, and such a share of them.
MIN_ROWS, MIN_SHARE = 4, 1 / 2500
# Strength of the quadratic penalty on weights, for each fitted row.
PENALTY = 4e-4
# Probability of the wanted grade from which a document is selected.
LEAST = 0.4
ROUNDS = 40
HISTORY = 8
# Words of a text tokenised at a time.
PIECE = 1 << 20
CACHED_WORDS = 200_000
TOKEN = re.compile(r"[^\W\d_]+|[^\w\s]+|[\d_]+")


def tokens(text: str | None) -> set[str]:
    """Distinct lower-case words, runs of marks and digits, and a few marks of style, of a whole text."""
    text = text or ""
    found: set[str] = set()
    count = upper = 0
    cut = re.compile(r"\s|\Z")
    start = 0
    while start < len(text):
        end = cut.search(text, min(start + PIECE, len(text))).end()
        piece = text[start:end]
        parts = TOKEN.findall(piece)
        count += len(parts)
        upper += sum(map(str.isupper, parts))
        found.update(map(str.lower, parts))
        start = max(end, start + 1)
    marks = sum(not t[0].isalnum() for t in found)
    variety = min(9, int(10 * len(found) / max(count, 1)))
    size = min(6, len(str(count)))
    return found | {
        f" variety {variety} of {size}",
        f" upper {min(9, int(10 * upper / max(count, 1)))}",
        f" marks {min(9, int(20 * marks / max(len(found), 1)))}",
        f" size {size}",
    }


def bucket(token: str) -> int:
    return zlib.crc32(token.encode("utf-8", "surrogatepass")) % BUCKETS


@dataclass(frozen=True)
class Model:
    """``buckets`` (ascending) with their ``weights``, and the ordered ``thresholds`` between grades."""

    buckets: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def scorer(self) -> Callable[[str | None], float]:
        """A function from a text to its latent score, which keeps the weights of words seen before."""
        known = dict(zip(self.buckets.tolist(), self.weights.tolist(), strict=True))
        words: dict[str, int] = {}

        def score(text: str | None) -> float:
            found = tokens(text)
            new = [w for w in found if w not in words]
            if len(words) + len(new) > CACHED_WORDS:
                words.clear()
                new = list(found)
            for w in new:
                at = bucket(w)
                words[w] = at if at in known else -1
            # Words that share a bucket count once, as in fitting.
            return sum(known[at] for at in sorted({words[w] for w in found} - {-1}))

        return score

    def beyond(self, scores: np.ndarray) -> np.ndarray:
        """For each score, the probability of exceeding each threshold."""
        return _sigmoid(np.asarray(scores)[:, None] - self.thresholds[None, :])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


def loss_and_slopes(scores: np.ndarray, grades: np.ndarray, thresholds: np.ndarray):
    """Negative log-likelihood, its slope by each score, and its slopes by the thresholds."""
    edges = np.concatenate([[-np.inf], thresholds, [np.inf]])
    with np.errstate(over="ignore"):
        high, low = _sigmoid(edges[grades + 1] - scores), _sigmoid(edges[grades] - scores)
    share = np.maximum(high - low, 1e-12)
    slopes = np.zeros(len(thresholds) + 2)
    np.add.at(slopes, grades + 1, -high * (1 - high) / share)
    np.add.at(slopes, grades, low * (1 - low) / share)
    return -np.log(share).sum(), 1.0 - high - low, slopes[1:-1]


def _thresholds(free: np.ndarray) -> np.ndarray:
    """Ordered thresholds: the first, then positive gaps."""
    return np.cumsum(np.concatenate([free[:1], np.exp(free[1:])]))


def _descend(value_at: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray) -> np.ndarray:
    """Minimise by L-BFGS with step halving."""
    x = start
    value, slope = value_at(x)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(ROUNDS):
        direction, back = -slope, []
        for s, y in reversed(pairs):
            a = (s @ direction) / (s @ y)
            direction = direction - a * y
            back.append(a)
        if pairs:
            s, y = pairs[-1]
            direction = direction * ((s @ y) / (y @ y))
        else:
            direction = direction / max(1.0, np.linalg.norm(slope))
        for (s, y), a in zip(pairs, reversed(back), strict=True):
            direction = direction + s * (a - (y @ direction) / (s @ y))
        step = 1.0
        for _ in range(20):
            after, slope_after = value_at(x + step * direction)
            if after <= value + 1e-4 * step * (slope @ direction):
                break
            step /= 2
        else:
            return x
        moved, bent = step * direction, slope_after - slope
        if moved @ bent > 1e-12:
            pairs = [*pairs, (moved, bent)][-HISTORY:]
        done = value - after < 1e-5 * max(1.0, abs(value))
        x, value, slope = x + moved, after, slope_after
        if done:
            return x
    return x


def fit(docs: DataFrame, ratings: DataFrame, n_grades: int, id_col="doc_id", text_col="text", max_rows: int = MAX_ROWS) -> Model:
    """Fit on the documents that ``ratings`` (``doc_id, grade`` from 0) covers.

    At most ``max_rows`` ratings, those of smallest hash, are used. Ratings with a null id, or a grade that is
    null or outside 0..n_grades-1, are ignored; the lowest of several for one id counts. Rows are hashed in
    Spark, and each round adds up gradients over partitions; the driver holds a vector as long as the
    buckets in use. Without any usable rating every document gets the top grade.
    """
    small_batches(docs.sparkSession)
    usable = ratings.where(F.col("doc_id").isNotNull() & F.col("grade").between(0, n_grades - 1))
    rated = usable.groupBy("doc_id").agg(F.min("grade").cast("int").alias("grade"))
    chosen = saved(rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))

    @F.arrow_udf("array<int>")
    def hashed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = [np.unique(np.array([bucket(t) for t in tokens(x)], dtype=np.int32)) for x in each_text(texts)]
            yield pa.array(found, pa.list_(pa.int32()))

    pairs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(chosen, "doc_id")
    rows = saved(pairs.select("grade", hashed("text").alias("buckets")))
    by_grade = {r["grade"]: r["n"] for r in rows.groupBy("grade").agg(F.count("*").alias("n")).collect()}
    n_rows = sum(by_grade.values())
    if n_rows == 0:
        return Model(np.empty(0, np.int64), np.empty(0), np.full(n_grades - 1, -30.0))
    common = rows.select(F.explode("buckets").alias("bucket")).groupBy("bucket").count().where(F.col("count") >= max(MIN_ROWS, n_rows * MIN_SHARE))
    used = np.sort(np.array([r["bucket"] for r in common.select("bucket").collect()], dtype=np.int64))

    @F.arrow_udf("array<int>")
    def positions(buckets: pa.Array) -> pa.Array:
        held = [np.flatnonzero(np.isin(used, b.values.to_numpy(), assume_unique=True)) for b in buckets]
        return pa.array([h.astype(np.int32) for h in held], pa.list_(pa.int32()))

    rows = saved(rows.select("grade", positions("buckets").alias("at")))
    size, width = len(used), len(used) + n_grades - 1

    def value_at(point: np.ndarray) -> tuple[float, np.ndarray]:
        shared = docs.sparkSession.sparkContext.broadcast((point[:size], _thresholds(point[size:])))

        def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            weights, cuts = shared.value
            total = np.zeros(width + 1)
            for batch in batches:
                if not len(batch):
                    continue
                row = np.repeat(np.arange(len(batch)), batch["at"].map(len).to_numpy())
                at = np.concatenate(batch["at"].to_list()).astype(np.int64)
                scores = np.bincount(row, weights[at], len(batch))
                loss, by_score, by_cut = loss_and_slopes(scores, batch["grade"].to_numpy(), cuts)
                total[0] += loss
                total[1 : size + 1] += np.bincount(at, by_score[row], size)
                total[size + 1 :] += by_cut
            yield pd.DataFrame({"part": [total.tobytes()]})

        parts = [np.frombuffer(r["part"]) for r in rows.mapInPandas(part, "part binary").collect()]
        # The files that hold it on the executors go with it.
        shared.destroy()
        weights = point[:size]
        total = np.sum(parts, axis=0) / n_rows
        by_cut = total[len(used) + 1 :]
        # A gap moves every later threshold.
        free = np.array([by_cut[i:].sum() for i in range(len(by_cut))])
        free[1:] *= np.exp(point[len(used) + 1 :])
        slope = np.concatenate([total[1 : len(used) + 1] + PENALTY * weights, free])
        return total[0] + 0.5 * PENALTY * (weights @ weights), slope

    below = np.cumsum([by_grade.get(k, 0) + 1.0 for k in range(n_grades)])[:-1] / (n_rows + n_grades)
    cuts = np.log(below / (1 - below))
    start = np.concatenate([np.zeros(len(used)), cuts[:1], np.log(np.maximum(np.diff(cuts), 1e-3))])
    best = _descend(value_at, start)
    held = best[: len(used)] != 0
    return Model(used[held], best[: len(used)][held], _thresholds(best[len(used) :]))


def graded(model: Model, text: Column, wanted: int) -> Column:
    """A struct: ``grade`` (expected) and ``tail`` (probability of ``wanted`` or better)."""

    @F.arrow_udf("grade double, tail double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scores = model.scorer()
        for texts in batches:
            beyond = model.beyond(np.array([scores(t) for t in each_text(texts)]))
            yield pa.StructArray.from_arrays([pa.array(beyond.sum(axis=1)), pa.array(beyond[:, wanted - 1])], ["grade", "tail"])

    return score(text)


def grade_labels(labels: DataFrame) -> DataFrame:
    """Grades of the given labels: 0 toxic, 1 neither toxic nor good, 2 good; null where either mark is."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2)
    known = F.col("toxic").isNotNull() & F.col("quality").isNotNull()
    return labels.select("doc_id", F.when(known, grade).alias("grade"))


def grade_documents(docs: DataFrame, ratings: DataFrame, n_grades: int = 3, wanted: int = 2, least: float = LEAST, id_col="doc_id", text_col="text") -> DataFrame:
    """``(doc_id, grade, tail, selected)``: one row per document.

    ``grade`` is the expected grade, ``tail`` the probability of grade ``wanted`` or better, ``selected`` whether
    that is at least ``least``. A null or empty text is graded by its marks of style alone. Null and repeated
    ids are graded like others, each row for itself. An empty table gives no rows. Other columns are not read.
    """
    model = fit(docs, ratings, n_grades, id_col, text_col)
    found = docs.select(F.col(id_col).alias("doc_id"), graded(model, F.col(text_col), wanted).alias("found"))
    return found.select("doc_id", "found.grade", "found.tail", (F.col("found.tail") >= least).alias("selected"))


def select_documents(docs: DataFrame, ratings: DataFrame, n_grades: int = 3, wanted: int = 2, least: float = LEAST, id_col="doc_id", text_col="text") -> DataFrame:
    """The selected documents with all their columns, in one pass over the texts after fitting."""
    model = fit(docs, ratings, n_grades, id_col, text_col)
    return docs.where(graded(model, F.col(text_col), wanted)["tail"] >= least)
