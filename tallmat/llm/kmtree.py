"""Approximate nearest neighbours: a hierarchical k-means tree searched best bin first."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallmat.llm.common import saved
from tallmat.llm.crosspolytope import usable

# Vectors the tree is fitted on, and numbers in them: those of smallest hash.
SAMPLE, SAMPLE_NUMBERS = 20_000, 4_000_000
BRANCHES = 8
# The tree has about one leaf for so many rows, as long as a leaf has about so many rows of the sample.
LEAF_ROWS, LEAF_SAMPLE = 1024, 8
# Queries that calibrate the number of leaves to visit, and the share of true neighbours to be reached.
CALIBRATION, RECALL = 200, 0.95
# Rows of a leaf, and queries sent to it, that are compared in one block.
BLOCK, QUERY_BLOCK = 4096, 2048
SEED = 11


@dataclass
class Tree:
    """Nodes by number: ``centers``, the ``children`` of each (none for a leaf) and its ``leaf`` number, or -1.

    The largest inner product is sought as the smallest distance: vectors get one more coordinate that makes
    all their lengths ``longest``; queries get zero there.
    """

    centers: np.ndarray
    children: list[list[int]]
    leaf: list[int]
    longest: float

    def lifted(self, x: np.ndarray) -> np.ndarray:
        short = np.maximum(self.longest**2 - (x * x).sum(axis=1), 0.0)
        return np.hstack([x, np.sqrt(short)[:, None]])

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector: from the root to the nearest child, again and again."""
        lifted = self.lifted(x)
        at, out = np.zeros(len(x), dtype=np.int64), np.full(len(x), -1, dtype=np.int64)
        while True:
            for node in np.unique(at[out < 0]).tolist():
                rows = np.flatnonzero((at == node) & (out < 0))
                if not self.children[node]:
                    out[rows] = self.leaf[node]
                else:
                    kids = np.array(self.children[node])
                    at[rows] = kids[_squares(lifted[rows], self.centers[kids]).argmin(axis=1)]
            if (out >= 0).all():
                return out

    def visit(self, query: np.ndarray, most: int, rows: dict[int, int] | None = None, least: int = 0) -> list[int]:
        """Leaves in the order of a best-bin-first search: ``most`` of them, and more until they hold ``least`` rows.

        A priority queue holds branches not taken, by the distance of the query to their centers; the nearest
        is opened next, wherever in the tree it is. ``rows`` has the number of indexed rows of each leaf that is not empty.
        """
        lifted = np.append(query, 0.0)
        distance = ((self.centers - lifted) ** 2).sum(axis=1)
        queue, out, held = [(0.0, 0)], [], 0
        while queue and (len(out) < most or held < least):
            node = heapq.heappop(queue)[1]
            if not self.children[node]:
                out.append(self.leaf[node])
                held += rows.get(self.leaf[node], 0) if rows else 0
            for kid in self.children[node]:
                heapq.heappush(queue, (float(distance[kid]), kid))
        return out


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2.0 * (x @ y.T)


def _centers(x: np.ndarray, k: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """k-means centers, and the center of each row."""
    centers = x[rng.choice(len(x), size=k, replace=False)]
    for _ in range(12):
        near = _squares(x, centers).argmin(axis=1)
        for j in range(k):
            if (near == j).any():
                centers[j] = x[near == j].mean(axis=0)
    return centers, _squares(x, centers).argmin(axis=1)


def grow(sample: np.ndarray, leaves: int, longest: float) -> Tree:
    """A tree of about ``leaves`` leaves; the fullest leaf is split until there are so many."""
    tree = Tree(np.empty((0, 0)), [[]], [0], longest)
    x = tree.lifted(sample)
    rng = np.random.default_rng(SEED)
    centers, full = [x.mean(axis=0)], [(-len(x), 0, np.arange(len(x)))]
    open_leaves = 1
    while open_leaves < leaves and full:
        size, node, rows = heapq.heappop(full)
        k = min(BRANCHES, leaves - open_leaves + 1)
        if -size < 2 * k or len(np.unique(x[rows], axis=0)) < 2 * k:
            continue
        found, near = _centers(x[rows], k, rng)
        for j in range(k):
            if not (near == j).any():
                continue
            tree.children[node].append(len(centers))
            heapq.heappush(full, (-int((near == j).sum()), len(centers), rows[near == j]))
            centers.append(found[j])
            tree.children.append([])
        open_leaves += len(tree.children[node]) - 1
    tree.centers = np.array(centers)
    ends = [n for n, kids in enumerate(tree.children) if not kids]
    tree.leaf = [-1] * len(centers)
    for number, node in enumerate(ends):
        tree.leaf[node] = number
    return tree


def _best(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query the ``k`` rows of largest inner product, its own id left out, ties to smaller ids."""
    by_id = np.argsort(row_ids, kind="stable")
    rows, row_ids = rows[by_id], row_ids[by_id]
    for start in range(0, len(queries), 256):
        scores = queries[start : start + 256] @ rows.T
        for i, own in enumerate(scores):
            own = np.where(row_ids == query_ids[start + i], -np.inf, own)
            if len(own) > k:
                # Products of a matrix differ from single ones in the last bits; look a little further.
                floor = np.partition(own, len(own) - k)[len(own) - k]
                near = np.flatnonzero(own >= floor - 1e-9 * (1.0 + abs(floor)))
            else:
                near = np.arange(len(own))
            near = near[row_ids[near] != query_ids[start + i]]
            exact = (rows[near] * queries[start + i]).sum(axis=1)
            order = np.lexsort((row_ids[near], -exact))[:k]
            yield start + i, row_ids[near][order], exact[order]


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


BEST = "query_id long, best array<struct<loss: double, vec_id: long>>"


def _merged(found: DataFrame, k: int) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` from the best rows of each block."""
    best = F.slice(F.sort_array(F.flatten(F.collect_list("best"))), 1, k)
    each = found.groupBy("query_id").agg(best.alias("best")).select("query_id", F.posexplode("best").alias("rank", "row"))
    return each.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("row.vec_id").alias("vec_id"), (-F.col("row.loss")).alias("score"))


def _listed(query_id: int, ids: np.ndarray, scores: np.ndarray) -> tuple:
    return (query_id, [{"loss": -s, "vec_id": i} for i, s in zip(ids.tolist(), scores.tolist(), strict=True)])


def brute_force(rows: DataFrame, queries: list[tuple[int, np.ndarray]], k: int) -> DataFrame:
    """The exact answer to a few queries: every task compares what it reads with all of them."""
    query_ids = np.array([q[0] for q in queries], dtype=np.int64)
    x = np.array([q[1] for q in queries], dtype=np.float64)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                found = _best(x, query_ids, _matrix(batch["vector"]), batch["vec_id"].to_numpy(), k)
                yield pd.DataFrame([_listed(int(query_ids[q]), ids, s) for q, ids, s in found], columns=["query_id", "best"])

    return _merged(rows.select("vec_id", "vector").mapInPandas(compare, BEST), k)


def prepared(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(vec_id, vector, dim)``: the vectors that take part, one row per id, saved."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    held = rows.where(usable(F.col("vector")) & F.col("vec_id").isNotNull())
    return saved(held.groupBy("vec_id").agg(F.min("vector").alias("vector")).withColumn("dim", F.size("vector")))


def index(rows: DataFrame) -> tuple[Tree, DataFrame]:
    """A tree fitted on a bounded sample, and every row with its leaf, saved."""
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, v: s + v * v))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(length).alias("longest"), F.max("dim").alias("dim")).first()
    most = max(1, min(SAMPLE, SAMPLE_NUMBERS // size["dim"]))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(most).select("vector").collect()
    leaves = max(1, min(most // LEAF_SAMPLE, size["n"] // LEAF_ROWS))
    tree = grow(np.array([r["vector"] for r in sample], dtype=np.float64), leaves, float(size["longest"]))

    @F.pandas_udf("int")
    def leaf(vector: pd.Series) -> pd.Series:
        return pd.Series(tree.assign(_matrix(vector)).astype(np.int32) if len(vector) else np.empty(0, np.int32))

    return tree, saved(rows.select("vec_id", "vector", leaf("vector").alias("leaf")))


def calibrate(tree: Tree, placed: DataFrame, queries: DataFrame, k: int, recall: float = RECALL) -> tuple[int, float]:
    """How many leaves to visit, and the share of true neighbours that reaches.

    A bounded set of queries is answered by brute force over all rows. Visits are widened, leaf by leaf, until
    the wanted share of true neighbours lies in visited leaves.
    """
    chosen = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(CALIBRATION).select("vec_id", "vector").collect()
    asked = [(r["vec_id"], np.array(r["vector"], dtype=np.float64)) for r in chosen]
    leaves = sum(not kids for kids in tree.children)
    truth = brute_force(placed, asked, k).join(placed.select("vec_id", "leaf"), "vec_id")
    turn = {i: {leaf: n for n, leaf in enumerate(tree.visit(v, leaves))} for i, v in asked}
    turns = np.array([turn[r["query_id"]][r["leaf"]] for r in truth.select("query_id", "leaf").collect()], dtype=np.int64)
    reached = np.cumsum(np.bincount(turns, minlength=leaves)) / max(len(turns), 1)
    visits = min(leaves, int(np.searchsorted(reached, recall - 1e-12)) + 1)
    return (visits, float(reached[visits - 1])) if len(turns) else (1, 1.0)


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, recall: float = RECALL, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each query the ``k`` vectors of largest inner product found.

    The tree is fitted on a bounded sample; every row is in one of its leaves. The number of leaves to visit is
    calibrated against brute force; a query whose leaves hold fewer than ``k`` other rows goes on to further ones, so it
    gets ``k`` neighbours wherever there are so many. Leaves and the queries sent to them are cut into blocks, so one with very
    many equal vectors is spread over tasks, and a block gives one list per query. Scores are inner
    products of the vectors as given, nearest first, ties to the smaller id.

    A query's own id is no candidate. Vectors that are null, empty or zero, or hold null or non-finite
    numbers, and null ids take no part on either side. Of rows that repeat an id the smallest vector counts.
    Vectors of different lengths are searched apart. A query without candidates, and an empty table, give
    no rows. Other columns are not read.
    """
    rows = prepared(vectors, id_col, vector_col)
    asked = queries.select(F.col(id_col).cast("long").alias("vec_id")).distinct()
    out = None
    for row in sorted(rows.select("dim").distinct().collect()):
        found = _search(rows.where(F.col("dim") == row["dim"]), asked, k, recall)
        out = found if out is None else out.unionByName(found)
    empty = "query_id long, rank int, vec_id long, score double"
    return vectors.sparkSession.createDataFrame([], empty) if out is None else out


def _search(rows: DataFrame, asked: DataFrame, k: int, recall: float) -> DataFrame:
    tree, placed = index(rows)
    queries = saved(placed.join(asked, "vec_id", "left_semi").select("vec_id", "vector"))
    visits, _ = calibrate(tree, placed, queries, k, recall)
    # As many as there are leaves; a query's own row is no neighbour of it, hence one row more.
    rows_of = {r["leaf"]: r["n"] for r in placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()}

    @F.pandas_udf("array<int>")
    def leaves(vector: pd.Series) -> pd.Series:
        return pd.Series([tree.visit(np.asarray(v, dtype=np.float64), visits, rows_of, k + 1) for v in vector])

    sent = saved(queries.select(F.col("vec_id").alias("query_id"), leaves("vector").alias("leaves")))
    each = sent.select("query_id", F.explode("leaves").alias("leaf"))
    parts = saved(
        placed.groupBy("leaf")
        .agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
        .join(each.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("query_parts")), "leaf")
    )
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    candidates = placed.join(parts, "leaf").select(
        "leaf", "vec_id", "vector", F.pmod(F.xxhash64("vec_id"), "parts").cast("int").alias("part"), every("query_parts").alias("query_part")
    )
    wanted = (
        each.join(parts, "leaf")
        .select("leaf", "query_id", every("parts").alias("part"), F.pmod(F.xxhash64("query_id"), "query_parts").cast("int").alias("query_part"))
        .join(queries.select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query")), "query_id")
    )

    def compare(wanted: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(wanted) or not len(held):
            return pd.DataFrame({"query_id": [], "best": []}, dtype=object)
        ids = wanted["query_id"].to_numpy()
        found = _best(_matrix(wanted["query"]), ids, _matrix(held["vector"]), held["vec_id"].to_numpy(), k)
        return pd.DataFrame([_listed(int(ids[q]), near, s) for q, near, s in found], columns=["query_id", "best"])

    key = ["leaf", "part", "query_part"]
    return _merged(wanted.groupBy(*key).cogroup(candidates.groupBy(*key)).applyInPandas(compare, BEST), k)
