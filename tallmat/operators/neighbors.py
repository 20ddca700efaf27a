"""Nearest-neighbour graphs, and the edge weights that layout methods derive from them."""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegralType

from tallmat.operators.ordering import number_rows
from tallmat.stages import materialise

# Ship this module's functions to the executors themselves, so that these need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Rows of one distance block, whose distances are held at a time.
BLOCK = 2048
# Queries whose distances to a block of candidates are held at a time.
TILE = 1024
# Bytes of the coordinates and lists of the queries that a task holds. Points travel once per such group.
GROUP_BYTES = 64 << 20
# Groups at least, so that small tables are spread over the cores.
MIN_GROUPS = 24
# Reference points that partition the space; they and their radii are all that reaches the driver.
MAX_PIVOTS = 4096
# Approximate search: points of a leaf of a projection tree, trees, rounds of descent at most, share of changed
# neighbours at which rounds end, and the seed of the projections.
LEAF, TREES, ROUNDS, SETTLED, SEED = 512, 3, 8, 0.01, 29
# Relative slack on distance bounds, far above rounding and far below any useful difference.
SLACK = 1e-9
BISECTION_STEPS = 64


def _matrix(points: pd.Series) -> np.ndarray:
    return np.stack(points.to_numpy()).astype(np.float64) if len(points) else np.empty((0, 0))


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances between the rows of two matrices, good to rounding of their norms."""
    norms = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :]
    return np.maximum(norms - 2.0 * (x @ y.T), 0.0)


def _nearest_in_block(q: np.ndarray, c: np.ndarray, k: int, limit: np.ndarray, same: bool):
    """``(query row, candidate row, distance)`` of up to k nearest candidates, all ties at the k-th kept.

    Squared distances from a matrix product only preselect; the kept ones are computed by differences.
    """
    rough = _squares(q, c)
    scale = (q * q).sum(axis=1) + (c * c).sum(axis=1).max() + 1e-300
    if same:
        np.fill_diagonal(rough, np.inf)
    bound = np.where(np.isfinite(limit), limit, np.inf) ** 2 + SLACK * scale
    near = rough <= bound[:, None]
    if np.count_nonzero(near) > 2 * k * len(q):
        kth = np.partition(rough, min(k, c.shape[0]) - 1, axis=1)[:, min(k, c.shape[0]) - 1]
        near &= rough <= (kth + SLACK * scale)[:, None]
    if same:
        np.fill_diagonal(near, False)
    rows, cols = np.nonzero(near)
    return rows, cols, np.sqrt(((q[rows] - c[cols]) ** 2).sum(axis=1))


def _packed(x: np.ndarray) -> list[bytes]:
    """Each row's coordinates as bytes, in single precision where that holds them exactly."""
    with np.errstate(over="ignore"):
        short = x.astype(np.float32)
    exact = (short == x).all(axis=1)
    return [short[i].tobytes() if exact[i] else x[i].tobytes() for i in range(len(x))]


def _unpacked(points: pa.Array, width: int) -> np.ndarray:
    """The matrix of rows as :func:`_packed` writes them."""
    points = points.cast(pa.binary())
    ends = np.frombuffer(points.buffers()[1], np.int32)[points.offset : points.offset + len(points) + 1]
    sizes, data = np.diff(ends), points.buffers()[2]
    for kind in (np.float32, np.float64):
        size = width * np.dtype(kind).itemsize
        if (sizes == size).all():
            values = np.frombuffer(data, kind, len(points) * width, int(ends[0])) if size and len(points) else np.empty(0)
            return values.reshape(len(points), width).astype(np.float64)
    return np.array([np.frombuffer(p, np.float32 if len(p) == 4 * width else np.float64) for p in points.to_pylist()], np.float64)


class _Lists:
    """The k nearest candidates of some queries, equal distances by number, from candidates that come in blocks.

    Squared distances from a matrix product in single precision only preselect, with a margin above their error; the kept
    ones are computed by differences. Where so many candidates pass that the margin or the limits tell little, the block is
    preselected in double precision, as it is where single precision has no such numbers.
    """

    def __init__(self, number: np.ndarray, x: np.ndarray, limit: np.ndarray, k: int):
        self.number, self.x, self.limit, self.k = number, x, limit.copy(), k
        self.near = np.full((len(x), k), np.inf)
        self.other = np.full((len(x), k), np.iinfo(np.int64).max)
        self.origin = x.mean(axis=0)
        moved = x - self.origin
        self.norms = (moved * moved).sum(axis=1)
        self.error = 2.0 * (x.shape[1] + 8) * 2.0**-24
        with np.errstate(over="ignore"):
            self.single = np.hstack([-2.0 * moved, np.ones((len(x), 1))]).astype(np.float32)
        self.held: dict[int, list] = {}

    def meet(self, number: np.ndarray, y: np.ndarray, asked: np.ndarray) -> None:
        """Offer a block of candidates to the queries that are ``asked``."""
        moved = y - self.origin
        norms = (moved * moved).sum(axis=1)
        top = norms.max()
        with np.errstate(over="ignore"):
            single = np.ascontiguousarray(np.hstack([moved, norms[:, None]]).astype(np.float32).T)
        for start in range(0, len(self.x), TILE):
            some = start + np.flatnonzero(asked[start : start + TILE])
            if not len(some):
                continue
            limit, scale = self.limit[some], self.norms[some] + top
            found = None
            if scale.max() < 1e30:
                bound = limit**2 - self.norms[some] + self.error * scale + 1e-36
                passed = np.flatnonzero(self.single[some] @ single <= bound.astype(np.float32)[:, None])
                if len(passed) <= 4 * self.k * len(some):
                    rows, cols = np.divmod(passed, len(y))
                    found = rows, cols, np.sqrt(((self.x[some[rows]] - y[cols]) ** 2).sum(axis=1))
            # A query may be among the candidates, so one more is asked for.
            rows, cols, distances = found or _nearest_in_block(self.x[some], y, self.k + 1, limit, same=False)
            rows, others = some[rows], number[cols]
            good = (distances <= self.limit[rows]) & (others != self.number[rows])
            held = self.held.setdefault(start, [])
            held.append((rows[good], others[good], distances[good]))
            if 2 * sum(len(h[0]) for h in held) >= self.k * min(TILE, len(self.x) - start):
                self._merge(start)

    def _merge(self, start: int) -> None:
        """Take what the queries of a tile have met into their lists."""
        rows, others, distances = (np.concatenate(part) for part in zip(*self.held.pop(start), strict=True))
        if not len(rows):
            return
        order = np.argsort(rows, kind="stable")
        some, first, counts = np.unique(rows[order], return_index=True, return_counts=True)
        at = np.repeat(np.arange(len(some)), counts), self.k + np.arange(len(rows)) - np.repeat(first, counts)
        near = np.full((len(some), self.k + counts.max()), np.inf)
        other = np.full(near.shape, np.iinfo(np.int64).max)
        near[:, : self.k], other[:, : self.k] = self.near[some], self.other[some]
        near[at], other[at] = distances[order], others[order]
        kth = np.partition(near, self.k - 1, axis=1)[:, self.k - 1]
        kept = near <= kth[:, None]
        clear = kept.sum(axis=1) == self.k
        self.near[some[clear]] = near[clear][kept[clear]].reshape(-1, self.k)
        self.other[some[clear]] = other[clear][kept[clear]].reshape(-1, self.k)
        if not clear.all():
            near, other = near[~clear], other[~clear]
            best = np.lexsort((other, near))[:, : self.k]
            self.near[some[~clear]] = np.take_along_axis(near, best, axis=1)
            self.other[some[~clear]] = np.take_along_axis(other, best, axis=1)
        self.limit[some] = np.minimum(self.limit[some], kth)

    def batches(self) -> Iterator[pa.RecordBatch]:
        """``(number, others, distances)``: the lists from near to far, some thousand at a time."""
        for start in list(self.held):
            self._merge(start)
        for start in range(0, len(self.x), BLOCK):
            near, other = self.near[start : start + BLOCK], self.other[start : start + BLOCK]
            order = np.lexsort((other, near))
            near, other = np.take_along_axis(near, order, axis=1), np.take_along_axis(other, order, axis=1)
            there = np.isfinite(near)
            ends = pa.array(np.cumsum([0, *there.sum(axis=1)]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(v[there])) for v in (other, near)]
            yield pa.RecordBatch.from_arrays([pa.array(self.number[start : start + BLOCK]), *lists], ["number", "others", "distances"])


def _distinct_points(vectors: DataFrame, k: int, input_col: str, metric: str) -> tuple[DataFrame, DataFrame]:
    """``(cell, point)``, and ``(id, point, labels)`` saved: one row per distinct point with its first k + 1 labels."""
    vector = F.col(input_col)
    if isinstance(vectors.schema[input_col].dataType, VectorUDT):
        vector = vector_to_array(vector)
    if metric not in ("euclidean", "cosine"):
        raise ValueError(f"metric must be 'euclidean' or 'cosine', not {metric!r}")
    point = vector.cast("array<double>")
    sound = F.forall(point, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    if metric == "cosine":
        length = F.sqrt(F.aggregate(point, F.lit(0.0), lambda s, x: s + x * x))
        sound, point = sound & (length > 0), F.transform(point, lambda x: x / length)
    failed = F.raise_error(F.lit("a point is null, not finite, or zero under the cosine metric")).cast("array<double>")
    cells = vectors.select("cell", F.when(sound, point).otherwise(failed).alias("point"))

    # One row per distinct point with its first k + 1 labels; more of them can never be among the k
    # nearest of any cell. The rank limit is applied before the shuffle, so copies do not pile up.
    by_label = Window.partitionBy("point").orderBy("cell")
    firsts = cells.withColumn("number", F.row_number().over(by_label)).where(F.col("number") <= k + 1)
    points = materialise(
        firsts.groupBy("point")
        .agg(F.sort_array(F.collect_list("cell")).alias("labels"))
        .select(F.col("labels")[0].alias("id"), "point", "labels")
    )
    return cells, points


def _to_cells(cells: DataFrame, points: DataFrame, some: DataFrame, kept: DataFrame, k: int) -> DataFrame:
    """``(cell, neighbor, distance, position)`` of the cells of ``some`` points.

    ``kept`` has ``(id, other, distance)`` of the k nearest other points of these.
    """
    # Back to cells: the k + 1 nearest labels of a point, its own among them, serve all its copies.
    labels = points.select(F.col("id").alias("other"), "labels")
    near = kept.join(labels, "other").select("id", "distance", F.explode("labels").alias("neighbor"))
    own = some.select("id", F.lit(0.0).alias("distance"), F.explode("labels").alias("neighbor"))
    by_distance = Window.partitionBy("id").orderBy("distance", "neighbor")
    lists = (
        near.unionByName(own)
        .withColumn("number", F.row_number().over(by_distance))
        .where(F.col("number") <= k + 1)
        .groupBy("id")
        .agg(F.sort_array(F.collect_list(F.struct("distance", "neighbor"))).alias("nearest"))
    )
    per_point = some.select("id", "point").join(lists, "id").select("point", "nearest")
    others = F.slice(F.filter("nearest", lambda e: e["neighbor"] != F.col("cell")), 1, k)
    entries = cells.join(per_point, "point").select("cell", F.posexplode(others).alias("position", "entry"))
    return entries.select("cell", "entry.neighbor", "entry.distance", "position")


def _saved_graph(entries: DataFrame, metric: str) -> DataFrame:
    """The graph from ``(cell, neighbor, distance, position)``, saved, as callers use it more than once."""
    distance = F.col("distance")
    if metric == "cosine":
        distance = distance * distance / 2
    return materialise(entries.select("cell", "neighbor", distance.alias("distance"), (F.col("position") + 1).alias("rank")))


def _walk(centers: np.ndarray) -> np.ndarray:
    """An order of the pivots in which neighbours lie together: from each to the nearest one not yet passed."""
    left, order = np.ones(len(centers), dtype=bool), [0]
    left[0] = False
    while left.any():
        far = ((centers - centers[order[-1]]) ** 2).sum(axis=1)
        order.append(int(np.where(left, far, np.inf).argmin()))
        left[order[-1]] = False
    return np.array(order)


def knn_graph(
    vectors: DataFrame, k: int = 15, input_col: str = "features", block: int = BLOCK, metric: str = "euclidean"
) -> DataFrame:
    """``(cell, neighbor, distance, rank)``: the exact k nearest other cells, as a saved table.

    ``metric='cosine'`` gives ``1 - cosine``, which orders like the Euclidean distance of vectors of length 1;
    a zero vector has no direction and fails. So does a null or non-finite coordinate.

    Equal distances go by label, and a cell gets fewer than k rows only where fewer others exist.

    The search never pairs all cells. Points are assigned to the nearest of up to a few thousand pivots; a
    first look within one block gives every point an upper bound on its k-th distance; the point is
    then compared only with partitions that can hold something nearer (triangle inequality and the
    separating plane), as far as its bound, which sinks with every block, still lets it. Neighbouring partitions lie
    together in groups. A task holds the queries of one group, bounded in bytes, and reads the partitions that any of them must
    meet as a stream, nearest groups first; so its memory does not depend on the number of points, however many lie close
    together, and a list leaves it once, complete. Identical points are searched once, whatever their number.
    """
    spark = vectors.sparkSession
    cells, points = _distinct_points(vectors, k, input_col, metric)
    n_points = points.count()
    n_pivots = max(1, min(MAX_PIVOTS, math.ceil(n_points / block)))
    sample = points.select("point").orderBy(F.xxhash64("point"), "id").limit(n_pivots).collect()
    if not sample:
        return spark.createDataFrame([], _graph_schema(vectors))
    pivots = np.array([row["point"] for row in sample], dtype=np.float64)
    width = pivots.shape[1]

    @F.pandas_udf("struct<pivot int, radius double, point binary>")
    def assign(point: pd.Series) -> pd.DataFrame:
        x = _matrix(point)
        if len(x) and x.shape[1] != width:
            raise ValueError("points differ in their number of coordinates")
        pivot = _squares(x, pivots).argmin(axis=1)
        radius = np.sqrt(((x - pivots[pivot]) ** 2).sum(axis=1))
        return pd.DataFrame({"pivot": pivot.astype("int32"), "radius": radius, "point": _packed(x)})

    # Whole numbers stand for labels in the search, in their order, by which equal distances go.
    numeric = isinstance(points.schema["id"].dataType, IntegralType)
    if numeric:
        numbered = points.withColumn("number", F.col("id").cast("long"))
    else:
        names = number_rows(points.select("id").distinct(), F.col("id"))
        numbered = points.join(names, "id")
    assigned = materialise(numbered.select("number", assign("point").alias("at")).select("number", "at.*"))
    # One row per pivot.
    summary = (
        assigned.groupBy("pivot")
        .agg(F.count(F.lit(1)).alias("n"), F.min("radius").alias("low"), F.max("radius").alias("high"))
        .orderBy("pivot")
        .collect()
    )
    occupied = np.array([row["pivot"] for row in summary])
    low = np.array([row["low"] for row in summary])
    high = np.array([row["high"] for row in summary])
    centers = pivots[occupied]
    # Partitions in the order of a walk from pivot to nearest pivot, cut into groups of about equal size.
    group_rows = max(block, GROUP_BYTES // (8 * max(1, width) + 16 * k))
    n_groups = max(math.ceil(n_points / group_rows), min(MIN_GROUPS, math.ceil(n_points / block)))
    group_rows = math.ceil(n_points / n_groups)
    sizes = np.array([row["n"] for row in summary])
    blocks = -(-sizes // block)
    walk = _walk(centers)
    begins = np.empty(len(walk), dtype=np.int64)
    begins[walk] = np.cumsum(sizes[walk]) - sizes[walk]
    places = F.broadcast(
        spark.createDataFrame(
            [tuple(map(int, x)) for x in zip(occupied, blocks, sizes, begins)], "pivot int, parts int, n long, begin long"
        )
    )
    part = F.pmod(F.xxhash64("number", "point"), "parts")
    group = F.floor((F.col("begin") + F.floor(F.col("part") * F.col("n") / F.col("parts"))) / group_rows)
    placed = (
        assigned.drop("radius").join(places, "pivot").withColumn("part", part.cast("int")).withColumn("group", group.cast("int"))
    )

    def reach(x: np.ndarray, pivot: np.ndarray, limit: np.ndarray, some) -> np.ndarray:
        """Which of ``some`` partitions each point must meet."""
        own, there = centers[np.searchsorted(occupied, pivot)], centers[some]
        squares = _squares(x, there)
        error = SLACK * ((x * x).sum(axis=1)[:, None] + (there * there).sum(axis=1)[None, :] + 1e-300)
        below, above = np.sqrt(np.maximum(squares - error, 0.0)), np.sqrt(squares + error)
        # No point of a partition is nearer than the triangle inequality and the plane halfway
        # between its pivot and the point's own allow.
        to_own = ((x - own) ** 2).sum(axis=1)[:, None]
        gap = np.sqrt(_squares(own, there) + error)
        plane = (squares - to_own - 2.0 * error) / (2.0 * gap)
        nearest = np.maximum.reduce([below - high[some], low[some] - above, plane])
        return nearest * (1.0 - SLACK) <= limit[:, None]

    # Upper bound on the k-th distance, from the point's own block; the block's first row has the partitions it must meet.
    def bound(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        x, pivot = _unpacked(rows["point"].chunk(0), width), rows["pivot"].to_numpy()
        limit = np.full(len(x), np.inf)
        if len(x) > k:
            for start in range(0, len(x), TILE):
                tile = slice(start, start + TILE)
                squares = _squares(x[tile], x)
                squares[np.arange(len(squares)), start + np.arange(len(squares))] = np.inf
                kth = np.partition(squares, k - 1, axis=1)[:, k - 1]
                norms = (x * x).sum(axis=1)
                limit[tile] = np.sqrt(kth + SLACK * (norms[tile] + norms.max() + 1e-300))
        met = np.zeros(len(centers), dtype=bool)
        # In slices, as each row has a number for every pivot in several arrays.
        step = max(1, 2_000_000 // len(centers))
        for start in range(0, len(x), step):
            some = slice(start, start + step)
            met |= reach(x[some], pivot[some], limit[some], slice(None)).any(axis=0)
        meets = pa.array([occupied[met].astype(np.int32), *[None] * (len(x) - 1)], pa.list_(pa.int32()))
        return rows.select(["number", "point", "pivot", "group"]).append_column("limit", pa.array(limit)).append_column("meets", meets)

    aimed = materialise(
        placed.groupBy("pivot", "part").applyInArrow(
            bound, "number long, point binary, pivot int, group int, limit double, meets array<int>"
        )
    )
    # At most one row per group and pivot.
    meetings = aimed.select(F.col("group").alias("target"), F.explode("meets").alias("pivot")).distinct()
    if n_groups * len(centers) <= 100_000:
        meetings = F.broadcast(meetings)
    # Queries of a group come first, then candidates, from the nearest groups of the walk outwards.
    turn = F.abs(F.col("group") - F.col("target"))
    offered = aimed.join(meetings, "pivot").select("target", turn.alias("turn"), "pivot", "number", F.lit(None).cast("double").alias("limit"), "point")
    asking = aimed.select(F.col("group").alias("target"), F.lit(-1).alias("turn"), "pivot", "number", "limit", "point")
    streams = asking.unionByName(offered).repartitionById(n_groups, "target").sortWithinPartitions("target", "turn", "pivot")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, lists, pivot, queries, waiting, rows = None, None, None, [], [], 0

        def offer() -> None:
            nonlocal rows
            if not waiting:
                return
            there, number, y = (np.concatenate(v) for v in zip(*waiting, strict=True))
            waiting.clear()
            rows = 0
            for start in range(0, len(y), block):
                some = slice(start, start + block)
                at = np.searchsorted(occupied, np.unique(there[some]))
                asked = np.concatenate(
                    [
                        reach(lists.x[a : a + BLOCK], pivot[a : a + BLOCK], lists.limit[a : a + BLOCK], at).any(axis=1)
                        for a in range(0, len(lists.x), BLOCK)
                    ]
                )
                lists.meet(number[some], y[some], asked)

        for batch in batches:
            goal, asks = batch["target"].to_numpy(), batch["turn"].to_numpy() < 0
            cuts = np.flatnonzero((goal[1:] != goal[:-1]) | (asks[1:] != asks[:-1])) + 1
            for start, stop in zip([0, *cuts], [*cuts, len(goal)], strict=True):
                if start == stop:
                    continue
                piece = batch.slice(start, stop - start)
                x, number, home = _unpacked(piece["point"], width), piece["number"].to_numpy(), piece["pivot"].to_numpy()
                if asks[start]:
                    if lists is not None:
                        offer()
                        yield from lists.batches()
                        lists = None
                    queries.append((home, number, piece["limit"].to_numpy(), x))
                    continue
                if lists is None:
                    pivot, ids, limit, own = (np.concatenate(v) for v in zip(*queries, strict=True))
                    queries.clear()
                    lists = _Lists(ids, own, limit, k)
                waiting.append((home, number, x))
                rows += len(x)
                if rows >= block:
                    offer()
        if lists is not None:
            offer()
            yield from lists.batches()

    lists = streams.mapInArrow(search, "number long, others array<long>, distances array<double>")

    def kept(lists: DataFrame) -> DataFrame:
        """``(id, other, distance)``: lists as rows with labels; points that share one have a list together."""
        rows = lists.select("number", F.explode(F.arrays_zip("others", "distances")).alias("entry"))
        rows = rows.select("number", F.col("entry.others").alias("to"), F.col("entry.distances").alias("distance"))
        if numeric:
            named = rows.select(F.col("number").alias("id"), F.col("to").alias("other"), "distance")
        else:
            ends = (names.select(F.col("id").alias(c), F.col("number").alias(n)) for c, n in (("id", "number"), ("other", "to")))
            named = rows.join(next(ends), "number").join(next(ends), "to").select("id", "other", "distance")
        nearest = Window.partitionBy("id").orderBy("distance", "other")
        return named.withColumn("place", F.row_number().over(nearest)).where(F.col("place") <= k).drop("place")

    if not numeric:
        return _saved_graph(_to_cells(cells, points, points, kept(lists), k), metric)
    # A point of one cell, whose label no other point has, is that cell, and so are its neighbours if all are such.
    odd = materialise(
        points.groupBy(F.col("id").cast("long").alias("number"))
        .agg(F.count(F.lit(1)).alias("n"), F.max(F.size("labels")).alias("most"))
        .where("n > 1 OR most > 1")
        .select("number")
    )
    some = None
    if odd.limit(1).count():
        lists = materialise(lists)
        near_odd = lists.select("number", F.explode("others").alias("to")).join(odd.select(F.col("number").alias("to")), "to", "left_semi")
        some = materialise(near_odd.select("number").unionByName(odd).distinct())
    plain = lists.join(some, "number", "left_anti") if some else lists
    label = vectors.schema["cell"].dataType
    entries = plain.select("number", F.posexplode(F.arrays_zip("others", "distances")).alias("position", "entry")).select(
        F.col("number").cast(label).alias("cell"),
        F.col("entry.others").cast(label).alias("neighbor"),
        F.col("entry.distances").alias("distance"),
        "position",
    )
    if some:
        theirs = points.join(some, F.col("id").cast("long") == F.col("number"), "left_semi")
        found = kept(lists.join(some, "number", "left_semi"))
        entries = entries.unionByName(_to_cells(cells, points, theirs, found, k))
    return _saved_graph(entries, metric)


def _leaves(points: DataFrame, n_points: int) -> DataFrame:
    """``(pid, tree, leaf)``, saved: every point in a leaf of about ``LEAF`` points of each tree.

    A tree halves its nodes at the median of a random projection, level by level; what travels are projections and
    medians, never points, and all nodes of a level are halved in one aggregation.
    """
    levels = max(0, math.ceil(math.log2(max(1, n_points) / LEAF)))
    if not levels:
        return materialise(points.select("pid", F.lit(0).alias("tree"), F.lit(1).cast("long").alias("leaf")))

    @F.pandas_udf("array<array<double>>")
    def projections(point: pd.Series) -> pd.Series:
        x = _matrix(point)
        directions = np.random.default_rng(SEED).normal(size=(x.shape[1], TREES * levels)) if len(x) else np.empty((0, 0))
        return pd.Series([list(row) for row in (x @ directions).reshape(len(x), TREES, levels)] if len(x) else [])

    # In one table of scalars per tree and point, so that points are read once.
    rows = materialise(points.select("pid", F.posexplode(projections("point")).alias("tree", "at")).withColumn("leaf", F.lit(1).cast("long")))
    for level in range(levels):
        here = F.col("at")[level]
        halves = rows.groupBy("tree", "leaf").agg(F.percentile_approx(here, 0.5, 1000).alias("middle"))
        rows = materialise(
            rows.join(halves, ["tree", "leaf"]).select("pid", "tree", "at", (F.col("leaf") * 2 + (here > F.col("middle")).cast("long")).alias("leaf"))
        )
    return rows.select("pid", "tree", "leaf")


def _best(rows: np.ndarray, cols: np.ndarray, squares: np.ndarray, size: int) -> np.ndarray:
    """Places of the ``size`` smallest squares of every row, a repeated pair once."""
    order = np.lexsort((cols, squares, rows))
    rows, cols = rows[order], cols[order]
    first = np.ones(len(rows), dtype=bool)
    first[1:] = (rows[1:] != rows[:-1]) | (cols[1:] != cols[:-1])
    order, rows = order[first], rows[first]
    return order[np.arange(len(rows)) - np.searchsorted(rows, rows) < size]


def _pairs(pid: np.ndarray, x: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> pd.DataFrame:
    """Pairs with their distances, computed by differences in slices."""
    distance = np.empty(len(rows))
    for start in range(0, len(rows), 1 << 16):
        part = slice(start, start + (1 << 16))
        distance[part] = np.sqrt(((x[rows[part]] - x[cols[part]]) ** 2).sum(axis=1))
    return pd.DataFrame({"src": pid[rows], "dst": pid[cols], "distance": distance})


def _merged(graph: DataFrame | None, found: DataFrame, size: int) -> DataFrame:
    """``(src, dst, distance, new)``, saved: the ``size`` nearest of both; ``new`` are those that ``graph`` did not hold."""
    rows = found.select("src", "dst", "distance", F.lit(True).alias("new"))
    if graph is not None:
        rows = graph.select("src", "dst", "distance", F.lit(False).alias("new")).unionByName(rows)
    once = rows.groupBy("src", "dst").agg(F.min("distance").alias("distance"), F.min("new").alias("new"))
    nearest = Window.partitionBy("src").orderBy("distance", "dst")
    return materialise(once.withColumn("number", F.row_number().over(nearest)).where(F.col("number") <= size).drop("number"))


def knn_approx(
    vectors: DataFrame, k: int = 15, input_col: str = "features", metric: str = "euclidean", list_size: int | None = None, rounds: int = ROUNDS
) -> DataFrame:
    """``(cell, neighbor, distance, rank)``: about the k nearest other cells, as a saved table, in near-linear work.

    Leaves of a few random projection trees, compared whole, give every point a first list of ``list_size`` neighbours
    (``2 k``, 30 at least). Then rounds of neighbour descent: all points on the list of a point, or with it on theirs, meet
    each other, unless they met there before, and enter lists that they improve; lists twice as long as asked for
    reach most of the true neighbours. Rounds end when less than one in a hundred listed neighbours changed, or after
    ``rounds``. A point takes part in the lists of so many others at most as a list is long (smallest hash first), so that
    points near everything gather nothing.

    Points of a leaf are handled as one block, whose size does not depend on the data but for ties of projections;
    a point travels to the blocks that list it. Distances are exact, copies are searched once, and tables of up to
    ``LEAF`` distinct points are searched exactly. Nulls, metrics and small tables are as in :func:`knn_graph`.
    """
    spark = vectors.sparkSession
    size = list_size or max(2 * k, 30)
    cells, points = _distinct_points(vectors, k, input_col, metric)
    # Numbered once and saved, so that the numbers stay.
    points = materialise(points.withColumn("pid", F.monotonically_increasing_id()))
    n_points = points.count()
    if not n_points:
        return spark.createDataFrame([], _graph_schema(vectors))
    leaves = _leaves(points, n_points)
    pair = "src long, dst long, distance double"

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        x, pid = _matrix(rows["point"]), rows["pid"].to_numpy()
        squares = _squares(x, x)
        np.fill_diagonal(squares, np.inf)
        few = min(size, len(x) - 1)
        if not few:
            return _pairs(pid, x, np.empty(0, np.int64), np.empty(0, np.int64))
        near = np.argpartition(squares, few - 1, axis=1)[:, :few]
        return _pairs(pid, x, np.repeat(np.arange(len(x)), few), near.ravel())

    located = points.select("pid", "point")
    graph = _merged(None, leaves.join(located, "pid").groupBy("tree", "leaf").applyInPandas(compare, pair), size)
    homes = materialise(leaves.where("tree = 0").select(F.col("pid").alias("mid"), F.col("leaf").alias("block")))

    def meet(members: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if members.empty:
            return pd.DataFrame({"src": [], "dst": [], "distance": []})
        order = np.argsort(known["pid"].to_numpy())
        pid, limit = known["pid"].to_numpy()[order], known["farthest"].to_numpy()[order] ** 2
        x = _matrix(known["point"].iloc[order])
        lists = [np.asarray(v, dtype=np.int64) for v in known["listed"].iloc[order]]
        members = members.sort_values("mid")
        at, fresh = np.searchsorted(pid, members["member"].to_numpy()), members["new"].to_numpy()
        bounds = np.flatnonzero(np.diff(members["mid"].to_numpy(), prepend=-1, append=-1))
        rows, cols, squares, held = [], [], [], 0

        def shrink() -> None:
            r, c, s = np.concatenate(rows), np.concatenate(cols), np.concatenate(squares)
            best = _best(r, c, s, size)
            rows[:], cols[:], squares[:] = [r[best]], [c[best]], [s[best]]

        for start, stop in zip(bounds[:-1], bounds[1:], strict=True):
            who, recent = at[start:stop], fresh[start:stop]
            if recent.any():
                apart = _squares(x[who], x[who])
                np.fill_diagonal(apart, np.inf)
                a, b = np.nonzero((apart < limit[who][:, None]) & (recent[:, None] | recent[None, :]))
                rows.append(who[a])
                cols.append(who[b])
                squares.append(apart[a, b])
                held += len(a)
                if held > 2_000_000:
                    shrink()
                    held = 0
        if not rows:
            return pd.DataFrame({"src": [], "dst": [], "distance": []})
        shrink()
        r, c = rows[0], cols[0]
        # What a list holds already is no news.
        span = len(pid)
        old_rows = np.repeat(np.arange(span), [len(v) for v in lists])
        old = np.concatenate(lists) if lists else np.empty(0, np.int64)
        places = np.minimum(np.searchsorted(pid, old), span - 1)
        here = pid[places] == old
        news = ~np.isin(r * span + c, old_rows[here] * span + places[here])
        return _pairs(pid, x, r[news], c[news])

    for _ in range(rounds if n_points > LEAF else 0):
        by_hash = Window.partitionBy("dst").orderBy(F.xxhash64("src", "dst"))
        back = graph.withColumn("number", F.row_number().over(by_hash)).where(F.col("number") <= size)
        both = graph.select(F.col("src").alias("mid"), F.col("dst").alias("member"), "new").unionByName(
            back.select(F.col("dst").alias("mid"), F.col("src").alias("member"), "new")
        )
        members = materialise(both.groupBy("mid", "member").agg(F.max("new").alias("new")).join(homes, "mid"))
        lists = graph.groupBy(F.col("src").alias("pid")).agg(
            F.when(F.count(F.lit(1)) >= size, F.max("distance")).otherwise(F.lit(float("inf"))).alias("farthest"),
            F.collect_list("dst").alias("listed"),
        )
        known = members.select(F.col("block").alias("home"), F.col("member").alias("pid")).distinct().join(located, "pid").join(lists, "pid")
        found = members.groupBy("block").cogroup(known.groupBy("home")).applyInPandas(meet, pair)
        graph = _merged(graph, found, size)
        if graph.where("new").count() < SETTLED * n_points * min(size, n_points - 1):
            break
    nearest = Window.partitionBy("src").orderBy("distance", "dst")
    kept = graph.withColumn("number", F.row_number().over(nearest)).where(F.col("number") <= k)
    names = points.select("pid", "id")
    named = kept.join(names.toDF("src", "id"), "src").join(names.toDF("dst", "other"), "dst").select("id", "other", "distance")
    points = points.select("id", "point", "labels")
    return _saved_graph(_to_cells(cells, points, points, named, k), metric)


def _graph_schema(vectors: DataFrame) -> str:
    cell = vectors.schema["cell"].dataType.simpleString()
    return f"cell {cell}, neighbor {cell}, distance double, rank int"


def _bisect(evaluate: Callable[[np.ndarray], np.ndarray], target: np.ndarray, rises: bool) -> np.ndarray:
    """Per row, the positive argument at which a monotone function meets its target."""
    low, high, at = np.zeros_like(target), np.full_like(target, np.inf), np.ones_like(target)
    for _ in range(BISECTION_STEPS):
        value = evaluate(at)
        too_large = value > target if rises else value < target
        low, high = np.where(too_large, low, at), np.where(too_large, at, high)
        at = np.where(np.isinf(high), at * 2.0, (low + np.where(np.isinf(high), 0.0, high)) / 2.0)
    return at


def _padded(lists: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Ragged lists as a matrix, missing places infinite, and their lengths."""
    sizes = lists.map(len).to_numpy()
    matrix = np.full((len(lists), max(1, sizes.max(initial=1))), np.inf)
    matrix[np.arange(matrix.shape[1])[None, :] < sizes[:, None]] = np.concatenate(lists.to_numpy()) if len(lists) else []
    return matrix, sizes


def _trimmed(matrix: np.ndarray, sizes: np.ndarray) -> pd.Series:
    return pd.Series([row[:size] for row, size in zip(matrix, sizes)])


@F.pandas_udf(ArrayType(DoubleType()))
def _fuzzy(distances: pd.Series) -> pd.Series:
    d, sizes = _padded(distances)
    rho = np.where(d > 0, d, np.inf).min(axis=1)
    beyond = np.maximum(d - np.where(np.isinf(rho), 0.0, rho)[:, None], 0.0)
    sigma = _bisect(lambda s: np.exp(-beyond / s[:, None]).sum(axis=1), np.log2(sizes), rises=True)
    return _trimmed(np.exp(-beyond / sigma[:, None]), sizes)


def _affinity(perplexity: float):
    @F.pandas_udf(ArrayType(DoubleType()))
    def affinity(distances: pd.Series) -> pd.Series:
        d, sizes = _padded(distances)
        beyond = d * d - (d * d).min(axis=1)[:, None]
        finite = np.where(np.isinf(beyond), 0.0, beyond)

        def entropy(beta: np.ndarray) -> np.ndarray:
            # With z = sum exp(-beta d), entropy = log2 z + beta * sum(d exp(-beta d)) / (z ln 2).
            w = np.exp(-beta[:, None] * beyond)
            z = w.sum(axis=1)
            return np.log2(z) + beta * (finite * w).sum(axis=1) / (z * math.log(2.0))

        beta = _bisect(entropy, np.full(len(d), math.log2(perplexity)), rises=False)
        w = np.exp(-beta[:, None] * beyond)
        return _trimmed(w / w.sum(axis=1)[:, None], sizes)

    return affinity


def _weighted_edges(knn: DataFrame, weight, name: str) -> DataFrame:
    """Apply a function of a cell's distances (at most k of them) to its list of edges."""
    edge = F.struct("distance", "neighbor")
    lists = knn.groupBy("cell").agg(F.sort_array(F.collect_list(edge)).alias("edges"))
    weighted = lists.select("cell", "edges", weight(F.col("edges.distance")).alias(name))
    zipped = F.explode(F.arrays_zip(F.col("edges.neighbor").alias("neighbor"), F.col(name)))
    return weighted.select("cell", zipped.alias("edge")).select(
        "cell", F.col("edge")["neighbor"].alias("neighbor"), F.col("edge")[name].alias(name)
    )


def fuzzy_weights(knn: DataFrame) -> DataFrame:
    """``(cell, neighbor, weight)``: directed membership strengths ``exp(-max(0, d - rho) / sigma)``.

    ``rho`` is the distance to the nearest neighbour that is not a copy; ``sigma`` is chosen so that the
    weights of a cell add up to log2 of its number of neighbours. Where more than that many neighbours
    lie within ``rho`` no sigma exists and it tends to 0.
    """
    return _weighted_edges(knn, _fuzzy, "weight")


def fuzzy_graph(knn: DataFrame) -> DataFrame:
    """``(cell, neighbor, weight)``: the symmetric fuzzy union ``a + b - a * b`` of both directions."""
    union = F.col("out") + F.col("back") - F.col("out") * F.col("back")
    return _both_ways(fuzzy_weights(knn), "weight").select("cell", "neighbor", union.alias("weight"))


def conditional_affinities(knn: DataFrame, perplexity: float = 30) -> DataFrame:
    """``(cell, neighbor, p)``: ``p(j|i)`` proportional to ``exp(-beta * d^2)``, with the given perplexity.

    The sum over the neighbours of a cell is 1. Three times as many neighbours as the perplexity are
    customary; with fewer neighbours than the perplexity it cannot be reached and beta tends to 0.
    """
    return _weighted_edges(knn, _affinity(perplexity), "p")


def _both_ways(directed: DataFrame, weight: str) -> DataFrame:
    """``(cell, neighbor, out, back)``: each edge with its weight and that of its reverse, 0 where absent."""
    # Added up per pair of ends, and laid out both ways afterwards, so an edge is one row on its way.
    cell, neighbor, zero = F.col("cell"), F.col("neighbor"), F.lit(0.0)
    ahead = F.coalesce(cell <= neighbor, cell.isNull())
    pairs = (
        directed.select(
            F.when(ahead, cell).otherwise(neighbor).alias("a"),
            F.when(ahead, neighbor).otherwise(cell).alias("b"),
            F.when(ahead, F.col(weight)).otherwise(zero).alias("ab"),
            F.when(ahead, zero).otherwise(F.col(weight)).alias("ba"),
        )
        .groupBy("a", "b")
        .agg(F.sum("ab").alias("ab"), F.sum("ba").alias("ba"))
    )

    def row(start: str, end: str, out: str, back: str) -> Column:
        return F.struct(F.col(start).alias("cell"), F.col(end).alias("neighbor"), F.col(out).alias("out"), F.col(back).alias("back"))

    ends = F.when(F.col("a").eqNullSafe(F.col("b")), F.array(row("a", "b", "ab", "ab"))).otherwise(
        F.array(row("a", "b", "ab", "ba"), row("b", "a", "ba", "ab"))
    )
    return pairs.select(F.explode(ends).alias("end")).select("end.*")


def perplexity_affinities(knn: DataFrame, perplexity: float = 30) -> DataFrame:
    """``(cell, neighbor, p)``: symmetric affinities ``(p(j|i) + p(i|j)) / 2n``, adding up to 1."""
    directed = conditional_affinities(knn, perplexity)
    n = knn.agg(F.count_distinct("cell")).scalar()
    return _both_ways(directed, "p").select(
        "cell", "neighbor", ((F.col("out") + F.col("back")) / (2 * n)).alias("p")
    )
