"""Near-duplicate vectors by cross-polytope hashing with multiprobe, verified by cosine."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallmat.llm.common import saved
from tallmat.llm.components import components

LEAST = 0.98
# Tables, rotations hashed together in each, and buckets probed in each. Recall is measured in the tests.
TABLES, HASHES, PROBES = 4, 2, 6
ROUNDS = 3
SEED = 20
# Rows of a bucket that are compared in one block.
BLOCK = 1024


def usable(vector: Column) -> Column:
    """Whether a vector is neither null nor zero and holds finite numbers only."""
    infinity = float("inf")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinity))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _signs(width: int, tables: int, hashes: int) -> np.ndarray:
    rng = np.random.default_rng([SEED, width])
    return rng.choice(np.array([-1.0, 1.0]), size=(tables, hashes, ROUNDS, width))


def _hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row."""
    half, width = 1, x.shape[1]
    while half < width:
        x = x.reshape(-1, width // (2 * half), 2, half)
        x = np.concatenate([x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]], axis=2).reshape(-1, width)
        half *= 2
    return x / np.sqrt(width)


def units(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1, safe for very large and very small entries."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def probes(x: np.ndarray, tables: int = TABLES, hashes: int = HASHES, n_probes: int = PROBES) -> np.ndarray:
    """Buckets of unit vectors, shape (rows, tables, probes), each row's own bucket first.

    A rotation is three rounds of random signs and a Hadamard transform. Its hash is the nearest of the 2d
    signed axes. A table joins the hashes of several rotations; further probes replace one axis by the next
    nearest, those that lose least first.
    """
    n, dim = x.shape
    width = 1 << max(1, (dim - 1).bit_length())
    padded = np.zeros((n, width))
    padded[:, :dim] = x
    signs = _signs(width, tables, hashes)
    out = np.zeros((n, tables, n_probes), dtype=np.int64)
    deep = min(n_probes, width)
    for t in range(tables):
        axes, losses = [], []
        for h in range(hashes):
            y = padded
            for r in range(ROUNDS):
                y = _hadamard(y * signs[t, h, r])
            size = np.abs(y)
            order = np.argsort(-size, axis=1, kind="stable")[:, :deep]
            held = np.take_along_axis(size, order, axis=1)
            axes.append(2 * order + (np.take_along_axis(y, order, axis=1) < 0))
            losses.append(held[:, :1] ** 2 - held**2)
        own = np.zeros(n, dtype=np.int64)
        for a in axes:
            own = own * 2 * width + a[:, 0]
        moved = [(axes[h][:, 1:] - axes[h][:, :1]) * (2 * width) ** (hashes - 1 - h) for h in range(hashes)]
        change, loss = np.concatenate(moved, axis=1), np.concatenate([lo[:, 1:] for lo in losses], axis=1)
        best = np.argsort(loss, axis=1, kind="stable")[:, : n_probes - 1]
        out[:, t, :] = own[:, None]
        out[:, t, 1 : best.shape[1] + 1] = own[:, None] + np.take_along_axis(change, best, axis=1)
    return out


def _first_met(a: np.ndarray, b: np.ndarray, at: int, bucket: int) -> np.ndarray:
    """Whether pairs meet for the first time in this table and bucket.

    A pair meets in a table where the own bucket of one is among the probes of the other: there or, if both
    hold, in the smaller of the two.
    """
    at_a = (b == a[:, :, :1]).any(axis=2)
    at_b = (a == b[:, :, :1]).any(axis=2)
    met = at_a | at_b
    own_a, own_b = a[:, at, 0], b[:, at, 0]
    place = np.where(at_a[:, at] & at_b[:, at], np.minimum(own_a, own_b), np.where(at_a[:, at], own_a, own_b))
    return met[:, at] & (place == bucket) & ~met[:, :at].any(axis=1)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n rows the smallest row it reaches by the links (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        after = root.copy()
        np.minimum.at(after, a, low)
        np.minimum.at(after, b, low)
        after = after[after]
        if np.array_equal(after, root):
            return root
        root = after


def _compared(rows: pd.DataFrame, least: float) -> pd.DataFrame:
    """Links of each node and its smallest reachable node, within one pair of blocks of one bucket.

    Rows are compared in slices, so no list of all pairs is ever held.
    """
    rows = rows.sort_values("node", kind="stable", ignore_index=True)
    at, bucket, left, right = (int(rows[c].iloc[0]) for c in ("at", "bucket", "left", "right"))
    x = units(np.stack(rows["vector"].to_numpy()).astype(np.float64))
    places = np.stack(rows["places"].to_numpy()).reshape(len(rows), TABLES, PROBES)
    weight, part = rows["n"].to_numpy(), rows["part"].to_numpy()
    links, ends_a, ends_b = np.zeros(len(rows), dtype=np.int64), [], []
    root = np.arange(len(rows))
    step = max(1, 200_000 // len(rows))
    for start in range(0, len(rows), step):
        cosine = x[start : start + step] @ x.T
        a, b = np.nonzero(cosine >= least)
        a = a + start
        apart = (a < b) if left == right else (part[a] == left) & (part[b] == right)
        a, b = a[apart], b[apart]
        first = np.concatenate([_first_met(places[a[i : i + 20_000]], places[b[i : i + 20_000]], at, bucket) for i in range(0, max(len(a), 1), 20_000)])
        a, b = a[first], b[first]
        np.add.at(links, a, weight[b])
        np.add.at(links, b, weight[a])
        if len(a):
            # What is known to hang together is kept as one link per row.
            own = np.flatnonzero(root != np.arange(len(rows)))
            root = _roots(len(rows), np.concatenate([a, own]), np.concatenate([b, root[own]]))
    node = rows["node"].to_numpy()
    hit = links > 0
    return pd.DataFrame({"class": rows["class"].to_numpy()[hit], "links": links[hit], "node": node[hit], "root": node[root[hit]]})


def near_duplicates(vectors: DataFrame, least: float = LEAST, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``: one row per vector.

    Vectors link if their labels are equal and not null and their cosine, in double precision, is at least
    ``least``; of those links the ones that share a probed bucket in some table are found, and none below.
    ``n_links`` counts linked vectors, ``component_id`` is the smallest id reachable.

    Equal vectors of a label are one node with a count, whatever their number. Buckets are found on keys alone;
    only rows whose bucket holds another row are joined with their vectors. A large bucket is cut into blocks,
    every pair of blocks is a group of its own, and what leaves a group is one row per vector: a count, and one
    link that keeps the components. Counting the links of near-equal but different vectors compares all of
    them, which no bucket can avoid.

    Vectors that are null, empty or zero or hold null or non-finite numbers, and those with a null label or id,
    link with nothing; they are their own component. Vectors of different lengths do not link. Rows that
    repeat an id are one node where they link. An empty table gives no rows. Other columns are not read.
    """
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.col(label_col).alias("label"),
        F.col(vector_col).cast("array<double>").alias("vector"),
    )
    taking = usable(F.col("vector")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    nodes = saved(
        rows.where(taking)
        .groupBy("label", "vector")
        .agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("n"))
        .withColumn("class", F.xxhash64("label", "vector"))
    )

    @F.pandas_udf("array<long>")
    def placed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for some in batches:
            out = pd.Series([None] * len(some), dtype=object)
            sizes = some.map(len).to_numpy()
            for size in np.unique(sizes):
                which = np.flatnonzero(sizes == size)
                found = probes(units(np.stack(some.iloc[which].to_numpy()).astype(np.float64)))
                for i, p in zip(which, found.reshape(len(which), -1), strict=True):
                    out.iat[i] = p
            yield out

    hashed = saved(nodes.select("class", "node", "n", "label", "vector", placed("vector").alias("places")))
    spread = hashed.select(
        "class", "label", F.size("vector").alias("dim"), F.posexplode("places").alias("place", "bucket")
    )
    spread = spread.select(
        "class", "label", "dim", F.floor(F.col("place") / PROBES).cast("int").alias("at"), "bucket", (F.col("place") % PROBES == 0).alias("own")
    ).distinct()
    key = ["label", "dim", "at", "bucket"]
    met = saved(
        spread.groupBy(*key)
        .agg(F.count(F.lit(1)).alias("size"), F.max("own").alias("home"))
        .where("size > 1 AND home")
        .withColumn("parts", F.ceil(F.col("size") / BLOCK).cast("int"))
    )
    member = spread.select("class", *key).distinct().join(met, key)
    part = F.pmod(F.xxhash64("class"), F.col("parts")).cast("int")
    mine = member.select("class", *key, "parts", part.alias("part"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    paired = mine.select("*", other.alias("other")).select(
        "class", *key, "part", F.least("part", "other").alias("left"), F.greatest("part", "other").alias("right")
    )
    full = paired.join(hashed.select("class", "node", "n", "vector", "places"), "class")
    group = F.xxhash64(*key, "left", "right")
    sorted_rows = (
        full.select(group.alias("group"), "class", "at", "bucket", "left", "right", "part", "node", "n", "vector", "places")
        .repartition("group")
        .sortWithinPartitions("group")
    )

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            cuts = np.flatnonzero(batch["group"].to_numpy()[1:] != batch["group"].to_numpy()[:-1]) + 1
            bounds = [0, *cuts.tolist(), len(batch)]
            out = []
            for start, stop in zip(bounds[:-1], bounds[1:], strict=True):
                piece = batch.iloc[start:stop]
                if held and held[0]["group"].iloc[0] != piece["group"].iloc[0]:
                    out.append(_whole(held, least))
                    held = []
                held.append(piece)
            out = [o for o in out if len(o)]
            if out:
                yield pd.concat(out)
        if held:
            yield _whole(held, least)

    found = saved(sorted_rows.mapInPandas(compare, "class long, links long, node long, root long"))
    linked = found.groupBy("class").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    known = (
        nodes.join(linked, "class", "left")
        .join(roots, "node", "left")
        .select(
            F.col("label").alias("of_label"),
            F.col("vector").alias("of_vector"),
            (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
            F.coalesce("component", "node").alias("component_id"),
        )
    )
    own = (F.col("label") == F.col("of_label")) & (F.col("vector") == F.col("of_vector")) & F.col("vec_id").isNotNull()
    at = rows.join(saved(known), own, "left")
    component = F.coalesce("component_id", "vec_id")
    return at.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )


def _whole(held: list[pd.DataFrame], least: float) -> pd.DataFrame:
    rows = pd.concat(held) if len(held) > 1 else held[0]
    if len(rows) < 2:
        return pd.DataFrame({"class": [], "links": [], "node": [], "root": []})
    return _compared(rows, least)
