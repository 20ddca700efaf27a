"""Passages that repeat themselves: maximal runs of a period, found through minimizers of several scales.

A run is a stretch of words with smallest period q, at least three periods and ``LEAST`` words long, that no
neighbouring word extends. Short periods are found by comparing every word with the one q places on. For longer ones, grams of
W words stand for their places: within a run of period q <= W the same gram comes back after q words and not
before, and the smallest hash of every window of grams is picked at both places. So each pair of neighbouring picks
of one gram is a seed, which is extended word by word. The windows are chosen so narrow that no run of three
periods can be missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallmat.llm.common import WORD, fresh, give_back, small_batches, word_count

# A run has so many words and so many periods at least.
LEAST, PERIODS = 24, 3
# Periods up to this are found by direct comparison.
LAGS = 16
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"
RUN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, one after another, and their number per text; between ASCII white space."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    data = np.frombuffer(held, dtype=np.uint8)[offsets[0] : offsets[-1]] if held is not None else np.empty(0, np.uint8)
    inside = (data != 32) & ((data < 9) | (data > 13))
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    starts = offsets[:-1] - offsets[0]
    starts = starts[starts < len(data)]
    begins[starts] = inside[starts]
    kept = data[inside]
    before = np.concatenate([[0], np.cumsum(inside, dtype=np.int64)])
    places = before[np.flatnonzero(begins)]
    ends = np.concatenate([[0], np.cumsum(begins, dtype=np.int64)])[offsets - offsets[0]]
    bounds = np.concatenate([places, [len(kept)]]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(places), [None, pa.py_buffer(bounds), pa.py_buffer(kept)])
    return words, np.diff(ends)


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of two of them, in order."""
    x = (a ^ (a >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + b
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


def _slid(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` over every window of ``width`` values, by doubling."""
    out, done = values, 1
    while done < width:
        step = min(done, width - done)
        out = pick(out[:-step], out[step:])
        done += step
    return out


def scales() -> Iterator[tuple[int, int, int]]:
    """``(shorter, gram, window)``: grams for periods above ``shorter`` up to ``gram``, and grams per window.

    A run of period q has 3q - gram + 1 grams at least, and a window has to fit in together with its copy q on.
    """
    shorter, power = LAGS, LAGS
    while True:
        for gram in (power + power // 2, 2 * power):
            yield shorter, gram, (PERIODS - 1) * (shorter + 1) - gram + 1
            shorter = gram
        power *= 2


def _same(x: np.ndarray, i: int, lag: int, step: int) -> int:
    """How many words from ``i`` on, forwards or backwards, equal those ``lag`` further."""
    done, chunk = 0, 64
    while True:
        if step > 0:
            a = x[i + done : min(i + done + chunk, len(x) - lag)]
            b = x[i + done + lag : i + done + lag + len(a)]
        else:
            low = max(0, i - done - chunk + 1)
            a, b = x[low : i - done + 1][::-1], x[low + lag : i - done + 1 + lag][::-1]
        differ = np.flatnonzero(a != b)
        if len(differ):
            return done + int(differ[0])
        done += len(a)
        if len(a) < chunk:
            return done
        chunk *= 2


def _primitive(x: np.ndarray, start: int, end: int, period: int) -> bool:
    """Whether no divisor of a period is a period as well."""
    rest, prime = period, 2
    while rest > 1:
        if prime * prime > rest:
            prime = rest
        if rest % prime == 0:
            part = period // prime
            if np.array_equal(x[start : end - part], x[start + part : end]):
                return False
            while rest % prime == 0:
                rest //= prime
        prime += 1
    return True


def _lag_runs(x: np.ndarray, lag: int) -> Iterator[tuple[int, int]]:
    """Start and end of the stretches with a short period."""
    least = max(LEAST, PERIODS * lag)
    breaks = np.concatenate([[-1], np.flatnonzero(x[lag:] != x[:-lag]), [len(x) - lag]])
    long = np.flatnonzero(np.diff(breaks) - 1 >= least - lag)
    for i in long:
        yield int(breaks[i]) + 1, int(breaks[i + 1]) + lag


def _seeds(hashes: np.ndarray, size: int, end: int, shorter: int, gram: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances of neighbouring picks of one gram; ``hashes`` are of ``size`` words."""
    whole = hashes[: end - size + 1]
    if gram > size:
        whole = _mixed(whole[: end - gram + 1], whole[gram - size :])
    if len(whole) < window:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    lows = np.pad(_slid(whole, window, np.minimum), window - 1)
    picks = np.flatnonzero(_slid(lows, window, np.maximum) == whole)
    del lows
    values = whole[picks]
    order = np.argsort(values, kind="stable")
    values, picks = values[order], picks[order]
    distance = np.diff(picks)
    seeds = np.flatnonzero((values[1:] == values[:-1]) & (distance > shorter) & (distance <= gram))
    return picks[seeds], distance[seeds]


def find_runs(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``(text, start, length, period)`` of every run, in that order; ``ids`` are the texts' words one after another.

    All texts are searched as one sequence, the longest first, with marks between them that equal nothing; at
    each scale only those that can hold its periods take part.
    """
    order = np.argsort(-counts, kind="stable")
    order = order[counts[order] >= LEAST]
    if not len(order):
        return np.empty((0, 4), dtype=np.int64)
    sizes = counts[order]
    ends = np.cumsum(sizes + 1)
    starts = ends - sizes - 1
    source = np.cumsum(counts) - counts
    x = np.empty(ends[-1], dtype=np.int64)
    places = np.arange(sizes.sum()) + np.repeat(np.arange(len(order)), sizes)
    x[places] = ids[places + np.repeat(source[order] - starts, sizes)]
    x[ends - 1] = -1 - np.arange(len(order))
    del places
    found = []

    def reach(words: int) -> int:
        n = int(np.searchsorted(-sizes, -words, side="right"))
        return int(ends[n - 1]) if n else 0

    for lag in range(1, LAGS + 1):
        part = x[: reach(PERIODS * lag)]
        found += [(s, e, lag) for s, e in (_lag_runs(part, lag) if len(part) > lag else ()) if _primitive(x, s, e, lag)]
    hashes, size = _mixed(x.astype(np.uint64), np.uint64(len(ids))), 1
    for shorter, gram, window in scales():
        end = reach(PERIODS * (shorter + 1))
        if not end:
            break
        while 2 * size <= gram:
            hashes = _mixed(hashes[: max(0, len(hashes) - size)], hashes[size:])
            size *= 2
        at, distance = _seeds(hashes, size, end, shorter, gram, window)
        former, covered = 0, 0
        for i in np.lexsort((at, distance)):
            place, lag = int(at[i]), int(distance[i])
            if lag == former and place < covered:
                continue
            start = place - (_same(x, place - 1, lag, -1) if place else 0)
            stop = place + _same(x, place, lag, 1) + lag
            former, covered = lag, stop - lag
            if stop - start >= PERIODS * lag and _primitive(x, start, stop, lag):
                found.append((start, stop, lag))
    if not found:
        return np.empty((0, 4), dtype=np.int64)
    start, stop, lag = np.array(found, dtype=np.int64).T
    owner = np.searchsorted(ends, start, side="right")
    rows = np.unique(np.stack([order[owner], start - starts[owner], lag, stop - start], axis=1), axis=0)
    return rows[:, [0, 1, 3, 2]]


def _searched(texts: pa.Array) -> pa.Array:
    """Runs and collapsed text of each text of a batch."""
    words, counts = words_of(texts)
    runs = find_runs(words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64), counts)
    first = np.cumsum(counts) - counts
    steps = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(steps, first[runs[:, 0]] + runs[:, 1] + runs[:, 3], 1)
    np.add.at(steps, first[runs[:, 0]] + runs[:, 1] + runs[:, 2], -1)
    kept = np.cumsum(steps[:-1]) == 0
    ends = np.concatenate([[0], np.cumsum(kept, dtype=np.int64)])[np.concatenate([[0], np.cumsum(counts)])]
    lists = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), words.filter(pa.array(kept)))
    collapsed = pc.binary_join(lists, pa.scalar(b" ", pa.large_binary())).cast(pa.string())
    structs = pa.StructArray.from_arrays([pa.array(runs[:, i]) for i in (1, 2, 3)], ["start", "length", "period"])
    bounds = np.searchsorted(runs[:, 0], np.arange(len(texts) + 1)).astype(np.int32)
    listed = pa.ListArray.from_arrays(pa.array(bounds), structs).cast(RUN_TYPE)
    nothing = pc.is_null(texts)
    out = pa.StructArray.from_arrays([listed, pc.if_else(nothing, pa.scalar(None, pa.string()), collapsed)], ["runs", "collapsed"])
    give_back()
    return out


def collapse(docs: DataFrame) -> DataFrame:
    """``docs`` with ``runs``, by start, then period, and ``collapsed``: the text without what its runs repeat.

    A word is left out of ``collapsed`` if a run holds it after its first period; kept words are joined by one space. Words stand between ASCII white
    space and are counted from 0. A null text has no runs and stays null; a text without words gives an empty one.
    Rows are handled each on its own, repeated ones too, and an empty table gives an empty one. Columns named ``runs`` or ``collapsed`` in
    ``docs`` stay, and the new ones then begin with ``_``. A task holds the words of one Arrow batch, and so of one
    text at least; no row is shuffled.
    """
    small_batches(docs.sparkSession)
    search = F.arrow_udf(_searched, f"runs {RUNS}, collapsed string")
    runs, collapsed, found = fresh(docs, "runs", "collapsed", "searched")
    return docs.select("*", search("text").alias(found)).select(
        *[F.col(f"`{c}`") for c in docs.columns], F.col(f"{found}.runs").alias(runs), F.col(f"{found}.collapsed").alias(collapsed)
    )


def planted(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)`` with planted runs: a tenth of the texts, by CRC32 of the id, repeat their own words from some place on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", "text", h.alias("h"), word_count(F.col("text")).alias("n"))
    g = F.floor(F.col("h") / 10)
    a = F.try_mod(g, F.col("n"))
    p = 1 + F.floor((F.col("n") - a) / (3 + g % 8))
    rows = rows.select("doc_id", "text", "n", ((F.col("h") % 10 == 0) & (F.col("n") > 0)).alias("plant"), a.alias("a"), p.alias("p"))
    # Slices, not a place per word: the words inside a lambda function would be cut out anew for each of them.
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    a, p, rest = F.col("a").cast("int"), F.col("p").cast("int"), (F.col("n") - F.col("a")).cast("int")
    again = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil(rest / p).cast("int")))
    changed = F.array_join(F.concat(F.slice(words, 1, a), F.slice(again, 1, rest)), " ")
    return rows.select("doc_id", F.when(F.col("plant"), changed).otherwise(F.col("text")).alias("text"))


def _denser(a: Column, b: Column) -> Column:
    """Order of runs by length over period, compared exactly; then by start, then period."""
    left, right = a["length"] * b["period"], b["length"] * a["period"]
    return (
        F.when(left > right, -1)
        .when(left < right, 1)
        .when(a["start"] < b["start"], -1)
        .when(a["start"] > b["start"], 1)
        .when(a["period"] < b["period"], -1)
        .when(a["period"] > b["period"], 1)
        .otherwise(0)
    )


def digests(docs: DataFrame) -> DataFrame:
    """One row per document: number of runs, the densest one, and digests of all runs and of the collapsed text."""
    found = collapse(docs.select("doc_id", "text"))
    best = F.get(F.array_sort("runs", _denser), 0)
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    rows = found.select("doc_id", "runs", best.alias("best"), listed.alias("listed"), F.coalesce("collapsed", F.lit("")).alias("rest"))
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.col("listed").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("rest").cast("binary"), 256).alias("collapsed_sha256"),
    )
