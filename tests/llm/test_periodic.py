"""Runs of a period against a plain search, collapsed texts and digests."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tallmat.llm import periodic


def plain_runs(x):
    """Every period tried on every place."""
    found = set()
    for q in range(1, len(x) // 3 + 1):
        start = 0
        for t in range(len(x) - q + 1):
            if t == len(x) - q or x[t] != x[t + q]:
                length = t - start + q
                smaller = any(all(x[i] == x[i + p] for i in range(start, t + q - p)) for p in range(1, q) if q % p == 0)
                if t > start and length >= max(24, 3 * q) and not smaller:
                    found.add((start, length, q))
                start = t + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def found_runs(texts):
    flat = np.concatenate([np.array(t, dtype=np.int64) for t in texts]) if texts else np.empty(0, np.int64)
    rows = periodic.find_runs(flat, np.array([len(t) for t in texts], dtype=np.int64))
    return [[tuple(int(v) for v in r[1:]) for r in rows if r[0] == i] for i in range(len(texts))]


def periodic_text(rng, words):
    """Pieces that repeat, with changes now and then, among others that do not."""
    out = []
    while len(out) < words:
        q = rng.choice([1, 2, 3, 5, 9, 16, 17, 23, 24, 25, 31, 40, 60])
        piece = [rng.randrange(rng.choice([1, 2, 50])) for _ in range(q)]
        for _ in range(rng.randrange(1, 7)):
            out += piece
            if rng.random() < 0.1:
                out[-1] = rng.randrange(60)
        out += piece[: rng.randrange(q + 1)]
    return out


def test_runs_equal_a_plain_search():
    rng = random.Random(5)
    for _ in range(60):
        texts = [periodic_text(rng, rng.choice([0, 5, 30, 120, 400])) for _ in range(rng.randrange(1, 6))]
        assert found_runs(texts) == [plain_runs(t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 1), max_size=40), st.integers(1, 6), st.lists(st.integers(0, 1), max_size=20))
def test_runs_of_two_words(base, times, tail):
    x = base * times + tail
    assert found_runs([x]) == [plain_runs(x)]


def test_a_long_period_in_a_long_text():
    rng = random.Random(1)
    for q in (100, 127, 128, 129, 191, 193, 700, 1000):
        piece = [rng.randrange(1 << 40) for _ in range(q)]
        before = [rng.randrange(1 << 40) for _ in range(rng.randrange(400))]
        x = before + piece * 3
        assert found_runs([[1, 2], x, x[:-1]]) == [[], [(len(before), 3 * q, q)], []]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=" \t\n\x0b\x0c\r\x1c\xa0aé", max_size=12)), max_size=6))
def test_words_are_those_between_ascii_white_space(texts):
    for chosen in (texts, texts[1:]):
        array = pa.array(texts, pa.string())[len(texts) - len(chosen) :]
        words, counts = periodic.words_of(array)
        plain = [(t or "").encode().split() for t in chosen]
        assert counts.tolist() == [len(w) for w in plain]
        assert words.to_pylist() == [w for ws in plain for w in ws]


def plain_digest(doc_id, text):
    words, h = re.findall("[^\x20\x09-\x0D]+", text or ""), None if doc_id is None else zlib.crc32(str(doc_id).encode())
    n = len(words)
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs)]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    best = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return doc_id, len(runs), *best, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(kept))


def key(row):
    return repr(tuple(row))


def test_query_equals_a_plain_version(spark, docs, empty):
    from tallmat.llm.queries import op12_minimizer_runs  # noqa: F401

    rng = random.Random(2)
    rows = [(i, " ".join(f"w{w}" for w in periodic_text(rng, rng.choice([0, 3, 40, 200])))) for i in range(150)]
    rows += [(None, "a " * 30), (150, None), (151, ""), (152, " \n\t"), (3, "b c " * 20), (3, "b c " * 20), (153, "\x1cü\xa0 " * 30)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    ours = [tuple(r) for r in periodic.digests(periodic.planted(df)).collect()]
    assert sorted(ours, key=key) == sorted((plain_digest(*r) for r in rows), key=key)
    assert any(zlib.crc32(str(r[0]).encode()) % 10 == 0 and r[1] > 0 for r in ours)
    assert periodic.digests(periodic.planted(empty)).count() == 0


def test_odd_rows_and_columns(spark, odd):
    clash = odd.selectExpr("*", "1 AS runs", "2 AS Collapsed", "3 AS searched")
    out = periodic.collapse(clash)
    assert out.columns == [*clash.columns, "_runs", "_collapsed"] and out.count() == odd.count()
    for r in out.collect():
        if r["text"] is None:
            assert r["_collapsed"] is None and r["_runs"] == []
        elif r["doc_id"] == 7:
            assert r["_collapsed"] == "word" and [tuple(x) for x in r["_runs"]] == [(0, 60_000, 1)]
        else:
            assert r["_collapsed"] == " ".join(r["text"].split()) and r["_runs"] == []


def test_a_very_long_text(spark):
    words = [str(i) for i in range(200_000)]
    text = " ".join(words * 3 + words[:7])
    row = periodic.collapse(spark.createDataFrame([(1, text)], "doc_id int, text string")).first()
    assert [tuple(r) for r in row["runs"]] == [(0, 600_007, 200_000)] and row["collapsed"] == " ".join(words)
