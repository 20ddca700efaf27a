"""Vector and chat operators: edge cases, and comparison with brute force."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallmat.llm import chatlog, crosspolytope, kmtree

VECTORS = "vec_id bigint, embedding array<float>, label int"
NAN, INF = float("nan"), float("inf")
ODD = [
    (1, [1.0, 0.0, 0.0], 0),
    (2, [1.0, 0.0, 0.0], 0),
    (2, [1.0, 0.0, 0.0], 0),
    (3, [1.0, 0.05, 0.0], 0),
    (4, [0.0, 1.0, 0.0], 0),
    (5, [1.0, 0.0, 0.0], None),
    (6, [1.0, 0.0, 0.0], 1),
    (7, None, 0),
    (8, [0.0, 0.0, 0.0], 0),
    (9, [1.0, NAN, 0.0], 0),
    (10, [1.0, None, 0.0], 0),
    (11, [INF, 0.0, 0.0], 0),
    (12, [], 0),
    (None, [1.0, 0.0, 0.0], 0),
    (13, [1.0, 0.0], 0),
    (14, [2.0, 0.0, 0.0], 0),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, VECTORS).select("*", F.lit(1).alias("node"), F.lit(2).alias("links"), F.lit(3).alias("vector"))


@pytest.fixture(scope="module")
def crowd(spark):
    """Random vectors, copies, and groups of close ones with links just above and below the limit."""
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 24))
    rows = [list(map(float, b)) for b in base]
    for b in base[:12]:
        for spread in (0.0, 0.05, 0.1, 0.15, 0.2, 0.22, 0.25):
            rows += [list(map(float, b + spread * rng.normal(size=24))) for _ in range(3)]
    rows += [rows[0]] * 25
    data = [(i, r, i % 2 if i % 11 else None) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, VECTORS)


def brute_links(df):
    rows = [(r["vec_id"], np.array(r["embedding"], dtype=np.float64), r["label"]) for r in df.collect()]
    links = {i: set() for i, _, _ in rows}
    for i, x, a in rows:
        for j, y, b in rows:
            if i != j and a is not None and a == b and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                links[i].add(j)
    return links


def reach(links):
    out = {}
    for start in sorted(links):
        stack = [] if start in out else [start]
        while stack:
            n = stack.pop()
            if n not in out:
                out[n] = start
                stack += links[n]
    return out


@pytest.mark.parametrize("block", [1024, 7])
def test_links_equal_brute_force(crowd, monkeypatch, block):
    monkeypatch.setattr(crosspolytope, "BLOCK", block)
    links = brute_links(crowd)
    ends = reach(links)
    found = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in crosspolytope.near_duplicates(crowd).collect()}
    assert found == {i: (len(n), ends[i], ends[i] == i) for i, n in links.items()}
    assert max(len(n) for n in links.values()) > 15


def test_recall_near_the_limit():
    rng = np.random.default_rng(8)
    x = crosspolytope.units(rng.normal(size=(4000, 64)))
    side = rng.normal(size=x.shape)
    side -= (side * x).sum(axis=1, keepdims=True) * x
    y = 0.98 * x + np.sqrt(1 - 0.98**2) * crosspolytope.units(side)
    a, b = crosspolytope.probes(x), crosspolytope.probes(y)
    met = ((a == b[:, :, :1]).any(axis=2) | (b == a[:, :, :1]).any(axis=2)).any(axis=1)
    assert met.mean() > 0.99


def test_odd_vectors_link_with_nothing(odd):
    found = sorted((tuple(r) for r in crosspolytope.near_duplicates(odd).collect()), key=repr)
    by_id = {r[0]: r[1:] for r in found}
    assert len(found) == len(ODD)
    assert by_id[1] == (4, 1, True) and by_id[2] == (4, 1, False) and by_id[3] == (4, 1, False) and by_id[14] == (4, 1, False)
    for i in (4, 5, 6, 7, 8, 9, 10, 11, 12, 13):
        assert by_id[i] == (0, i, True)
    assert by_id[None] == (0, None, True)


def test_vectors_of_an_empty_table(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert crosspolytope.near_duplicates(empty).count() == 0
    assert kmtree.search(empty, empty).count() == 0
    nothing = spark.createDataFrame([(1, [0.0, 0.0], 0), (2, None, 0)], VECTORS)
    assert kmtree.search(nothing, nothing).count() == 0


def brute_nearest(df, queries, k):
    rows = [(r["vec_id"], np.array(r["embedding"], dtype=np.float64)) for r in df.collect()]
    out = {}
    for q, x in rows:
        if q in queries:
            near = sorted((-(x * y).sum(), i) for i, y in rows if i != q)[:k]
            out[q] = [(i, -s) for s, i in near]
    return out


def by_query(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(out.setdefault(r["query_id"], [])) + 1
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


def test_search_of_all_leaves_is_exact(crowd, monkeypatch):
    monkeypatch.setattr(kmtree, "LEAF_ROWS", 20)
    monkeypatch.setattr(kmtree, "BLOCK", 9)
    monkeypatch.setattr(kmtree, "QUERY_BLOCK", 4)
    found = by_query(kmtree.search(crowd, crowd.where("vec_id % 5 = 0"), k=20, recall=1.1))
    truth = brute_nearest(crowd, {r["vec_id"] for r in crowd.where("vec_id % 5 = 0").collect()}, 20)
    assert found.keys() == truth.keys()
    for q, near in truth.items():
        assert [i for i, _ in found[q]] == [i for i, _ in near]
        assert [s for _, s in found[q]] == pytest.approx([s for _, s in near], rel=1e-12)


def test_recall_reaches_what_was_calibrated(spark, monkeypatch):
    monkeypatch.setattr(kmtree, "LEAF_ROWS", 50)
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(40, 16)) * 3
    rows = [(i, [float(v) for v in centers[i % 40] + rng.normal(size=16)], 0) for i in range(4000)]
    df = spark.createDataFrame(rows, VECTORS)
    tree, placed = kmtree.index(kmtree.prepared(df, "vec_id", "embedding"))
    leaves = sum(not kids for kids in tree.children)
    visits, reached = kmtree.calibrate(tree, placed, placed, 20)
    assert leaves > 30 and visits < leaves / 2 and reached >= 0.95
    found = by_query(kmtree.search(df, df.where("vec_id % 20 = 0")))
    truth = brute_nearest(df, {i for i in range(0, 4000, 20)}, 20)
    hits = sum(len({i for i, _ in truth[q]} & {i for i, _ in found[q]}) for q in truth)
    assert hits / (20 * len(truth)) > 0.9


def test_tree_visits_every_leaf_once():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 8))
    tree = kmtree.grow(x, 30, float(np.sqrt((x * x).sum(axis=1)).max()))
    order = tree.visit(x[0], 1000)
    assert sorted(order) == list(range(30)) and set(tree.assign(x).tolist()) <= set(order)
    assert order[:5] == tree.visit(x[0], 5)


def test_search_with_odd_vectors(odd):
    found = by_query(kmtree.search(odd, odd.where("vec_id IN (1, 4, 7, 8, 13)"), k=3))
    assert found == {1: [(14, 2.0), (2, 1.0), (3, 1.0)], 4: [(3, pytest.approx(0.05)), (1, 0.0), (2, 0.0)]}


# -- chats

EVENTS = "conv_id bigint, seq bigint, kind string, message bigint, role string, text string"


def test_folding_deltas_edits_and_regenerations(spark):
    rows = [
        (1, 1, "message", 10, "user", "helo"),
        (1, 2, "message", 11, "assistant", None),
        (1, 4, "delta", 11, None, "wor"),
        (1, 3, "delta", 11, None, "Hello "),
        (1, 5, "delta", 11, None, "ld"),
        (1, 6, "edit", 10, None, "hello"),
        (1, 7, "message", 12, "user", "more"),
        (1, 8, "regenerate", 11, None, ""),
        (1, 9, "delta", 11, None, "Hi"),
        (1, 10, "message", 13, "user", "thanks"),
        (2, 1, "delta", 1, "assistant", "alone"),
        (None, 1, "message", 1, "user", "lost"),
        (3, None, "message", 1, "user", "lost"),
        (4, 1, None, 1, None, None),
    ]
    folded = chatlog.fold(spark.createDataFrame(rows, EVENTS).repartition(4))
    found = {}
    for r in sorted(folded.collect(), key=lambda r: (r["conv_id"], r["position"])):
        found.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert found == {
        1: [("user", "hello"), ("assistant", "Hi"), ("user", "thanks")],
        2: [("assistant", "alone")],
        4: [("", "")],
    }
    assert chatlog.fold(spark.createDataFrame([], EVENTS)).count() == 0


def expected_digest(turns):
    said = "".join(f"{role or ''}\n{text or ''}\n" for role, text in turns)
    learned = "".join(text or "" for role, text in turns if role == "assistant")
    return (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())


NASTY = [
    "", "\\", "<|", "<\\|", "\\<|", "a<", "|b", "<|im_end|>", "<|im_end|>\n<|im_start|>assistant\nx", "\\n", "\n", "<<||>>",
    "é🙂<|im_start|>", "\\\\|", "im_end|>", "end\\",
]


def test_rendered_conversations_read_back(spark):
    rows, n = [], 0
    for i, a in enumerate(NASTY):
        for b in NASTY:
            n += 1
            rows += [(n, 0, "user" if i % 2 else a, a), (n, 1, "assistant", b), (n, 2, None, None), (n, 3, "assistant", a + b)]
    rows += [(None, 0, "user", "x"), (0, 1, "assistant", "b"), (0, 1, "assistant", "b"), (0, None, "user", "a"), (0, 1, "assistant", "a")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("seq", F.lit("clash"))
    found = {r["conv_id"]: r for r in chatlog.digests(df.repartition(3)).collect()}
    turns = {}
    for c, _, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], -1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        turns.setdefault(c, []).append((role, text))
    assert {c: tuple(r)[1:5] for c, r in found.items()} == {c: expected_digest(t) for c, t in turns.items()}
    formatted = {r["conv_id"]: r for r in chatlog.render(chatlog.fold(chatlog.events_of(df))).collect()}
    for c, r in formatted.items():
        assert found[c]["formatted_chars"] == len(r["formatted"])
        assert r["formatted"].count("<|im_start|>") == len(turns[c]) == r["formatted"].count("<|im_end|>")
        masked = [r["formatted"][m["start"] : m["start"] + m["length"]] for m in r["loss"]]
        assert len(masked) == sum(role == "assistant" for role, _ in turns[c])
    assert chatlog.digests(df.where("false")).count() == 0


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="\\<|n\na", max_size=12), min_size=1, max_size=8))
def test_escaping_is_reversible(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    text, line = chatlog.escaped(F.col("t")), chatlog.escaped(F.col("t"), one_line=True)
    for t, a, b, x, y in df.select("t", text, line, chatlog.unescaped(text), chatlog.unescaped(line)).collect():
        assert x == y == t and "<|" not in a and "<|" not in b and "\n" not in b


def test_chat_plan_has_no_python(spark):
    rows = spark.createDataFrame([(1, 0, "user", "x")], "conv_id bigint, turn bigint, role string, text string")
    plan = chatlog.digests(rows)._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))
