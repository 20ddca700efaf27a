"""Edits of conversations against an exhaustive search, faults, ties, and odd rows."""

from __future__ import annotations

import hashlib
import heapq
import random
import re

import pytest

from tallmat.llm import repair

TURNS = "conv_id bigint, turn bigint, role string, text string"
GOOD = re.compile("(s?(ua)+)?")


def cheapest(rows):
    """Least cost, then least edits, over all edits of ``(initial, kind)``; whole states in order of cost and edits."""
    heap, seen = [(0, "", 0, "")], set()
    best = None
    while heap:
        cost, edits, i, said = heapq.heappop(heap)
        if best and cost > best[0]:
            return best
        if i == len(rows) and GOOD.fullmatch(said) and (best is None or (cost, edits) < best[:2]):
            best = (cost, edits, said)
        # Equal edits leave equal turns, so a state is known by them.
        if (edits, said) in seen:
            continue
        seen.add((edits, said))
        options = [(5, "I", 0, r) for r in "ua"] if len(said) < len(rows) + 3 else []
        if i < len(rows):
            initial, kind = rows[i]
            options.append((2, "D", 1, ""))
            if kind != 2:
                late = 5 if kind == 1 else 0
                options += [(late, "K", 1, initial)] + [(late + 1, "R", 1, r) for r in "ua"]
        for more, e, step, r in options:
            prefix = said + r
            if re.fullmatch("s?(ua)*u?", prefix):
                heapq.heappush(heap, (cost + more, edits + e, i + step, prefix))
    return best


def searched(rows):
    survivors, out, most = repair.Survivors(), [], 0
    for initial, kind in rows:
        survivors.push(chr(96 + repair.INITIALS.index(initial) * 3 + kind))
        out += list(survivors.resolved())
        for _, _, node in survivors.alive.values():
            open_rows = 0
            while node is not survivors.root:
                node, open_rows = node.parent, open_rows + 1
            most = max(most, open_rows)
    return out + list(survivors.finish()), most


def test_edits_equal_an_exhaustive_search():
    rng = random.Random(3)
    for _ in range(250):
        rows = [(rng.choice("suuaa?"), rng.choice([0, 0, 0, 1, 2])) for _ in range(rng.randrange(0, 6))]
        way, _ = searched(rows)
        cost, edits, said = cheapest(rows)
        assert "".join(e for e, _ in way) == edits and "".join(s for _, s in way) == said, rows
        assert len(way) == len(rows)


def test_memory_holds_only_open_rows():
    rng = random.Random(4)
    sound = [("ua"[i % 2], 0) for i in range(20_000)]
    broken = [(rng.choice("sua?"), rng.choice([0, 0, 1, 2])) if rng.random() < 0.2 else r for r in sound]
    for rows in (sound, broken):
        way, most = searched(rows)
        assert len(way) == len(rows) and most < 200
    assert all(e == "K" for e, _ in searched(sound)[0])


def plain_report(conv, rows):
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    faults, seen, symbols = [], set(), []
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
        seen.add((role, text))
        faults.append(fault)
        symbols.append((role[:1] if role[:1] in ("s", "u", "a") else "?", {None: 0, "truncated": 1}.get(fault, 2)))
    cost, edits, said = cheapest(symbols)
    out, i, k = [], 0, 0
    names = {"u": "user", "a": "assistant"}
    for e in edits:
        if e == "I":
            out.append(f"{names[said[k]]}:")
        elif e == "K":
            out.append(f"{rows[i][1]}:{rows[i][2]}")
        elif e == "R":
            out.append(f"{names[said[k]]}:{rows[i][2]}")
        k += e != "D"
        i += e != "I"
    turns = {t for t, _, _ in rows if t is not None}
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:], strict=False)]
    return (
        conv,
        max(turns) - min(turns) + 1 - len(turns) if turns else 0,
        *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
        sum(p not in ("su", "ua", "au") for p in pairs),
        cost,
        edits,
        hashlib.sha256("\n".join(out).encode()).hexdigest(),
    )


def test_reports_equal_a_plain_version(spark):
    rng = random.Random(6)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "User"], ["Yes.", "No", "", " ", None, "Why? \n", "x!", "é"]
    rows = []
    for conv in [None, *range(60)]:
        for t in range(rng.randrange(1, 7)):
            turn = rng.choice([t, t, t, 3, None])
            rows.append((conv, turn, rng.choice(roles) if rng.random() < 0.4 else ["user", "assistant"][t % 2], rng.choice(texts)))
    df = spark.createDataFrame(rows, TURNS).repartition(5)
    ours = sorted((tuple(r) for r in repair.report(df).collect()), key=repr)
    theirs = sorted((plain_report(c, [r[1:] for r in rows if r[0] == c]) for c in {r[0] for r in rows}), key=repr)
    assert ours == theirs


def test_repaired_turns_alternate(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 2, "user", "Hi."), (1, 3, "user", "Well?"), (2, 0, "assistant", "Cut of")]
    df = spark.createDataFrame(rows, TURNS).selectExpr("*", "1 AS position", "2 AS fault", "3 AS `Edits`", "4 AS first")
    out = [tuple(r) for r in repair.repaired(df).orderBy("conv_id", "number").select("conv_id", "role", "text", "edit").collect()]
    assert out == [(1, "system", "Be kind.", "K"), (1, "user", "Hi.", "K"), (1, "assistant", "Well?", "R")]


def test_a_long_conversation_and_an_empty_table(spark):
    """A third of all rows in one conversation; half of it repeats itself."""
    hot = [(0, i, ["user", "assistant"][i % 2], f"Row {i if i % 4 < 2 else 0}.") for i in range(9_000)]
    rest = [(c, i, ["user", "assistant"][i % 2], f"Row {i}.") for c in range(1, 4501) for i in range(4)]
    df = spark.createDataFrame(hot + rest, TURNS)
    found = {r["conv_id"]: r for r in repair.report(df).collect()}
    assert len(found) == 4501 and found[0]["duplicate"] == 4_499 and len(found[0]["audit"]) >= 9_000
    assert all(found[c]["audit"] == "KKKK" and found[c]["cost"] == 0 for c in range(1, 4501))
    assert repair.report(df.limit(0)).count() == 0


def test_conversations_that_lose_all_rows(spark):
    df = spark.createDataFrame([(1, 0, "user", "A."), (2, 0, "user", "")], TURNS)
    found = {r["conv_id"]: tuple(r)[1:] for r in repair.report(df, df.where("conv_id = 2")).collect()}
    nothing = hashlib.sha256(b"").hexdigest()
    assert found == {1: (0, 0, 0, 0, 0, 0, "", nothing), 2: (0, 1, 0, 0, 0, 2, "D", nothing)}


@pytest.mark.parametrize("turn", [None, 3])
def test_damage_keeps_or_drops_whole_rows(spark, turn):
    df = spark.createDataFrame([(i, turn, "assistant", "A. B!") for i in range(400)] + [(None, turn, None, None)], TURNS)
    out = [tuple(r) for r in repair.damaged(df).collect()]
    texts = {r[3] for r in out}
    assert texts >= {"A. B!", "", "A B"} and {r[2] for r in out} >= {"assistant", "user"} and 360 < len(out) < 440
