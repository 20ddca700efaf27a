"""The range of ranks that one task orders is bounded, whatever the inclusion odds, and the cut is that of a plain version."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tallmat.llm import mixture


def steps_of(spark, rows):
    return spark.createDataFrame(rows, "source string, rank double, uniform double, missing double, size long")


def test_ranges_hold_the_crossing_and_few_rows(spark, monkeypatch):
    monkeypatch.setattr(mixture, "BUCKET_ROWS", 50)
    rng = random.Random(4)
    rows, limits = [], {"a": 9_000.0, "b": 40.0, None: 1e9, "c": -1.0, "d": 300.0}
    for source, missing in limits.items():
        for i in range(4_000 if source in ("a", None) else 300):
            # One document in twenty is nearly certain, so its rank is close to zero.
            scale = 1e-9 if i % 20 == 0 else 1.0
            rank = 0.5 if source == "d" else rng.random() * scale
            rows.append((source, rank, rng.random(), missing, rng.randint(1, 9)))
    found = {r["of"]: r for r in mixture._crossing(steps_of(spark, rows)).collect()}
    assert set(found) == set(limits)
    assert found[None]["high"] is None
    for source, missing in limits.items():
        own = sorted(r[1:] for r in rows if r[0] == source)
        low, high, before = found[source]["low"], found[source]["high"], found[source]["before"]
        if high is None:
            assert sum(r[3] for r in own) <= missing
            continue
        assert before == sum(r[3] for r in own if r[0] <= low)
        inside = [r for r in own if low < r[0] <= high]
        assert before + sum(r[3] for r in inside) > missing and (before <= missing or missing < 0)
        assert len(inside) <= 50 or len({r[0] for r in inside}) == 1


def test_cut_is_that_of_documents_in_order(spark, monkeypatch):
    monkeypatch.setattr(mixture, "BUCKET_ROWS", 10)
    rng = random.Random(9)
    rows = [(i // 2 if i % 50 == 0 else i, "w " * rng.choice([1, 2, 3, 40, 900]), rng.choice(["a", "a", "a", "b", None])) for i in range(1_500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    measured = mixture._measured(docs, "doc_id", "text", "source")
    plan = {r["source"]: r for r in mixture.plan(measured).collect()}
    base = spark.createDataFrame([(s, r["rate"]) for s, r in plan.items()], "of string, rate double")
    ranked = mixture._ranked(measured.join(base, F.col("source").eqNullSafe(F.col("of"))), mixture.MOST).collect()
    for source, row in plan.items():
        own = [r for r in ranked if r["source"] == source]
        left = row["target"] - sum(r["whole"] * r["size"] for r in own)
        sizes = {}
        for r in own:
            if r["rank"] is not None:
                sizes[r["rank"], r["uniform"]] = sizes.get((r["rank"], r["uniform"]), 0) + r["size"]
        cut = None
        for key in sorted(sizes):
            left -= sizes[key]
            if left < 0:
                break
            cut = key
        assert (tuple(row["cut"]) if row["cut"] else None) == cut


def test_same_result_for_any_bucket(spark, monkeypatch, docs):
    def result():
        return sorted(map(str, mixture.mix_report(docs).collect()))

    wide = result()
    monkeypatch.setattr(mixture, "BUCKET_ROWS", 1)
    assert result() == wide
