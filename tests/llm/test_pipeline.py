"""The pipeline: columns, edge cases and each stage against a plain version."""

from __future__ import annotations

from collections import Counter

import pytest

import corpus_pipeline
from tallmat.llm import ordinal, surrogates

public_tokenizers = pytest.importorskip("public_tokenizers")


def test_stages_on_the_given_tables(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    rated = stages["quality"](spark, docs, tables)
    good = {r["doc_id"] for r in rated.collect()}
    grades = {r["doc_id"]: r["grade"] for r in ordinal.grade_labels(spark.read.parquet(f"{tables}/labels.parquet")).collect()}
    assert sum(g in good for g, k in grades.items() if k == 2) > 0.95 * sum(k == 2 for k in grades.values())
    single = stages["near duplicates"](spark, rated, tables)
    texts = {r["doc_id"]: r["text"] for r in rated.collect()}
    kept = {r["doc_id"] for r in single.collect()}
    words = {i: t.encode().lower().split() for i, t in texts.items()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in words.items()}

    def alike(i, j):
        return 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])

    # Every document that went has a near copy, not all of these went, and no two that stayed are near copies.
    links = {i: {j for j in texts if j != i and alike(i, j)} for i in texts}
    assert all(links[i] for i in texts.keys() - kept)
    for i in texts:
        group, more = set(), {i}
        while more:
            group |= more
            more = {k for j in more for k in links[j]} - group
        assert group & kept == {min(group)}
    clean = stages["private data"](spark, single, tables)
    for r in clean.collect():
        before = surrogates.entities(texts[r["doc_id"]])
        assert r["n_chars"] == len(r["text"]) and (r["text"] == texts[r["doc_id"]]) == (not before)
        assert not {e[3] for e in before} & {e[3] for e in surrogates.entities(r["text"])}
    mixed = stages["mixing"](spark, clean, tables)
    copies = Counter(r["doc_id"] for r in mixed.collect())
    assert max(copies.values()) <= 3 and set(copies) <= kept
    for df in (rated, single, clean, mixed):
        assert df.columns == columns
    pieces = stages["packing"](spark, mixed, tables).collect()
    assert set(copies) == {r["doc_id"] for r in pieces}
    per_doc = Counter()
    for r in pieces:
        per_doc[r["doc_id"]] += r["length"]
    whole = {r["doc_id"]: r["doc_tokens"] for r in pieces}
    assert all(per_doc[i] == n * whole[i] for i, n in copies.items())


def test_run_applies_all_stages(spark, tables):
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(corpus_pipeline.run(spark, tables).columns)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_rows_and_an_empty_table(spark, tables, odd, empty, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, odd, tables)
    assert out.count() > 0 and stage(spark, empty, tables).count() == 0
    if name != "packing":
        assert out.columns == odd.columns
