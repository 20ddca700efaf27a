"""The registered queries: schemas, SQL, and that the rest does without these folders."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as contract
from tallmat.llm import oracles, queries

pytest.importorskip("public_tokenizers")


def test_every_operator_has_a_query():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 14)]
    assert set(queries.QUERIES) | {"pipeline"} <= set(contract.queries())
    assert set(oracles.oracle_sql()) <= set(queries.QUERIES)


def test_nothing_else_imports_these_operators():
    root = os.path.dirname(os.path.abspath(contract.__file__))
    for folder, _, names in os.walk(os.path.join(root, "tallmat")):
        if not folder.startswith(os.path.join(root, "tallmat", "llm")):
            for name in names:
                if name.endswith(".py"):
                    assert "tallmat.llm" not in open(os.path.join(folder, name)).read()


def test_held_out_languages(spark, tables):
    directory = tables.replace("0.001", "0.01")
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{directory}/documents.parquet").select("doc_id", "lang").collect()}
    rows = queries.QUERIES["op7_word_first_language"](spark, directory).collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(truth) and len(held) > 200
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) > 0.98 * len(held)
