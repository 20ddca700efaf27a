"""Unseen n-grams are unseen, however many others were learned."""

from __future__ import annotations

import itertools

from tallmat.llm import language


def test_unknown_grams_back_off_after_many_were_learned(spark):
    letters = "abcdefghijklmnopqrs"
    text = " ".join("".join(w) for w in itertools.product(letters, repeat=4))
    model = language.learn(spark.createDataFrame([(text, "x"), ("zu zu zu", "y")], "text string, lang string"))
    assert len(model.grams[4]) > 3 * (1 << 15)
    keys, _ = language.gram_keys(["tuvwxyztuvwxyz"], 4)
    assert not set(keys.tolist()) & set(model.grams[4].tolist())
    # Its longest n-grams are unknown, and shorter ones are of language y.
    assert model.vectors(["uzuz"])[0].argmax() == 1
