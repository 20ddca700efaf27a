"""Every learned word and n-gram counts, held by tasks or not, and scores are those of a plain version."""

from __future__ import annotations

import math
import re
from collections import Counter

import pytest

from tallmat.llm import language

LEARNED = [
    (1, "the cat sat on the mat the cat", "en"),
    (2, "le chat est sur le tapis rouge", "fr"),
    (3, "der Hund schläft auf dem Teppich, der Hund", "de"),
    (4, "кот сидит на ковре", "ru"),
    (5, "the the tapis", "en"),
    (6, "nothing is learned here", None),
]
ASKED = [*LEARNED, (7, "catty chatte hundert", None), (8, "ковер tepp 12 x", None), (9, "", None), (10, None, None), (11, "漢字", None), (9, "mat " * 5_000 + "zzz", None)]


def grams(word, length):
    marked = f"\x02{word}\x03"
    return [marked[i : i + length] for i in range(len(marked) - length + 1)]


def plain(rows, texts):
    """The same by dictionaries: sums of whole multiples of log frequencies."""
    words_of = lambda t: re.findall(r"[^\W\d_]+", (t or "").lower())
    langs = sorted({r[2] for r in rows if r[2]})
    words = {g: Counter(w for r in rows if r[2] == g for w in words_of(r[1])) for g in langs}
    pieces = {n: {g: Counter(x for w in words[g] for x in grams(w, n)) for g in langs} for n in language.LENGTHS}
    unit = lambda x: round(math.log(x) * language.UNIT)

    def logs(word):
        if any(word in words[g] for g in langs):
            return [unit((words[g][word] + 0.1) / (sum(words[g].values()) + 0.1 * len(words[g]))) for g in langs]
        for n in language.LENGTHS:
            seen = set().union(*pieces[n].values())
            found, hits = grams(word, n), [x for x in grams(word, n) if x in seen]
            if hits and len(hits) >= 0.5 * len(found):
                mass = {g: sum(pieces[n][g].values()) + 0.5 * len(seen) for g in langs}
                return [sum(unit((pieces[n][g][x] + 0.5) / mass[g]) for x in hits) // len(hits) for g in langs]
        return [0] * len(langs)

    out = []
    for i, text, _ in texts:
        said = words_of(text)
        if not said:
            out.append((i, "und", 0.0))
            continue
        totals = [sum(v) for v in zip(*map(logs, said), strict=True)]
        best = max(totals)
        share = min(len(said), 20) / len(said) / language.UNIT
        out.append((i, langs[totals.index(best)], 1 / sum(math.exp((t - best) * share) for t in totals)))
    return sorted(out)


@pytest.mark.parametrize("held", [200_000, 12, 0])
def test_scores_are_those_of_a_plain_version(spark, monkeypatch, held):
    monkeypatch.setattr(language, "VOCABULARY", held)
    monkeypatch.setattr(language, "HELD_GRAMS", 3 * held)
    kind = "doc_id long, text string, lang string"
    model = language.learn(spark.createDataFrame(LEARNED, kind))
    assert len(model.frequent.words) <= held
    found = sorted(map(tuple, language.identify(spark.createDataFrame(ASKED, kind), model).collect()))
    expected = plain(LEARNED, ASKED)
    assert [r[:2] for r in found] == [r[:2] for r in expected]
    assert [r[2] for r in found] == pytest.approx([r[2] for r in expected], abs=1e-4)
