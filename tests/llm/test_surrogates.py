"""Personal data: crowded surrogate spaces, and secrets and names in less common forms."""

from __future__ import annotations

import random
import re

import pyarrow as pa
import pytest

from tallmat.llm import surrogates


def test_masks_stay(spark):
    texts = ["password: ********", "Authorization: ------", "password: ****1***"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    new = {r["doc_id"]: r["text"] for r in surrogates.replace_entities(df).collect()}
    assert new[0] == texts[0] and new[1] == texts[1] and new[2] != texts[2]


def test_crowded_spaces_have_a_surrogate_for_every_entity(spark):
    rows = [(f"person-{g}-{w}", n) for (w, g), names in surrogates.GIVEN.items() for n in names.split()]
    parts = surrogates.SYLLABLES["greek"].split()
    rows += [("person-m-greek", (a + b).capitalize()) for a in parts for b in parts]
    rows += [("phone", f"+49{i:04d}") for i in range(10_000)]
    rows += [("secret", f"*****{c}") for c in "0123456789"]
    given = surrogates.assign(spark.createDataFrame(rows, "kind string, canonical string")).collect()
    assert len(given) == len(set(rows)) == len({(r["kind"], r["surrogate"]) for r in given})
    assert not {(r["kind"], r["surrogate"]) for r in given} & set(rows)


def test_a_longer_number_is_written_whole():
    assert surrogates.dressed("+49 12-34", "phone", "+49567890") == "+49 56-7890"


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("access_token=abc123def456", ["abc123def456"]),
        ("DB_PASSWORD=hunter22hunter", ["hunter22hunter"]),
        ("client_secret: s3cr3tvalue", ["s3cr3tvalue"]),
        ("aws_secret_access_key = wJalrXUtnFEMI/K7", ["wJalrXUtnFEMI/K7"]),
        ('"accessToken": "abc123def456", "apiKeyValue": "q1w2e3r4"', ["abc123def456", "q1w2e3r4"]),
        ("SECRET_KEY_BASE='0a1b2c3d4e'", ["0a1b2c3d4e"]),
        ("Authorization: Bearer abc.def.ghi", ["abc.def.ghi"]),
        ("authorization: Basic dXNlcjpwYXNz", ["dXNlcjpwYXNz"]),
        ("see eyJhbGciOiJI.eyJzdWIiOiIx.c2lnbg here", ["eyJhbGciOiJI.eyJzdWIiOiIx.c2lnbg"]),
        ("then Emily Johnson wrote to Виктор Смирнов", ["Emily Johnson", "Виктор Смирнов"]),
        ("My name is Thandiwe Nkosi.", ["Thandiwe Nkosi"]),
        ("token_count: 1000000, the secretary: somebody, tokenizer = sentencepiece, Authorization: Bearer", []),
    ],
)
def test_secrets_in_identifiers_and_further_names(text, found):
    assert [text[s:e] for s, e, _, _ in surrogates.entities(text)] == found
    assert bool(found) <= bool(surrogates.hinted(pa.array([text])))


@pytest.mark.parametrize(
    "text",
    ["Мария пошла домой. Ольга сказала, что Иван придёт", "Η Ελένη είναι εδώ και η Μαρία λέει", "Anna über alles, Peter östlich davon", "PAUL went"],
)
def test_prose_after_a_given_name_is_no_surname(text):
    assert surrogates.entities(text) == []


def test_a_person_keeps_the_name_in_every_form(spark):
    texts = ["Mr Smith met John Smith. JOHN SMITH and Dr Smith left with Mary Smith", "Mrs Müller-Lüdenscheidt und Herr Иван Петров, Анна Петров"]
    df = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string")
    new = [r["text"] for r in surrogates.replace_entities(df).collect()]
    m = re.fullmatch(r"Mr (\S+) met (\S+) \1\. (\S+) (\S+) and Dr \1 left with (\S+) \1", new[0])
    assert m and m[4] == m[1].upper() and m[3] == m[2].upper()
    assert m[2].split("-")[0] in surrogates.GIVEN["latin", "m"] and m[5].split("-")[0] in surrogates.GIVEN["latin", "f"]
    m = re.fullmatch(r"Mrs (\S+) und Herr (\S+) (\S+), (\S+) \3", new[1])
    assert m and {surrogates.script(x) for x in m.groups()[1:]} == {"cyrillic"} and surrogates.script(m[1]) == "latin"


def test_no_two_people_become_one(spark):
    """Many names of all genders, by a plain version of the mapping: one to one, consistent, none a real name."""
    rng = random.Random(6)
    given = [n for (w, _), names in surrogates.GIVEN.items() if w == "latin" for n in names.split()]
    family = sorted({"".join(rng.choice("bdfgklmnprstv") + rng.choice("aeiou") for _ in range(3)).capitalize() for _ in range(1500)})
    mentions = [(rng.choice(["Mr ", "Mrs ", "Dr ", ""]), rng.choice(given), f) for f in family for _ in range(2)]
    rows = [(i if i % 3 else None, f"see {t}{g} {f} there" if i % 2 or not t else f"see {t}{f} there") for i, (t, g, f) in enumerate(mentions)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).cache()
    after = surrogates.replace_entities(df.withColumn("before", df["text"])).collect()
    names = {}
    for r in after:
        old, new = (surrogates.units(x) for x in (r["before"], r["text"]))
        words = r["text"].split(" ")[-(len(old) + 1) : -1]
        assert len(old) == len(words) and new
        for (_, _, kind, name), word in zip(old, words, strict=True):
            assert names.setdefault((kind, name), word) == word
    assert len(set(map(str.lower, names.values()))) == len(names)
    assert not {w.lower() for w in names.values()} & {name for _, name in names}
