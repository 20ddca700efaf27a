"""Document operators: edge cases, and comparison with plain versions."""

from __future__ import annotations

import pickle
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallmat.llm import anchors, language, mixture, ordinal, packing, rans, surrogates
from tallmat.llm.common import saved
from tallmat.llm.components import components
from tallmat.llm.tokens import WordTokenizer

public_tokenizers = pytest.importorskip("public_tokenizers")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# -- components and SimHash


def brute_components(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {n: find(n) for n in nodes}


def test_components_of_a_long_chain_a_star_and_loops(spark):
    chain = [(i, i + 1) for i in range(0, 300)]
    star = [(1000, 1000 + i) for i in range(1, 100)] + [(1050, 999)]
    edges = chain + star + [(5, 5), (7, 6), (6, 7)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {n for e in edges for n in e}
    assert {n: found.get(n, n) for n in nodes} == brute_components(nodes, edges)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_every_pair_within_the_threshold_and_no_other_is_linked(spark):
    rng = np.random.default_rng(3)
    prints = [int(x) for x in rng.integers(-(2**63), 2**63 - 1, 60)]
    for base in prints[:30]:
        for flips in (1, 2, 3, 4):
            value = base & (2**64 - 1)
            for bit in rng.choice(64, flips, replace=False):
                value ^= 1 << int(bit)
            prints.append(value - 2**64 if value >= 2**63 else value)
    prints = sorted(set(prints))
    df = spark.createDataFrame(list(enumerate(prints)), "node long, print long")
    near = {
        (i, j)
        for i, x in enumerate(prints)
        for j, y in enumerate(prints)
        if i < j and ((x ^ y) & (2**64 - 1)).bit_count() <= 2
    }
    assert len(near) > 60
    assert rows_of(anchors.links(df)) == sorted(near, key=repr)


def test_no_side_of_the_anchors_is_broadcast(spark):
    """An exploded table is 60 times as large as Spark takes it to be, and would fill the driver."""
    df = saved(spark.range(1000).select(F.col("id").alias("node"), F.xxhash64("id").alias("print")))
    plan = anchors.links(df)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_golay_cosets_are_perfect():
    table = anchors.coset_patterns(2)
    assert all(len(t[0]) == 1 for t in table) and sum(len(t[2]) for t in table) == 33649


def plain_fingerprint(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    if not shingles:
        return 0
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aB É\t\n\x0b\x1c  ßc", max_size=40))
def test_fingerprint(text):
    assert anchors.fingerprint(text) == plain_fingerprint(text)


def test_fingerprints_in_blocks(monkeypatch):
    text = " ".join(f"w{i % 37}x{i}" for i in range(500))
    whole = anchors.fingerprint(text)
    monkeypatch.setattr(anchors, "BLOCK", 7)
    assert anchors.fingerprint(text) == whole == plain_fingerprint(text)


def test_near_duplicates_edges(docs, odd, empty):
    found = rows_of(anchors.near_duplicates(docs))
    assert len(found) == docs.count() and found == rows_of(anchors.near_duplicates(odd))
    groups = {r[0]: r[2] for r in found}
    assert groups[1] == groups[2] == 1 and groups[4] == groups[5] == groups[6] == 4
    assert groups[None] is None
    kept = anchors.deduplicate(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 1, 3, 4, 7, 8, 9, 10]
    assert anchors.deduplicate(empty).count() == anchors.near_duplicates(empty).count() == 0


def test_one_row_stays_where_the_kept_id_repeats(spark):
    df = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (1, "other words stand here"), (2, "a b c d")], "doc_id long, text string")
    found = {(r["doc_id"], r["component_id"]) for r in anchors.near_duplicates(df).collect()}
    assert found == {(1, 1), (2, 1)}
    assert anchors.deduplicate(df).count() == 1


def test_near_duplicates_equal_brute_force(spark, tables):
    df = spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    links = [(i, j) for i in prints for j in prints if i < j and (prints[i] ^ prints[j]).bit_count() <= 2]
    expected = brute_components(prints, links)
    found = {r["doc_id"]: (r["print"] & (2**64 - 1), r["component_id"]) for r in anchors.near_duplicates(df).collect()}
    assert found == {i: (prints[i], expected[i]) for i in texts}


# -- quality


def test_grades_are_ordered_and_learnt(spark):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(300)]
    rows, ratings = [], []
    for i in range(600):
        grade = int(i % 3)
        text = [str(w) for w in rng.choice(words, 40)]
        text += ["awful"] * (grade == 0) + ["meh", "meh2"] * (grade == 1)
        rows.append((i, " ".join(rng.permutation(text))))
        if i < 450:
            ratings.append((i, grade))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = ordinal.grade_documents(df, spark.createDataFrame(ratings, "doc_id long, grade int"))
    by_grade = defaultdict(list)
    for r in found.collect():
        if r["doc_id"] >= 450:
            by_grade[r["doc_id"] % 3].append((r["grade"], r["tail"], r["selected"]))
    means = [np.mean([g for g, _, _ in by_grade[k]]) for k in range(3)]
    assert means[0] < means[1] < means[2]
    assert np.mean([s for _, _, s in by_grade[2]]) > 0.95 and np.mean([s for _, _, s in by_grade[0]]) < 0.05


def test_slopes_are_those_of_the_loss():
    rng = np.random.default_rng(2)
    scores, grades, cuts = rng.normal(size=20), rng.integers(0, 4, 20), np.array([-1.0, 0.2, 1.5])
    loss, by_score, by_cut = ordinal.loss_and_slopes(scores, grades, cuts)
    for i in range(20):
        up = scores.copy()
        up[i] += 1e-6
        assert (ordinal.loss_and_slopes(up, grades, cuts)[0] - loss) / 1e-6 == pytest.approx(by_score[i], abs=1e-4)
    for j in range(3):
        up = cuts.copy()
        up[j] += 1e-6
        assert (ordinal.loss_and_slopes(scores, grades, up)[0] - loss) / 1e-6 == pytest.approx(by_cut[j], abs=1e-3)


def test_grading_edges(spark, docs, odd, empty):
    ratings = spark.createDataFrame([(1, 2), (3, 1), (4, 0), (None, 1), (7, None), (8, 9), (1, 0)], "doc_id long, grade int")
    found = ordinal.grade_documents(odd, ratings)
    assert found.count() == docs.count()
    assert all(0 <= r["grade"] <= 2 and 0 <= r["tail"] <= 1 for r in found.collect())
    assert ordinal.grade_documents(empty, ratings).count() == 0
    unrated = ordinal.select_documents(odd, ratings.where("false"))
    assert unrated.columns == odd.columns and unrated.count() == docs.count()
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0), (3, 1, 0), (4, None, 0), (5, 1, None)], "doc_id long, quality int, toxic int")
    assert [r["grade"] for r in ordinal.grade_labels(labels).orderBy("doc_id").collect()] == [0, 1, 2, None, None]


def test_whole_long_texts_count(monkeypatch):
    text = "alpha " * 50 + "omega"
    whole = ordinal.tokens(text)
    monkeypatch.setattr(ordinal, "PIECE", 11)
    assert ordinal.tokens(text) == whole and "omega" in whole


def test_given_documents_are_kept_or_rejected(spark, tables):
    df, labels = (spark.read.parquet(f"{tables.replace('0.001', '0.01')}/{n}.parquet") for n in ("documents", "labels"))
    found = ordinal.grade_documents(df, ordinal.grade_labels(labels)).join(ordinal.grade_labels(labels), "doc_id")
    share = {k: [] for k in range(3)}
    for r in found.toDF("doc_id", "expected", "tail", "selected", "truth").collect():
        share[r["truth"]].append(r["selected"])
    assert np.mean(share[2]) > 0.99 and np.mean(share[0] + share[1]) < 0.2


# -- personal data


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ("write to a.b@mail.example.com today", ["email"]),
        ("+1 (459) 555-9246 10.1.2.3", ["phone", "ip"]),
        ("call (212) 555-1234 or 212-555-1234.", ["phone", "phone"]),
        ('token = "ab8ca1b325bc4f85aa6a79e73fc4cbfc2098878e"', ["secret"]),
        ("card 5295745161764470, 4111 1111 1111 1111", ["card", "card"]),
        ("Mr. John Smith met Mrs Anna Brown; Dr Иван Петров", ["person-m-latin", "person-f-latin", "person-m-cyrillic"]),
        ("GB82 WEST 1234 5698 7654 32", ["iban"]),
        ("123-45-6789", ["ssn"]),
        ("version 1.2.3 of 2024, 12 apples at 10:30; the token economy; mr. big", []),
        ("", []),
    ],
)
def test_entities(text, kinds):
    spans = surrogates.entities(text)
    assert [s[2] for s in spans] == kinds
    assert bool(kinds) <= bool(surrogates.hinted(pa.array([text])))


@pytest.mark.parametrize("value", ["4111111111111111", "5295745161764470"])
def test_cards_keep_their_check_digit_state(value):
    new = surrogates.surrogate("card", value, 0)
    assert len(new) == 16 and new != value and surrogates.luhn(new) == surrogates.luhn(value)


def test_replacing_entities(docs, odd, empty):
    new = surrogates.replace_entities(odd)
    assert new.columns == odd.columns and new.count() == odd.count()
    before, after = ({(r["doc_id"], r["n_chars"]): r["text"] for r in df.collect()} for df in (docs, new))
    for key, text in before.items():
        if not surrogates.entities(text):
            assert after[key] == text
    mails = [re.search(r"\S+@\S+", after[k])[0] for k in ((8, 55), (9, 35))]
    assert mails[0] == mails[1] != "jo.doe@mail.example.com" and mails[0].endswith(".example.com")
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", after[8, 55]) and "555-0199" not in after[8, 55]
    assert surrogates.replace_entities(empty).count() == 0


def test_collisions_are_resolved(spark, monkeypatch):
    original = surrogates.surrogate
    rows = [("ssn", f"00000000{i}") for i in range(6)] + [("ssn", "911111111")]

    def few(kind, canonical, attempt, key="k"):
        # First attempts collide with one another and with a real entity.
        return "911111111" if attempt == 0 else "922222222" if attempt == 1 else original(kind, canonical, attempt)

    monkeypatch.setattr(surrogates, "surrogate", few)
    given_ = surrogates.assign(spark.createDataFrame(rows, "kind string, canonical string")).collect()
    assert len({r["surrogate"] for r in given_}) == len(rows) == len(given_)
    assert not {r["surrogate"] for r in given_} & {r["canonical"] for r in given_}


# -- mixing


def test_mix_report(docs, odd, empty):
    rows = mixture.mix_report(odd).collect()
    assert len(rows) == docs.count() and all(r["taken"] <= 3 * r["size"] for r in rows)
    assert rows_of(mixture.mix_report(docs)) == rows_of(mixture.mix_report(docs.repartition(5)))
    by_source = {r["source"]: r for r in rows}
    assert by_source["b"]["size"] in (0, 8) and sum(r["size"] for r in rows if r["source"] is None) == 0
    total = sum(r["size"] for r in rows)
    assert sum({r["source"]: r["target"] for r in rows}.values()) == pytest.approx(total)
    assert all(r["target"] <= 3 * r["source_size"] for r in rows)
    mixed = mixture.mix(odd)
    assert mixed.columns == odd.columns and mixed.count() == sum(r["copies"] for r in rows)
    assert mixture.mix(empty).count() == mixture.mix_report(empty).count() == 0


def test_targets_are_reshared_until_none_is_above(spark):
    rows = [("a", 10), ("b", 1000), ("c", 20), (None, 400)]
    targets = {r["source"]: r["target"] for r in mixture.source_targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    assert targets["a"] == 30 and targets["c"] == 60
    assert targets[None] == pytest.approx((1430 - 90) / 3) and targets["b"] == pytest.approx(2 * (1430 - 90) / 3)


def test_targets_are_met_in_many_buckets(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, "w " * int(rng.integers(1, 60)), "hot" if i % 3 else f"s{i % 5}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    expected = rows_of(mixture.mix_report(df))
    monkeypatch.setattr(mixture, "BUCKET_ROWS", 40)
    found = mixture.mix_report(df)
    assert rows_of(found) == expected
    sums = {r["source"]: r for r in found.groupBy("source").agg({"taken": "sum", "target": "max"}).collect()}
    assert all(abs(r["sum(taken)"] - r["max(target)"]) < 60 for r in sums.values())


# -- language


def test_language_of_known_and_unseen_words(spark, docs, odd, empty):
    rows = [(i, "der hund und die katze laufen schnell nach hause", "de") for i in range(5)]
    rows += [(i, "the dog and the cat are running home quickly", "en") for i in range(5)]
    model = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    labels, scores = model.predict(pa.array(["Hund, Katze!", "cats running", "katzen laufend", None, "", "12 !?", "the"]))
    assert labels == ["de", "en", "de", "und", "und", "und", "en"]
    assert all(0 <= s <= 1 for s in scores) and scores[3] == 0
    found = language.identify(odd, model)
    assert found.count() == docs.count() and language.identify(empty, model).count() == 0
    nothing = language.learn(empty)
    assert {r["lang_pred"] for r in language.identify(docs, nothing).collect()} == {"und"}


def test_words_beyond_the_vocabulary_fall_back(spark, tables, monkeypatch):
    monkeypatch.setattr(language, "VOCABULARY", 40)
    df = spark.read.parquet(f"{tables}/documents.parquet")
    model = language.learn(df.where("doc_id % 3 != 1"))
    assert len(model.words) <= 40
    found = language.identify(df, model).join(df.select("doc_id", "lang"), "doc_id").where("doc_id % 3 = 1").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in found]) > 0.95


# -- tokens, coding, packing

ODD_TEXTS = [
    "", "  ", " a", "a  b", "it's the 're x", "a\n b \n c", "<|endoftext|> x <|endoftext|>y <|startoftext|>", "don't ' s",
    "3.5 x²  … “q” ,.", "a b c　d", "\x1c a \x1d b", "İstanbul ΣΑΣ x", "tab\tx y\x0bz  ", "e ́ x", "a!!, b. c.\n\n\nd.\n e ...",
    "İ<", "e\u0301 E\u0301, e\u0301.", "<\u0338 a<\u0338", "End.\nNext, it.\nFoo.", "x\x00y z, w", "<|STARTOFTEXT|> a", None, "word, word. word!! (word)  _x_ 12ab ab12", "é é.",
]


@pytest.mark.parametrize("make", [packing.tokenizer, rans.tokenizer])
def test_ids_are_those_of_the_whole_text(make, tables):
    from tokenizers import Tokenizer

    words = make()
    whole = Tokenizer.from_file(words.path)
    texts = pa.array(ODD_TEXTS + pq.read_table(f"{tables}/documents.parquet")["text"].to_pylist())
    ids, offsets = words.encode(texts)
    for i, text in enumerate(texts.to_pylist()):
        assert whole.encode(text or "", add_special_tokens=False).ids == ids[offsets[i] : offsets[i + 1]].tolist(), text


@settings(max_examples=120, deadline=None)
@given(st.lists(st.text(alphabet="aB é.,!'\n\t 1_-<|>\u0301\u0338İ", max_size=30), max_size=4))
def test_ids_of_random_texts(texts):
    from tokenizers import Tokenizer

    for make in (packing.tokenizer, rans.tokenizer):
        words = make()
        whole = Tokenizer.from_file(words.path)
        ids, offsets = words.encode(pa.array(texts, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("n", [0, 1, 2047, 2048, 2049, 70_000, 1_100_001])
def test_blocks_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.01, n), 49_000).astype(np.uint32)
    table = rans.Table.of(np.bincount(np.append(ids, 7), minlength=1 << 16))
    block = rans.encode(ids, table)
    assert np.array_equal(rans.decode(block, table), ids)
    if n > 60_000:
        assert len(block) < 2 * n
        broken = bytearray(block)
        broken[-len(block) // 3] ^= 4
        with pytest.raises(ValueError):
            rans.decode(bytes(broken), table)


def test_frequencies_add_up():
    counts = np.zeros(1 << 16, dtype=np.int64)
    counts[:49_000] = 1
    counts[5] = 10**9
    freqs = rans.Table.of(counts).freqs
    assert freqs.sum() == 1 << rans.PRECISION and freqs[:49_000].min() >= 1
    assert rans.Table.of(np.zeros(16, dtype=np.int64)).freqs.sum() == 1 << rans.PRECISION


def test_token_files(spark, docs, odd, empty, tmp_path):
    rans.write_tokens(odd, str(tmp_path / "t"))
    found = sorted(rans.read_tokens(spark, str(tmp_path / "t")).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in found] == [None, 1, 2, 2, 3, 4, 5, 6, 7, 8, 9, 10]
    assert [r["start"] for r in found] == np.cumsum([0, *(r["n"] for r in found[:-1])]).tolist()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    words = rans.tokenizer()
    for r in found:
        ids, _ = words.encode(pa.array([texts[r["doc_id"]]], pa.string()))
        assert np.frombuffer(r["ids"], "<u4").tolist() == [*ids.tolist(), 2]
    rans.write_tokens(empty, str(tmp_path / "e"))
    assert rans.read_tokens(spark, str(tmp_path / "e")).count() == 0


def check_packing(rows, lengths):
    """Every id in one piece, sequences gapless and within 1024, hardly any padding."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append((r["start"], r["length"]))
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        assert len(r["ids"]) == 4 * r["length"] and r["tier"] <= r["padded"] <= 1024
    for doc, pieces in by_doc.items():
        assert sum(n for _, n in pieces) == lengths[doc]
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    return padding, len(by_sequence)


def test_packing(docs, odd, empty):
    rows = packing.pack(odd.coalesce(1)).collect()
    words = packing.tokenizer()
    lengths = Counter()
    for r in docs.collect():
        lengths[r["doc_id"]] += len(words.encode(pa.array([r["text"]], pa.string()))[0]) + 1
    padding, _ = check_packing(rows, lengths)
    assert padding < 1024 and packing.pack(empty).count() == 0
    assert {r["length"] for r in rows if r["doc_id"] in (4, 5)} == {1}


def test_packed_ids_are_those_of_the_documents(spark, tables):
    df = spark.read.parquet(f"{tables}/documents.parquet")
    rows = packing.pack(df).collect()
    words = packing.tokenizer()
    whole = {r["doc_id"]: [*words.encode(pa.array([r["text"]]))[0].tolist(), 0] for r in df.collect()}
    padding, n = check_packing(rows, {k: len(v) for k, v in whole.items()})
    assert padding < 1024
    seen = Counter()
    for r in rows:
        part = whole[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == zlib.crc32(bytes(r["ids"])) and r["doc_tokens"] == len(whole[r["doc_id"]])
        seen.update((r["doc_id"], i) for i in range(r["start"], r["start"] + r["length"]))
    assert set(seen.values()) == {1} and len(seen) == sum(map(len, whole.values()))


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 3000), max_size=60), st.integers(1, 9))
def test_packer_places_every_token_once(sizes, pools):
    packer = packing.Packer()
    for i, size in enumerate(sizes):
        packer.add(i, size)
        if i % pools == 0:
            packer.pack()
    packer.pack()
    packer.finish()
    placed = Counter((d, s + j) for _, w in packer.windows for n, d, s in w for j in range(n))
    assert set(placed.values()) <= {1} and len(placed) == sum(sizes)
    assert all(sum(p[0] for p in w) == t for t, w in packer.windows)
    assert sum(t not in packing.TIERS for t, _ in packer.windows) <= 1
    groups = packing.step_groups(packer.windows)
    for g in set(groups.tolist()):
        held = [packer.windows[i][0] for i in np.flatnonzero(groups == g)]
        assert len(set(held)) == 1 and sum(held) <= packing.STEP_TOKENS


def test_word_memory_may_overflow(monkeypatch, tables):
    from tallmat.llm import tokens

    monkeypatch.setattr(tokens, "CACHED", 50)
    monkeypatch.setattr(tokens, "SLICE", 3000)
    texts = pq.read_table(f"{tables}/documents.parquet")["text"].slice(0, 20).combine_chunks()
    words = packing.tokenizer()
    small = WordTokenizer(words.path, leading_space=True)
    expected = words.encode(texts)
    assert all(np.array_equal(a, b) for a, b in zip(small.encode(texts), expected))


def test_kept_tokenizers_share_words_up_to_their_limit():
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = pa.array(["Some words here, 12 more", None, "words again and more"])
    plain, kept = (WordTokenizer(path, leading_space=False, lower=True, cached=6, keep=k) for k in (False, True))
    later = pickle.loads(pickle.dumps(kept))
    for t in (texts, pa.array(["quite different ones"]), texts):
        want = plain.encode(t)
        assert all(np.array_equal(a, b) for a, b in zip(want, kept.encode(t), strict=True))
        assert all(np.array_equal(a, b) for a, b in zip(want, later.encode(t), strict=True))
    assert later._state() is kept._state() and plain._state() is not kept._state()
