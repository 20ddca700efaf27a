"""Language identification: known words first, shorter and shorter character n-grams for others."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallmat.llm.common import saved, small_batches

UNKNOWN = "und"
# Words and n-grams, the most frequent ones, that every task holds; the others are joined. Results do not depend on these.
VOCABULARY, HELD_GRAMS = 200_000, 200_000
# Log frequencies are whole multiples of 1 / UNIT, so that sums do not depend on their order.
UNIT = 1 << 20
LENGTHS = (4, 3, 2, 1)
# Added to every count.
SMOOTH_WORD, SMOOTH_GRAM = 0.1, 0.5
# Share of a word's n-grams that must be known for their length to be used.
COVERED = 0.5
# Evidence of so many words at most makes the score.
CERTAIN_WORDS = 20
# Bytes of text handled at a time.
SLICE = 2_000_000
NOT_LETTERS = r"[^\p{L}]+"


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct lower-case words, the code of each word occurrence, and the text of each occurrence."""
    plain = pc.replace_substring_regex(pc.utf8_lower(texts.fill_null("")), NOT_LETTERS, " ")
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(plain))
    offsets = lists.offsets.to_numpy()
    coded = lists.flatten().dictionary_encode()
    distinct = coded.dictionary
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    rows = np.repeat(np.arange(len(texts)), np.diff(offsets))
    empty = pc.index(distinct, pa.scalar("", distinct.type)).as_py()
    held = codes != empty
    return distinct, codes[held], rows[held]


def slices(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Parts of a batch with a bounded amount of text each, with the number of their first row."""
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + SLICE)))
        yield start, texts.slice(start, stop - start)
        start = stop


def gram_keys(words: list[str], length: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit keys of the n-grams of words, marked at both ends, and the word of each."""
    flat = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    sizes = np.array([len(w) + 2 for w in words], dtype=np.int64)
    owner = np.repeat(np.arange(len(words)), sizes)
    if len(flat) < length:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    mixed = np.zeros(len(flat) - length + 1, dtype=np.uint64)
    for i in range(length):
        mixed = (mixed ^ flat[i : len(flat) - length + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    inside = owner[: len(mixed)] == owner[length - 1 :]
    return mixed[inside].view(np.int64), owner[: len(mixed)][inside]


@dataclass(frozen=True)
class Frequent:
    """The most frequent words and n-grams with their log frequencies by language, as every task holds them.

    ``words`` gives the row of a word in ``word_logs``; ``grams`` has sorted keys by length, ``gram_logs`` a row each.
    """

    words: dict[str, int]
    word_logs: np.ndarray
    grams: dict[int, np.ndarray]
    gram_logs: dict[int, np.ndarray]

    def read(self, texts: pa.Array) -> pa.StructArray:
        """Per text its number of words, the summed logs of those held here, and the others with their counts."""
        size = self.word_logs.shape[1]
        numbers, known, sizes, rare, counts = [], [], [], [], []
        for _, part in slices(texts):
            distinct, codes, rows = words_of(part)
            at = np.array([self.words.get(w, -1) for w in distinct.to_pylist()], dtype=np.int64)
            numbers.append(np.bincount(rows, minlength=len(part)))
            held = at[codes] >= 0
            logs = self.word_logs[at[codes[held]]]
            known.append(np.stack([np.bincount(rows[held], logs[:, j], len(part)) for j in range(size)], axis=1).astype(np.int64))
            pairs, n = np.unique(rows[~held] * len(distinct) + codes[~held], return_counts=True)
            sizes.append(np.bincount(pairs // max(len(distinct), 1), minlength=len(part)))
            rare.append(distinct.take(pa.array(pairs % max(len(distinct), 1))))
            counts.append(n)
        offsets = lambda n: pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
        others = pa.StructArray.from_arrays([pa.concat_arrays([r.cast(pa.string()) for r in rare]), pa.array(np.concatenate(counts).astype(np.int64))], ["word", "n"])
        return pa.StructArray.from_arrays(
            [
                pa.array(np.concatenate(numbers).astype(np.int64)),
                pa.ListArray.from_arrays(offsets(np.full(len(texts), size)), pa.array(np.concatenate(known).ravel())),
                pa.ListArray.from_arrays(offsets(np.concatenate(sizes)), others),
            ],
            ["n", "known", "rare"],
        )

    def back_off(self, words: list[str]) -> Iterator[pd.DataFrame]:
        """Per length and word: its n-grams, how many of them are held here, their summed logs, and the keys of the others.

        A word goes on to shorter n-grams unless those held here cover it.
        """
        left = np.arange(len(words))
        for length in LENGTHS:
            if not len(left):
                return
            keys, owner = gram_keys([words[i] for i in left], length)
            at = np.searchsorted(self.grams[length], keys)
            some = at < len(self.grams[length])
            some[some] = self.grams[length][at[some]] == keys[some]
            total, hits = np.bincount(owner, minlength=len(left)), np.bincount(owner[some], minlength=len(left))
            logs = self.gram_logs[length][at[some]]
            sums = np.stack([np.bincount(owner[some], logs[:, j], len(left)) for j in range(logs.shape[1])], axis=1).astype(np.int64)
            others = np.split(keys[~some], np.cumsum(np.bincount(owner[~some], minlength=len(left)))[:-1])
            yield pd.DataFrame(
                {"word": [words[i] for i in left], "length": length, "total": total, "hits": hits, "sums": list(sums), "open": others}
            )
            left = left[~_covered(hits, total)]


def _covered(hits, total):
    """Whether so many known n-grams of a word are enough; of numbers or columns."""
    return (hits > 0) & (hits >= COVERED * total)


@dataclass(frozen=True)
class Model:
    """Log frequencies by language: ``words`` ``(word, logs)`` and ``grams`` ``(length, key, logs)`` are saved tables of
    everything that was learned; ``frequent`` is their bounded part that tasks hold.
    """

    languages: list[str]
    frequent: Frequent | None = None
    word_table: DataFrame | None = None
    gram_table: DataFrame | None = None

    @property
    def words(self) -> dict[str, int]:
        return self.frequent.words

    @property
    def grams(self) -> dict[int, np.ndarray]:
        return self.frequent.grams

    def logs_of(self, words: DataFrame) -> DataFrame:
        """``(word, logs)`` of distinct words: of learned ones their own, of others the mean of their n-grams.

        A word of which no length is covered has no row. N-grams that tasks do not hold are joined by key.
        """
        size = len(self.languages)
        looked = saved(words.join(self.word_table, "word", "left"))
        shared = words.sparkSession.sparkContext.broadcast(self.frequent)

        def back_off(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield from shared.value.back_off(batch["word"].to_list())

        parts = saved(
            looked.where("logs IS NULL").select("word").mapInPandas(back_off, "word string, length int, total long, hits long, sums array<long>, open array<long>")
        )
        others = parts.select("word", "length", F.explode("open").alias("key")).join(self.gram_table, ["length", "key"])
        found = others.groupBy("word", "length").agg(F.count(F.lit(1)).alias("more"), _added("logs", size).alias("further"))
        none = F.array_repeat(F.lit(0).cast("long"), size)
        whole = parts.join(found, ["word", "length"], "left").select(
            "word",
            "length",
            "total",
            (F.col("hits") + F.coalesce("more", F.lit(0))).alias("hits"),
            F.zip_with("sums", F.coalesce("further", none), lambda a, b: a + b).alias("sums"),
        )
        enough = whole.where(_covered(F.col("hits"), F.col("total")))
        mean = F.transform("sums", lambda s: F.floor(s / F.col("hits")))
        longest = enough.select("word", F.struct("length", mean.alias("logs")).alias("best")).groupBy("word").agg(F.max("best").alias("best"))
        return looked.where("logs IS NOT NULL").unionByName(longest.select("word", F.col("best.logs").alias("logs")))

    def vectors(self, words: list[str]) -> np.ndarray:
        """A row of log frequencies for each of a few words; zeros where no n-gram is known."""
        spark = self.word_table.sparkSession
        rows = spark.createDataFrame([(w,) for w in sorted(set(words))], "word string")
        found = {r["word"]: r["logs"] for r in self.logs_of(rows).collect()}
        return np.array([found.get(w, [0] * len(self.languages)) for w in words], dtype=np.float64) / UNIT

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and score of each of a few texts."""
        rows = self.word_table.sparkSession.createDataFrame(list(enumerate(texts.to_pylist())), "doc_id long, text string")
        found = sorted(identify(rows, self).collect())
        return [r["lang_pred"] for r in found], np.array([r["score"] for r in found])


def _added(logs: str, size: int, times: Column | None = None) -> Column:
    """Sum of arrays over rows, each ``times`` a number."""
    one = F.lit(1) if times is None else times
    return F.array(*[F.sum(one * F.col(logs)[j]) for j in range(size)])


def _most_frequent(counted: DataFrame, most: int) -> DataFrame:
    """Rows of largest ``n``, ``most`` of them at most; where to cut is read from a histogram."""
    level = F.floor(F.log2("n") * 16).cast("int")
    cut = None
    for r in sorted(counted.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("rows")).collect(), key=lambda r: -r["level"]):
        most -= r["rows"]
        if most < 0:
            break
        cut = r["level"]
    return counted.where(F.lit(False) if cut is None else level >= cut)


def _logs(names: list[str], smooth: float, mass: list[Column]) -> Column:
    return F.array(*[F.round(F.log((F.col(c) + smooth) / m) * UNIT).cast("long") for c, m in zip(names, mass, strict=True)])


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Count words over all documents whose language is not null, and n-grams over all their distinct words.

    Words are counted within a task first. N-grams count once for each distinct word, as unseen words are like rare
    ones. All words and n-grams that occurred are kept, in saved tables; the driver gets one row per language, histograms of
    counts, and the most frequent ``VOCABULARY`` and ``HELD_GRAMS``, which spare joins. Null texts have no words,
    long texts are read whole, repeated rows count again; an empty table teaches no language.
    """
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(1).dictionary_encode()
            of_row, n_langs = langs.indices.to_numpy(), len(langs.dictionary)
            for start, part in slices(batch.column(0)):
                distinct, codes, rows = words_of(part)
                pairs, n = np.unique(codes * n_langs + of_row[start + rows], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [langs.dictionary.take(pa.array(pairs % n_langs)), distinct.take(pa.array(pairs // n_langs)), pa.array(n)],
                    ["lang", "word", "n"],
                )

    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    counts = saved(
        rows.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    )
    totals = {r["lang"]: (r["n"], r["words"]) for r in counts.groupBy("lang").agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect()}
    languages = sorted(totals)
    if not languages:
        return Model([])
    code = {lang: j for j, lang in enumerate(languages)}
    names = [f"n{j}" for j in range(len(languages))]
    of_lang = [F.sum(F.when(F.col("lang") == lang, F.col("n")).otherwise(0)).alias(c) for lang, c in zip(languages, names, strict=True)]
    mass = [F.lit(totals[lang][0] + SMOOTH_WORD * totals[lang][1]) for lang in languages]
    words = saved(
        counts.groupBy("word").agg(*of_lang, F.sum("n").alias("n")).select("word", "n", _logs(names, SMOOTH_WORD, mass).alias("logs"))
    )

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, part in batch.groupby("lang")["word"]:
                for length in LENGTHS:
                    keys, n = np.unique(gram_keys(part.to_list(), length)[0], return_counts=True)
                    yield pd.DataFrame({"length": length, "lang": code[lang], "key": keys, "n": n})

    each = counts.select("lang", "word").mapInPandas(grams, "length int, lang int, key long, n long")
    of_code = [F.sum(F.when(F.col("lang") == j, F.col("n")).otherwise(0)).alias(c) for j, c in enumerate(names)]
    sums = saved(each.groupBy("length", "key").agg(*of_code, F.sum("n").alias("n")))
    per_length = sums.groupBy("length").agg(*[(F.sum(c) + SMOOTH_GRAM * F.count(F.lit(1))).alias(f"m{c}") for c in names])
    logs = _logs(names, SMOOTH_GRAM, [F.col(f"m{c}") for c in names])
    table = saved(sums.join(F.broadcast(per_length), "length").select("length", "key", "n", logs.alias("logs")))

    held = sorted(_most_frequent(words, VOCABULARY).collect())
    held_grams = sorted(_most_frequent(table, HELD_GRAMS).collect())
    matrix = lambda rows: np.array([r["logs"] for r in rows], dtype=np.int64).reshape(len(rows), len(languages))
    by_length = {length: [r for r in held_grams if r["length"] == length] for length in LENGTHS}
    frequent = Frequent(
        {r["word"]: i for i, r in enumerate(held)},
        matrix(held),
        {length: np.array([r["key"] for r in rows], dtype=np.int64) for length, rows in by_length.items()},
        {length: matrix(rows) for length, rows in by_length.items()},
    )
    return Model(languages, frequent, words.select("word", "logs"), table.select("length", "key", "logs"))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, lang_pred, score)``: one row per document.

    The sum of log frequencies of all words of the whole text decides. Texts are read once: a task adds up the words
    it holds and hands on the others with their counts; those are looked up by a join, each distinct word once.
    ``score``, from 0 to 1, is the predicted language's share of the evidence. A text that is null or has no letter is
    ``und`` with score 0, and so is every text if nothing was learned. Ties go to the first language in order. Null and
    repeated ids are handled like others; an empty table gives no rows; other columns are not read.
    """
    small_batches(docs.sparkSession)
    if not model.languages:
        return docs.select(F.col(id_col).alias("doc_id"), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model.frequent)
    size = len(model.languages)

    @F.arrow_udf("n long, known array<long>, rare array<struct<word: string, n: long>>")
    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield shared.value.read(texts)

    one = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"), read(F.col(text_col)).alias("found"))
    texts = saved(one.select("doc_id", "row", "found.*"))
    rare = texts.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.n")
    vectors = saved(model.logs_of(rare.select("word").distinct()))
    more = rare.join(vectors, "word").groupBy("row").agg(_added("logs", size, F.col("n")).alias("more"))
    none = F.array_repeat(F.lit(0).cast("long"), size)
    sums = texts.join(more, "row", "left").select(
        "doc_id", "n", F.zip_with("known", F.coalesce("more", none), lambda a, b: a + b).alias("sums")
    )
    best = F.array_max("sums")
    weight = F.least("n", F.lit(CERTAIN_WORDS)) / F.col("n") / UNIT
    share = 1 / F.aggregate("sums", F.lit(0.0), lambda s, x: s + F.exp((x - best) * weight))
    names = F.array(*map(F.lit, model.languages))
    label = F.get(names, (F.array_position("sums", best) - 1).cast("int"))
    read_any = F.col("n") > 0
    return sums.select(
        "doc_id", F.when(read_any, label).otherwise(UNKNOWN).alias("lang_pred"), F.when(read_any, share).otherwise(0.0).alias("score")
    )
