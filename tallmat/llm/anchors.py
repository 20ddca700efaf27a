"""SimHash near-duplicates, found at the codewords of a covering code."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallmat.llm.common import each_text, fresh, saved, small_batches
from tallmat.llm.components import components

SEED = 42
SHINGLE_WORDS = 3
THRESHOLD = 2
# The binary Golay code: length 23, covering radius 3, every word within 3 of exactly one codeword.
LENGTH, RADIUS = 23, 3
GENERATOR = 0b110001110101
# Shingles hashed at a time, so that memory does not grow with a text.
BLOCK = 1 << 17


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """The 64-bit SimHash of a text, as an unsigned number; 0 for a text without words."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < shingle_words:
        words, shingle_words = [b" ".join(words)], 1
    counts, total, digest = np.zeros(64, dtype=np.int64), len(words) - shingle_words + 1, xxhash.xxh64_intdigest
    for start in range(0, total, BLOCK):
        part = words[start : start + BLOCK + shingle_words - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(shingle_words)), strict=False))
        hashes = np.array([digest(s, SEED) for s in shingles], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > total, bitorder="little")
    return int(bits.view("<u8")[0])


def _syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders by the generator polynomial; equal for words that differ by a codeword."""
    rest = words.copy()
    for shift in range(LENGTH - 12, -1, -1):
        rest ^= ((rest >> (shift + 11)) & 1) * (GENERATOR << shift)
    return rest


def coset_patterns(threshold: int) -> list[list[np.ndarray]]:
    """For each syndrome and each excess 0..threshold, the error patterns of that coset.

    Excess 0 is the one pattern within the covering radius; excess e are those of weight radius + e.
    """
    out = [[np.empty(0, dtype=np.int64)] * (threshold + 1) for _ in range(1 << (LENGTH - 12))]
    for excess in range(threshold + 1):
        weights = range(RADIUS + 1) if excess == 0 else (RADIUS + excess,)
        patterns = np.array(
            [sum(1 << p for p in places) for w in weights for places in combinations(range(LENGTH), w)], dtype=np.int64
        )
        at = _syndromes(patterns)
        order = np.argsort(at, kind="stable")
        sorted_patterns = patterns[order]
        starts = np.searchsorted(at[order], np.arange(len(out) + 1))
        for s in range(len(out)):
            out[s][excess] = sorted_patterns[starts[s] : starts[s + 1]]
    return out


def anchors(prints: np.ndarray, table: list[list[np.ndarray]]) -> list[np.ndarray]:
    """For each fingerprint the anchors to compare it at, its own nearest anchor first.

    An anchor is a pair of codewords for bits 0-22 and 23-45. If x is within the covering radius of its
    anchor in both halves and y differs from x in at most ``threshold`` bits, y is within the radius plus its
    share of those bits, so y is sent to every anchor whose excesses over the radius add up to the threshold
    or less: some 60 anchors at threshold 2. ``table`` is from :func:`coset_patterns`.
    """
    threshold = len(table[0]) - 1
    mask = (1 << LENGTH) - 1
    low, high = prints & mask, (prints >> LENGTH) & mask
    splits = [(i, j) for i in range(threshold + 1) for j in range(threshold + 1 - i)]
    out = []
    for a, b, s, t in zip(low.tolist(), high.tolist(), _syndromes(low).tolist(), _syndromes(high).tolist(), strict=True):
        pairs = [((b ^ table[t][j])[:, None] << LENGTH | (a ^ table[s][i])[None, :]).ravel() for i, j in splits]
        out.append(np.concatenate(pairs))
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, print)``: one saved row per document, the fingerprint as a signed long."""

    small_batches(docs.sparkSession)

    @F.arrow_udf("long")
    def hashed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(np.array([fingerprint(t) for t in each_text(texts)], dtype=np.uint64).view(np.int64))

    return saved(docs.select(F.col(id_col).alias("doc_id"), hashed(F.col(text_col)).alias("print")))


def links(prints: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """``(a, b)``: every pair of ``(node, print)`` rows whose fingerprints differ in ``threshold`` bits or fewer.

    ``print`` must be distinct. Each pair comes once: the smaller node waits at its own anchor, and the
    larger one is sent to every anchor in reach. A fingerprint has a bounded number of such neighbours, and
    an anchor with many rows is a skewed join key, which Spark splits. Neither side is broadcast: Spark takes an
    exploded table to be as small as the one before, though it has some 60 rows for each of that.
    """

    @F.arrow_udf("array<long>")
    def sent(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = coset_patterns(threshold)
        for values in batches:
            found = anchors(values.to_numpy(zero_copy_only=False), table)
            ends = np.cumsum([0, *map(len, found)])
            flat = np.concatenate([np.empty(0, np.int64), *found])
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))

    rows = prints.select("node", "print", sent("print").alias("anchors"))
    waiting = rows.select(F.col("node").alias("a"), F.col("print").alias("print_a"), F.col("anchors")[0].alias("anchor"))
    visiting = rows.select(F.col("node").alias("b"), F.col("print").alias("print_b"), F.explode("anchors").alias("anchor"))
    near = F.bit_count(F.col("print_a").bitwiseXOR(F.col("print_b"))) <= threshold
    return waiting.join(visiting.hint("merge"), "anchor").where((F.col("a") < F.col("b")) & near).select("a", "b")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD
) -> DataFrame:
    """``(doc_id, print, component_id)``: one row per document.

    Texts are lower-cased in A-Z, split at ASCII white space and hashed in 3-word shingles, repeats included.
    Documents link when their fingerprints differ in at most ``threshold`` bits; ``component_id`` is the
    smallest id reachable. Equal fingerprints are one node with their smallest id, so copies cost one row
    each, whatever their number, and lose no link.

    A null or empty text, or one of white space, has fingerprint zero and links as such. A text of fewer than
    three words is one shingle. A row whose id is null links with nothing and has a null component. Rows that
    repeat an id are one node per fingerprint. An empty table gives no rows. Other columns are not read.
    """
    prints = fingerprints(docs, id_col, text_col)
    nodes = saved(
        prints.where("doc_id IS NOT NULL").groupBy("print").agg(F.min(F.col("doc_id").cast("long")).alias("node"))
    )
    return grouped(prints, nodes, saved(links(nodes, threshold)))


def grouped(prints: DataFrame, nodes: DataFrame, found: DataFrame) -> DataFrame:
    """``(doc_id, print, component_id)`` of ``(doc_id, print)`` rows, their ``(print, node)`` and the links of nodes."""
    # An id on several rows may stand in several nodes; it joins them.
    ids = prints.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("print").alias("print"), F.max("print").alias("last"))
    spread = ids.where("print <> last").select("doc_id")
    repeated = prints.join(spread, "doc_id").distinct().join(nodes, "print")
    bridges = repeated.select(F.col("doc_id").cast("long").alias("a"), F.col("node").alias("b"))
    roots = components(found.unionByName(bridges))
    at = nodes.join(roots, "node", "left").select("print", F.coalesce("component", "node").alias("root"))
    return prints.join(saved(at), "print", "left").select(
        "doc_id", "print", F.when(F.col("doc_id").isNotNull(), F.col("root")).alias("component_id")
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """The documents without near-duplicates: of each group the row with the smallest id, all columns kept.

    Rows whose id is null stay. Of rows that repeat the kept id one stays. Only the ids to remove are joined.
    """
    return keep_first(docs, near_duplicates(docs, id_col, text_col, threshold), id_col)


def keep_first(docs: DataFrame, found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The row with the smallest id of each group of ``(doc_id, component_id)``, as :func:`deduplicate` says."""
    groups = saved(found)
    gone = fresh(docs, "gone_id")[0]
    removed = saved(groups.where("doc_id <> component_id").select(F.col("doc_id").alias(gone)).distinct())
    kept = docs.join(removed, F.col(id_col) == F.col(gone), "left_anti")
    repeats = saved(
        groups.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias(gone)).count().where("count > 1").select(gone)
    )
    if repeats.limit(1).count() == 0:
        return kept
    same = F.col(id_col) == F.col(gone)
    once = kept.join(repeats, same, "left_semi").dropDuplicates([id_col])
    return kept.join(repeats, same, "left_anti").unionByName(once)
