"""Token ids in a compact binary form: static range asymmetric numeral system, blocks that decode apart."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallmat.llm.common import gathered, give_back, small_batches
from tallmat.llm.tokens import WordTokenizer

END_ID = 2
# Frequencies add up to 2**PRECISION; states are kept from 2**31 up to 2**63 and give off 32-bit words.
PRECISION = 20
LOW = 1 << 31
# Interleaved states of a block; token i belongs to state i mod LANES.
LANES = 2048
# Tokens of a block, about: it ends with the document that reaches so many. Tokens between checkpoints.
BLOCK_TOKENS = 1 << 20
CHECKPOINT = 1 << 19
# Documents tokenised at a time.
ROWS = 4000
FORMAT = b"RANS1"


def tokenizer() -> WordTokenizer:
    import public_tokenizers

    return WordTokenizer(public_tokenizers.path("word_bpe_49k.json"), leading_space=False, lower=True, cached=500_000, keep=True)


@dataclass(frozen=True)
class Table:
    """Frequencies of all symbols, none below 1 that occurs, and their running sums."""

    freqs: np.ndarray
    starts: np.ndarray

    @classmethod
    def of(cls, counts: np.ndarray) -> Table:
        """Scale counts to 2**PRECISION; what rounding leaves over goes to, or comes from, the largest."""
        total, room = max(int(counts.sum()), 1), 1 << PRECISION
        used = counts > 0
        freqs = np.where(used, np.maximum(1, (counts.astype(np.float64) * room / total).astype(np.int64)), 0)
        if not used.any():
            freqs = freqs.copy()
            freqs[0] = 1
        over = int(freqs.sum()) - room
        for at in np.argsort(-freqs, kind="stable").tolist():
            if over <= 0:
                break
            taken = min(over, int(freqs[at]) - 1)
            freqs[at] -= taken
            over -= taken
        freqs[int(freqs.argmax())] -= over
        return cls(freqs.astype(np.uint64), (np.cumsum(freqs) - freqs).astype(np.uint64))

    def symbols(self) -> np.ndarray:
        """The symbol of each of the 2**PRECISION slots."""
        return np.repeat(np.arange(len(self.freqs), dtype=np.uint32), self.freqs.astype(np.int64))


def encode(ids: np.ndarray, table: Table) -> bytes:
    """One block. Steps of ``LANES`` tokens are coded from the last to the first.

    Layout: the format, number of tokens, of words and of checkpoints, a checksum of the ids, for each
    checkpoint its word position and states, the words. The first checkpoint is the start.
    """
    n = len(ids)
    steps = -(-n // LANES)
    fill = np.uint32(int(table.freqs.argmax()))
    padded = np.full(steps * LANES, fill, dtype=np.uint32)
    padded[:n] = ids
    rows = padded.reshape(steps, LANES)
    freq, start = table.freqs[rows], table.starts[rows]
    if steps and not freq.all():
        raise ValueError("a token has no frequency")
    state = np.full(LANES, LOW, dtype=np.uint64)
    words: list[np.ndarray] = []
    counts = np.zeros(steps, dtype=np.int64)
    marks = {}
    shift, low, word = np.uint64(PRECISION), np.uint64(0xFFFFFFFF), np.uint64(32)
    roof = np.uint64((LOW >> PRECISION) << 32)
    for s in range(steps - 1, -1, -1):
        f = freq[s]
        full = state >= roof * f
        given = state[full]
        words.append((given & low).astype("<u4"))
        counts[s] = len(given)
        state[full] = given >> word
        quotient = state // f
        state = (quotient << shift) + (state - quotient * f) + start[s]
        if s * LANES % CHECKPOINT == 0:
            marks[s] = state.copy()
    flat = np.concatenate([np.empty(0, "<u4"), *reversed(words)])
    position = np.cumsum(counts) - counts
    head = np.array([n, len(flat), len(marks), zlib.crc32(ids.astype("<u4").tobytes())], dtype="<u4").tobytes()
    saved_states = b"".join(np.array([position[s]], dtype="<u8").tobytes() + marks[s].astype("<u8").tobytes() for s in sorted(marks))
    return FORMAT + head + saved_states + flat.tobytes()


def decode(block: bytes, table: Table, slots: np.ndarray | None = None) -> np.ndarray:
    """The ids of a block; all stretches between checkpoints are decoded side by side. The checksum is checked."""
    if block[: len(FORMAT)] != FORMAT:
        raise ValueError("not a block of this format")
    slots = table.symbols() if slots is None else slots
    at = len(FORMAT)
    n, n_words, n_marks, checksum = (int(x) for x in np.frombuffer(block, "<u4", 4, at))
    at += 16
    record = np.dtype([("position", "<u8"), ("states", "<u8", (LANES,))])
    marks = np.frombuffer(block, record, n_marks, at)
    words = np.frombuffer(block, "<u4", n_words, at + n_marks * record.itemsize).astype(np.uint64)
    steps, stretch = -(-n // LANES), CHECKPOINT // LANES
    out = np.zeros((n_marks, stretch, LANES), dtype=np.uint32)
    state = marks["states"].astype(np.uint64)
    position = marks["position"].astype(np.int64)
    mask, shift = np.uint64((1 << PRECISION) - 1), np.uint64(PRECISION)
    words = np.append(words, np.uint64(0))
    for s in range(min(stretch, steps)):
        # The last stretch may be shorter.
        live = n_marks if (n_marks - 1) * stretch + s < steps else n_marks - 1
        x = state[:live]
        slot = x & mask
        symbol = slots[slot.astype(np.int64)]
        out[:live, s] = symbol
        x = table.freqs[symbol] * (x >> shift) + slot - table.starts[symbol]
        short = x < LOW
        turn = np.cumsum(short, axis=1)
        place = np.minimum(position[:live, None] + turn - 1, n_words)
        x = np.where(short, (x << np.uint64(32)) | words[place], x)
        state[:live] = x
        position[:live] += turn[:, -1]
    ids = out.reshape(-1)[:n]
    if zlib.crc32(ids.astype("<u4").tobytes()) != checksum:
        raise ValueError("a block's checksum does not match")
    return ids


def _tokenised(docs: DataFrame, words: WordTokenizer, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """``(part, start, doc_id, n, ids)`` in ascending order of id; ``start`` counts ids from the start of the part."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ranged = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())

    def tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, start = TaskContext.get().partitionId(), 0
        for batch in gathered(batches):
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                ids, offsets = words.encode(some.column(1))
                whole = np.insert(ids, offsets[1:], end_id)
                ends = offsets + np.arange(len(offsets))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(some.num_rows, part, np.int32)),
                        pa.array(start + ends[:-1]),
                        some.column(0),
                        pa.array(np.diff(ends)),
                        pa.array([whole[a:b].astype("<u2").tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary()),
                    ],
                    ["part", "start", "doc_id", "n", "ids"],
                )
                start += int(ends[-1])
        words.loaded = None
        give_back()

    return ranged.mapInArrow(tokenised, "part int, start long, doc_id long, n long, ids binary")


def write_tokens(docs: DataFrame, path: str, words: WordTokenizer | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of all documents, in ascending order of id, under ``path``.

    ``path/blocks`` holds one row per block: ``start`` (ids of all documents before it), the ids and lengths of its
    documents in order, and the coded ``payload``. ``path/table`` holds the shared frequencies. A null or empty text is its end id alone; null ids come first; rows that repeat an
    id are in order of text. An empty table gives no blocks.

    Texts are tokenised once; the ids are saved, counted, and coded where they lie. One frequency table of the
    whole corpus is shared. The driver holds it, and one number per partition.
    """
    spark = docs.sparkSession
    words = words or tokenizer()
    stage = f"{path}/ids"
    _tokenised(docs, words, end_id, id_col, text_col).write.option("compression", "zstd").parquet(stage)
    ids = spark.read.parquet(stage)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << 16, dtype=np.int64)
        for batch in batches:
            flat = b"".join(batch.column(0).to_pylist())
            held += np.bincount(np.frombuffer(flat, "<u2"), minlength=1 << 16)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at])], ["id", "n"])

    counted = ids.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    counts = np.zeros(1 << 16, dtype=np.int64)
    for row in counted.collect():
        counts[row["id"]] = row["n"]
    table = Table.of(counts)
    used = np.flatnonzero(table.freqs)
    frequencies = [(int(i), int(table.freqs[i])) for i in used]
    spark.createDataFrame(frequencies, "id int, freq long").coalesce(1).write.parquet(f"{path}/table")

    sizes = {r["part"]: r["n"] for r in ids.groupBy("part").agg(F.sum("n").alias("n")).collect()}
    base, total = {}, 0
    for part in sorted(sizes):
        base[part], total = total, total + sizes[part]

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, lengths, payload, start, end = [], [], [], 0, 0

        def block():
            ids = np.frombuffer(b"".join(payload), "<u2").astype(np.uint32)
            row = [[start], [keys], [lengths], [encode(ids, table)]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, kinds, strict=True)], names)

        for batch in batches:
            starts = [base[p] + s for p, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            doc_ids, ns = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for i in range(batch.num_rows):
                if keys and (end - start >= BLOCK_TOKENS or starts[i] != end):
                    yield block()
                    keys, lengths, payload = [], [], []
                if not keys:
                    start = end = starts[i]
                keys.append(doc_ids[i])
                lengths.append(ns[i])
                payload.append(batch.column(4)[i].as_py())
                end += ns[i]
        if keys:
            yield block()

    names = ["start", "doc_ids", "lengths", "payload"]
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
    blocks = ids.mapInArrow(coded, "start long, doc_ids array<long>, lengths array<long>, payload binary")
    blocks.write.option("compression", "none").parquet(f"{path}/blocks")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n, ids)``: the documents back from their blocks, each block on its own.

    ``start`` counts the ids of all documents before; ``ids`` are little-endian 32-bit integers.
    """
    freqs = np.zeros(1 << 16, dtype=np.int64)
    for row in spark.read.parquet(f"{path}/table").collect():
        freqs[row["id"]] = row["freq"]
    table = Table(freqs.astype(np.uint64), (np.cumsum(freqs) - freqs).astype(np.uint64))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = table.symbols()
        for batch in batches:
            for i in range(batch.num_rows):
                ids = decode(batch.column(3)[i].as_py(), table, slots)
                ns = batch.column(2)[i].values.to_numpy()
                ends = np.cumsum(ns)
                if ends[-1] != len(ids):
                    raise ValueError("a block's lengths do not match its ids")
                columns = [
                    batch.column(1)[i].values,
                    pa.array(batch.column(0)[i].as_py() + ends - ns),
                    pa.array(ns),
                    pa.array([ids[e - n : e].astype("<u4").tobytes() for e, n in zip(ends, ns, strict=True)], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n", "ids"])

    return spark.read.parquet(f"{path}/blocks").mapInArrow(read, "doc_id long, start long, n long, ids binary")
