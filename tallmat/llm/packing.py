"""Hierarchical packing of tokenised documents into windows of several lengths."""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallmat.llm.common import gathered, give_back, small_batches
from tallmat.llm.tokens import WordTokenizer

WINDOW = 1024
# Window lengths. A document goes to the shortest that holds what it has beyond full windows.
TIERS = (1024, 512, 256, 128)
# Tokens of one step group, and tokens that a task packs together.
STEP_TOKENS = 8 * WINDOW
POOL_TOKENS = 1 << 21
END_ID = 0

SCHEMA = (
    "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, "
    "tier int, padded int, step_group long"
)


def tokenizer(cached: int | None = None, slice_bytes: int | None = None) -> WordTokenizer:
    import public_tokenizers

    return WordTokenizer(public_tokenizers.path("byte_bpe_50k.json"), leading_space=True, cached=cached, slice_bytes=slice_bytes)


class Packer:
    """Packs the documents of one task, pool by pool; what does not fill a window waits for the next pool.

    A piece is ``(length, document, start)``; a window is a list of pieces that fill its tier exactly.
    """

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        self.tiers = tiers
        # What a document has beyond full windows, by tier, shortest piece first.
        self.waiting: dict[int, list[tuple[int, int, int]]] = {t: [] for t in tiers}
        self.windows: list[tuple[int, list[tuple[int, int, int]]]] = []

    def tier_of(self, length: int) -> int:
        return min(t for t in self.tiers if t >= length)

    def route(self, length: int, document: int, start: int) -> None:
        insort(self.waiting[self.tier_of(length)], (length, document, start))

    def add(self, document: int, length: int) -> None:
        longest = self.tiers[0]
        for start in range(0, length - longest + 1, longest):
            self.windows.append((longest, [(longest, document, start)]))
        if rest := length % longest:
            self.route(rest, document, length - rest)

    def _fitting(self, gap: int, tier: int) -> tuple[int, int, int] | None:
        """The longest waiting piece of this tier or a shorter one that fits into the gap, taken out."""
        for t in self.tiers:
            if t <= tier:
                queue = self.waiting[t]
                at = bisect_right(queue, (gap, float("inf"), 0))
                if at:
                    return queue.pop(at - 1)
        return None

    def _cut(self, gap: int, tier: int) -> tuple[int, int, int] | None:
        """The first ``gap`` tokens of the shortest waiting piece that is longer; the rest is routed anew."""
        for t in reversed(self.tiers):
            queue = self.waiting[t]
            at = bisect_right(queue, (gap, float("inf"), 0))
            if t <= tier and at < len(queue):
                length, document, start = queue.pop(at)
                self.route(length - gap, document, start + gap)
                return (gap, document, start)
        return None

    def pack(self) -> None:
        """Fill windows of every tier, the longest first, gaps from the same or a shorter tier."""
        for tier in self.tiers:
            queue = self.waiting[tier]
            while queue:
                window, gap = [queue.pop()], tier
                gap -= window[0][0]
                while gap:
                    piece = self._fitting(gap, tier) or self._cut(gap, tier)
                    if piece is None:
                        break
                    window.append(piece)
                    gap -= piece[0]
                if gap:
                    for piece in window:
                        self.route(*piece)
                    break
                self.windows.append((tier, window))

    def finish(self) -> None:
        """Put what still waits into the longest window it fills; the last window is padded."""
        rest = [p for t in self.tiers for p in reversed(self.waiting[t])]
        self.waiting = {t: [] for t in self.tiers}
        left = sum(p[0] for p in rest)
        while left:
            tier = next((t for t in self.tiers if t <= left), left)
            window, gap = [], tier
            while gap:
                length, document, start = rest.pop(0)
                taken = min(gap, length)
                window.append((taken, document, start))
                if taken < length:
                    rest.insert(0, (length - taken, document, start + taken))
                gap -= taken
            left -= tier
            self.windows.append((tier, window))


def step_groups(windows: list[tuple[int, list[tuple[int, int, int]]]], step_tokens: int = STEP_TOKENS) -> np.ndarray:
    """A group for each window: groups hold windows of one length and about equal attention cost.

    Windows of a tier are dealt out in order of cost, there and back, to groups of ``step_tokens`` tokens.
    """
    out, first = np.zeros(len(windows), dtype=np.int64), 0
    by_tier: dict[int, list[int]] = {}
    for i, (tier, _) in enumerate(windows):
        by_tier.setdefault(tier, []).append(i)
    for tier, members in sorted(by_tier.items(), reverse=True):
        groups = max(1, -(-len(members) * tier // step_tokens))
        cost = [-sum(p[0] ** 2 for p in windows[i][1]) for i in members]
        for turn, at in enumerate(np.argsort(cost, kind="stable")):
            lap, place = divmod(turn, groups)
            out[members[at]] = first + (place if lap % 2 == 0 else groups - 1 - place)
        first += groups
    return out


def pack(docs: DataFrame, words: WordTokenizer | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids, doc_tokens, sequence_id, offset, tier, padded, step_group``.

    A document is its ids and ``end_id``. Full windows are cut from it; the rest goes to the tier of its size.
    Tiers are packed from long to short: a window takes the longest waiting pieces that fit, of its own or
    shorter tiers, and then the front of a longer one, so it is full to the token. Only the last window of a
    task may be short: its tokens beyond the tiers are padded to ``padded`` (the longest tier). ``ids`` are
    little-endian 32-bit integers; ``offset`` is the piece's place in its sequence. Tasks pack what they
    read, without a shuffle, so no source or group of copies gathers anywhere; ``sequence_id`` and
    ``step_group`` hold the number of the task.

    A null or empty text is its end id alone. Null and repeated ids are packed like others, each row for
    itself. An empty table gives no rows. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    words = words or tokenizer()
    id_type = docs.schema[id_col].dataType

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 32
        packer, pool, sequences, groups = Packer(), {}, 0, 0

        def emitted():
            nonlocal sequences, groups
            group = step_groups(packer.windows)
            pieces = [
                (doc, start, length, w, offset)
                for w, (_, window) in enumerate(packer.windows)
                for offset, (length, doc, start) in _laid(window)
            ]
            for at in range(0, len(pieces), 20_000):
                part = pieces[at : at + 20_000]
                tiers = [packer.windows[p[3]][0] for p in part]
                columns = [
                    pa.array([pool[p[0]][0] for p in part]),
                    pa.array([p[1] for p in part], pa.int64()),
                    pa.array([p[2] for p in part], pa.int64()),
                    pa.array([pool[p[0]][1][p[1] : p[1] + p[2]].tobytes() for p in part], pa.binary()),
                    pa.array([len(pool[p[0]][1]) for p in part], pa.int64()),
                    pa.array([base + sequences + p[3] for p in part], pa.int64()),
                    pa.array([p[4] for p in part], pa.int64()),
                    pa.array(tiers, pa.int32()),
                    pa.array([t if t & (t - 1) == 0 else WINDOW for t in tiers], pa.int32()),
                    pa.array([base + groups + int(group[p[3]]) for p in part], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays([columns[0].cast(id_arrow), *columns[1:]], names)
            sequences += len(packer.windows)
            groups += int(group.max()) + 1 if len(group) else 0
            packer.windows = []
            held = {p[1] for queue in packer.waiting.values() for p in queue}
            for doc in [d for d in pool if d not in held]:
                del pool[doc]

        count = tokens = 0
        id_arrow = None
        for batch in gathered(batches):
            id_arrow = batch.column(0).type
            ids, offsets = words.encode(batch.column(1))
            for row, key in enumerate(batch.column(0).to_pylist()):
                own = np.append(ids[offsets[row] : offsets[row + 1]], np.uint32(end_id))
                pool[count] = (key, own)
                packer.add(count, len(own))
                count, tokens = count + 1, tokens + len(own)
                if tokens >= POOL_TOKENS:
                    packer.pack()
                    yield from emitted()
                    tokens = 0
        packer.pack()
        packer.finish()
        if id_arrow is not None:
            yield from emitted()
        words.loaded = None
        give_back()

    names = ["doc_id", *(c.split()[0] for c in SCHEMA.split(", "))]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(packed, f"doc_id {id_type.simpleString()}, {SCHEMA}")


def _laid(window: list[tuple[int, int, int]]) -> Iterator[tuple[int, tuple[int, int, int]]]:
    offset = 0
    for piece in window:
        yield offset, piece
        offset += piece[0]
