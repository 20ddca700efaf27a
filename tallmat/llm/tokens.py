"""Token ids of whole texts, with repeated words tokenised once."""

from __future__ import annotations

import os
import re
import sys
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Words whose ids a task keeps unless told otherwise; when full, it starts anew.
CACHED = 300_000
# Bytes of text that are split at a time, about.
SLICE = 8_000_000
# A space between two of these is a place where both kinds of tokenizer split whatever stands around it.
SOLID = r"!-~\p{L}\p{N}"
# Marks a word without a space before it. A text that has one itself is tokenised as a whole.
GLUED = "\x00"
IRREGULAR = rf"(^ )|( $)|( [^{SOLID}])|([^{SOLID}] )"
# A run of marks starts behind a letter, unless it may be a contraction or an accent; a word starts behind a line end.
MARK = r"(\p{L})([^\s\p{L}\p{N}\p{M}'])"
LINE = r"([^\s\p{L}\p{N}'])\n(\p{L})"


# Name of a module of a worker that holds what tokenizers with ``keep`` have learned. This file is shipped with each task, so
# its own variables are new in every task.
KEPT = "_tallmat_kept_words"


class WordTokenizer:
    """Ids of the tokenizers library, the same as for each text as a whole.

    ``leading_space``: the tokenizer keeps a space with the word after it (byte-level BPE), so texts are cut
    before single spaces between solid characters, and other texts are tokenised as they are. Otherwise it drops
    white space, and texts are cut at ASCII white space. No pre-token or special token reaches across such a
    cut, so the ids of the parts are those of the text. ``lower``: A-Z may be lower-cased first. ``keep``: the
    tasks of a worker share what they learn, ``cached`` words at most.
    """

    def __init__(self, path: str, leading_space: bool, lower: bool = False, cached: int | None = None, slice_bytes: int | None = None, keep: bool = False):
        self.path, self.leading_space, self.lower, self.cached = path, leading_space, lower, cached
        self.slice_bytes, self.keep = slice_bytes or SLICE, keep
        self.loaded = None

    def __getstate__(self):
        return self.__dict__ | {"loaded": None}

    def _state(self):
        """The tokenizer and the ids known so far; they live as long as the task, or as the worker with ``keep``."""
        kind = repr((self.path, self.leading_space, self.lower))
        kept = vars(sys.modules.setdefault(KEPT, ModuleType(KEPT))) if self.keep else {}
        if self.loaded is None:
            self.loaded = kept.get(kind)
        if self.loaded is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(self.path)
            first = np.zeros(max(tokenizer.get_vocab().values()) + 1, dtype=bool)
            for token, i in tokenizer.get_vocab().items():
                first[i] = token.startswith("Ġ") if self.leading_space else token.endswith("</w>")
            special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
            # The dotted capital I is lower-cased to a letter and an accent.
            own = [IRREGULAR] if self.leading_space else ["İ"]
            odd = "|".join([r"\x00", *map(re.escape, special), *own])
            kept[kind] = self.loaded = (tokenizer, first, odd, {})
        return self.loaded

    def _learn(self, words: list[str], known: dict[str, bytes]) -> None:
        """Add ids of new words.

        Words of letters are one pre-token each; many are tokenised as one text, which is cut at the ids that
        begin or end a word.
        """
        tokenizer, first, _, _ = self._state()
        plain, glued, other = [], [], []
        for w in words:
            (plain if w.isalpha() else glued if w[:1] == GLUED and w[1:].isalpha() else other).append(w)
        line = tokenizer.token_to_id("Ċ")
        for some, lead, between in ((plain, " " * self.leading_space, " "), (glued, "", "\n")):
            for at in range(0, len(some), 2000):
                part = some[at : at + 2000]
                text = lead + between.join(w.lstrip(GLUED) for w in part)
                ids = np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")
                if some is glued:
                    ends = np.append(np.flatnonzero(ids == line), len(ids))
                    starts = np.append(0, ends[:-1] + 1)
                elif self.leading_space:
                    starts = np.flatnonzero(first[ids])
                    ends = np.append(starts[1:], len(ids))
                else:
                    ends = np.flatnonzero(first[ids]) + 1
                    starts = np.append(0, ends[:-1])
                if len(ends) != len(part):  # some letter is lower-cased to two characters
                    other.extend(part)
                    continue
                flat = ids.tobytes()
                for word, start, end in zip(part, (starts * 4).tolist(), (ends * 4).tolist(), strict=True):
                    known[word] = flat[start:end]
        space = " " if self.leading_space else ""
        whole = [w[1:] if w[:1] == GLUED else space + w if w else "" for w in other]
        for word, e in zip(other, tokenizer.encode_batch(whole, add_special_tokens=False), strict=True):
            known[word] = np.array(e.ids, dtype="<u4").tobytes()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, and the offsets of each text in them. A null is empty."""
        texts = texts.cast(pa.large_string()).fill_null("")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        parts, counts, start = [], [], 0
        while start < len(texts):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + self.slice_bytes)))
            ids, n = self._encode(texts.slice(start, stop - start))
            parts.append(ids)
            counts.append(n)
            start = stop
        flat = np.concatenate(parts) if parts else np.empty(0, np.uint32)
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(counts))]) if counts else np.zeros(1)
        return flat, offsets.astype(np.int64)

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        tokenizer, _, irregular, known = self._state()
        odd, whole = pc.match_substring_regex(texts, irregular), {}
        for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
            whole[i] = np.array(tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, dtype="<u4")
        texts = pc.if_else(odd, "", texts)
        if self.lower:
            # Lower-casing could make a special token, so such texts stay as they are.
            lowered = pc.ascii_lower(texts)
            texts = pc.if_else(pc.match_substring_regex(lowered, irregular), texts, lowered)
        # Words are known more often without what stands behind them.
        if self.leading_space:
            texts = pc.replace_substring_regex(texts, MARK, rf"\1 {GLUED}\2")
            texts = pc.replace_substring_regex(texts, LINE, f"\\1\n {GLUED}\\2")
        else:
            texts = pc.replace_substring_regex(texts, MARK, r"\1 \2")
        if self.leading_space:
            lists = pc.split_pattern(pc.binary_join_element_wise(*(pa.scalar(x, pa.large_string()) if isinstance(x, str) else x for x in (GLUED, texts, ""))), " ")
        else:
            lists = pc.ascii_split_whitespace(texts)
        offsets = lists.offsets.to_numpy()
        coded = lists.flatten().dictionary_encode()
        distinct, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        new = [w for w in distinct if w not in known]
        if len(known) + len(new) > (self.cached or CACHED):
            known.clear()
            new = distinct
        self._learn(new, known)
        values = [known[w] for w in distinct]
        sizes = np.fromiter(map(len, values), dtype=np.int64, count=len(values)) // 4
        table = np.frombuffer(b"".join(values), dtype="<u4")
        begins = np.cumsum(sizes) - sizes
        n = sizes[codes]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(begins[codes] - (ends - n), n) + np.arange(total)
        ids = table[at]
        bounds = np.concatenate([[0], ends])[offsets - offsets[0]]
        counts = np.diff(bounds)
        if whole:
            pieces = [whole.get(i, ids[bounds[i] : bounds[i + 1]]) for i in range(len(texts))]
            ids, counts = np.concatenate(pieces), np.array([len(p) for p in pieces])
        return ids, counts
