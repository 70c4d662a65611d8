"""Byte-level BPE ids of many texts at once.

Texts are cut into pretokens in numpy, equal pretokens are encoded once, and the ids of the most recent ones stay in a
table of bounded size. Texts with a special token's string or an apostrophe contraction take the library's own path, so
ids always equal those of ``tokenizers.Tokenizer.from_file(path).encode(text, add_special_tokens=False)``.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np

from .words import RUN_BYTES, mix, powers

_SPECIAL = "<|endoftext|>"
_CONTRACTION = re.compile(r"'(?:s|t|re|ve|m|ll|d)")
_OTHER, _LETTER, _NUMBER, _SPACE = 0, 1, 2, 3
#: The characters that the pattern's \s matches.
_SPACES = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Pretokens whose ids are kept; beyond it the table starts afresh.
TABLE_ROWS = 1 << 21


@functools.lru_cache(1)
def _kinds() -> np.ndarray:
    out = np.zeros(0x110000, np.uint8)
    first = {"L": _LETTER, "N": _NUMBER}
    for block in range(0, 0x110000, 0x1000):
        out[block : block + 0x1000] = [first.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(block, block + 0x1000)]
    out[_SPACES] = _SPACE
    return out


class Bpe:
    """Ids of a byte-level BPE given as a ``tokenizers`` JSON file, and the same vocabulary as ``tiktoken`` ranks."""

    def __init__(self, json_path: str, ranks_path: str):
        import base64

        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        self.whole = Tokenizer.from_file(json_path)
        self.plain = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._forget()

    def _forget(self) -> None:
        self.known, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.ptr = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def encode(self, texts: Sequence[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For runs of texts of bounded size: the first one's number, all ids, and where each text's ids begin."""
        begin, size = 0, 0
        for i, t in enumerate(texts):
            n = len(t) if t else 0
            if size and size + n > RUN_BYTES:
                yield begin, *self._run(texts[begin:i])
                begin, size = i, 0
            size += n
        if begin < len(texts):
            yield begin, *self._run(texts[begin:])

    def _run(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        odd = {i: np.asarray(self._odd(t), np.uint32) for i, t in enumerate(texts) if t and (_SPECIAL in t or ("'" in t and _CONTRACTION.search(t)))}
        ids, ptr = self._vector(["" if t is None or i in odd else t for i, t in enumerate(texts)])
        if not odd:
            return ids, ptr
        parts = [odd.get(i, ids[ptr[i] : ptr[i + 1]]) for i in range(len(texts))]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    def _odd(self, text: str) -> list[int]:
        if _SPECIAL in text:
            return self.whole.encode(text, add_special_tokens=False).ids
        return self.plain.encode_ordinary(text)

    def _vector(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(lengths)
        ptr = np.zeros(len(texts) + 1, np.int64)
        joined = "".join(texts)
        n = len(joined)
        if not n:
            return np.zeros(0, np.uint32), ptr
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = _kinds()[code]
        begin_text = np.zeros(n + 1, bool)
        begin_text[0] = True
        begin_text[ends] = True
        begin_text = begin_text[:n]
        begin = begin_text.copy()
        begin[1:] |= kind[1:] != kind[:-1]
        space = kind == _SPACE
        # The last white space before something else: a blank goes with what follows, another one stands alone.
        last = np.zeros(n, bool)
        last[:-1] = space[:-1] & ~space[1:] & ~begin_text[1:]
        at = np.flatnonzero(last)
        begin[at] = True
        begin[at[code[at] == 32] + 1] = False
        start = np.flatnonzero(begin)
        end = np.append(start[1:], n)
        length = end - start
        weight = powers(_STEP, int(length.max()))
        place = np.arange(n) - np.repeat(start, length)
        with np.errstate(over="ignore"):
            key = mix(np.add.reduceat(mix(code.astype(np.uint64) + np.uint64(1)) * weight[place], start) + length.astype(np.uint64))
        found, sample, which = np.unique(key, return_index=True, return_inverse=True)
        self._learn(found, sample, start, end, joined)
        rows = self.place[np.searchsorted(self.known, found)][which]
        begins, counts = self.ptr[rows], self.ptr[rows + 1] - self.ptr[rows]
        upto = np.concatenate([[0], np.cumsum(counts)])
        ids = self.ids[np.arange(upto[-1]) + np.repeat(begins - upto[:-1], counts)]
        ptr[1:] = upto[np.searchsorted(start, ends)]
        return ids, ptr

    def _learn(self, found: np.ndarray, sample: np.ndarray, start: np.ndarray, end: np.ndarray, joined: str) -> None:
        if len(self.known) > TABLE_ROWS:
            self._forget()
        spot = np.minimum(np.searchsorted(self.known, found), max(len(self.known) - 1, 0))
        new = np.flatnonzero(self.known[spot] != found) if len(self.known) else np.arange(len(found))
        if not len(new):
            return
        piece = self.plain._encode_single_piece
        coded = [piece(joined[start[i] : end[i]]) for i in sample[new]]
        counts = np.fromiter(map(len, coded), np.int64, len(coded))
        self.ids = np.concatenate([self.ids, np.fromiter((x for c in coded for x in c), np.uint32, int(counts.sum()))])
        self.ptr = np.concatenate([self.ptr, self.ptr[-1] + np.cumsum(counts)])
        known = np.concatenate([self.known, found[new]])
        place = np.concatenate([self.place, len(self.place) + np.arange(len(new))])
        order = np.argsort(known, kind="stable")
        self.known, self.place = known[order], place[order]


@functools.lru_cache(2)
def shared_bpe(json_path: str, ranks_path: str) -> Bpe:
    """One encoder for each worker process."""
    return Bpe(json_path, ranks_path)


def default_paths() -> tuple[str, str]:
    from public_tokenizers import path

    return path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken")
