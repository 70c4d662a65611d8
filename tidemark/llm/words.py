"""Words and word windows of many texts at once, as 64-bit fingerprints in numpy.

A word is a longest run of characters outside ``[\\x20\\x09-\\x0D]``. Equal words have equal fingerprints. Among n
distinct words or windows the chance that any two share a fingerprint is about n * n / 2**65.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np

_RNG = np.random.Generator(np.random.PCG64(0x7EDE))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Texts are worked on in runs of about so many bytes, which bounds the arrays; one longer text forms a run alone.
RUN_BYTES = 2 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


@dataclass
class Words:
    """Fingerprints of all words of some texts; text i has the words ``ptr[i]:ptr[i + 1]``."""

    first: int
    code: np.ndarray
    ptr: np.ndarray
    raw: bytes
    start: np.ndarray
    end: np.ndarray

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.ptr)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ptr) - 1), self.count)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprint of the k words from each word on, and whether they lie in one text."""
        n = len(self.code)
        if n < k:
            return np.zeros(n, np.uint64), np.zeros(n, bool)
        total = self.code[: n - k + 1].copy()
        weight = np.uint64(1)
        with np.errstate(over="ignore"):
            for j in range(1, k):
                weight = weight * _STEP
                total += self.code[j : n - k + 1 + j] * weight
        code = np.concatenate([mix(total), np.zeros(k - 1, np.uint64)])
        room = np.repeat(self.ptr[1:], self.count) - np.arange(n)
        return code, room >= k


def fingerprint(texts: Sequence[str | None], lower: bool = False, first: int = 0) -> Words:
    """Words of these texts; ``lower`` folds A-Z only."""
    encoded = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    raw = b" ".join(encoded) + b" "
    data = np.frombuffer(raw, np.uint8)
    ends_of_text = np.cumsum(np.fromiter(map(len, encoded), np.int64, len(encoded)) + 1) if encoded else np.zeros(0, np.int64)
    space = _IS_SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(space) and not space[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[0::2], edge[1::2]
    ptr = np.concatenate([[0], np.searchsorted(start, ends_of_text)]).astype(np.int64)
    if not len(start):
        return Words(first, np.zeros(0, np.uint64), ptr, raw, start, end)
    length = end - start
    weight = powers(_STEP, int(length.max()))
    inside = np.flatnonzero(~space)
    word_ptr = np.concatenate([[0], np.cumsum(length)])
    place = np.arange(len(inside)) - np.repeat(word_ptr[:-1], length)
    with np.errstate(over="ignore"):
        value = (_LOWER if lower else _BYTE)[data[inside]] * weight[place]
        code = mix(np.add.reduceat(value, word_ptr[:-1]) + length.astype(np.uint64))
    return Words(first, code, ptr, raw, start, end)


def runs(texts: Sequence[str | None], lower: bool = False) -> Iterator[Words]:
    """Words of these texts in runs of bounded size, in order."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if size and size + n > RUN_BYTES:
            yield fingerprint(texts[begin:i], lower, begin)
            begin, size = i, 0
        size += n
    if begin < len(texts):
        yield fingerprint(texts[begin:], lower, begin)


class Lookup:
    """Rows of sorted distinct fingerprints, found by their leading bits."""

    def __init__(self, code: np.ndarray):
        self.code, bits = code, max(8, int(len(code)).bit_length() + 1)
        self.shift = np.uint64(64 - bits)
        self.start = np.searchsorted(code >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)

    def find(self, asked: np.ndarray) -> np.ndarray:
        """The row of each fingerprint, or -1."""
        if not len(self.code):
            return np.full(len(asked), -1, np.int32)
        bucket = (asked >> self.shift).astype(np.int64)
        row, end = self.start[bucket], self.start[bucket + 1]
        out = np.where((row < end) & (self.code[np.minimum(row, len(self.code) - 1)] == asked), row, -1).astype(np.int32)
        left = np.flatnonzero((out < 0) & (row + 1 < end))
        while len(left):
            row[left] += 1
            hit = self.code[row[left]] == asked[left]
            out[left[hit]] = row[left[hit]]
            left = left[~hit & (row[left] + 1 < end[left])]
        return out
