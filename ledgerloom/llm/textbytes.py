"""Vectorised text work inside tasks: words, their hashes and shingles of a batch of texts.

A word is a longest run of bytes other than space and ``\\t \\n \\v \\f \\r``. Hashes are 64
bits and depend on a word's bytes only, so they agree between tasks and runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at a time; a longer text is a batch of its own.
BATCH_BYTES = 1 << 21
#: Texts in a batch.
BATCH_TEXTS = 256


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def salted(n: int, salt: int) -> np.ndarray:
    """``n`` fixed odd 64-bit numbers."""
    start = (salt * 0xD1342543DE82EF95 + 1) % 2**64
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(start)) | np.uint64(1)


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """Texts as UTF-8 bytes; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def batches(
    texts: list[bytes], most_bytes: int = BATCH_BYTES, most_texts: int = BATCH_TEXTS
) -> Iterator[tuple[int, int]]:
    """Slices ``[lo, hi)`` of a bounded number of texts and of bytes, one text at least."""
    lo = size = 0
    for i, text in enumerate(texts):
        if i > lo and (size + len(text) > most_bytes or i - lo >= most_texts):
            yield lo, i
            lo, size = i, 0
        size += len(text) + 1
    if lo < len(texts):
        yield lo, len(texts)


class Words:
    """Words of a batch of texts: ``start``, ``end``, ``hash`` and ``doc`` of each, in order.

    ``first`` has the place of each text's first word and one place more for the end.
    """

    def __init__(self, hasher: WordHasher, texts: list[bytes]):
        self.data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
        sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
        offsets = np.concatenate(([0], np.cumsum(sizes)))
        space = np.concatenate(([True], hasher.space[self.data]))
        edges = np.flatnonzero(space[1:] != space[:-1])
        self.start, self.end = edges[0::2], edges[1::2]
        self.first = np.searchsorted(self.start, offsets)
        self.offsets = offsets
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.hash = hasher.hashes(self.data, self.start, self.end)


class WordHasher:
    """Polynomial word hashes from prefix sums; make one for each task, it keeps its tables.

    ``fold`` hashes ASCII capitals as small letters.
    """

    PIECE = 1 << 20

    def __init__(self, fold: bool = False):
        self.space = np.zeros(256, dtype=bool)
        self.space[[32, 9, 10, 11, 12, 13]] = True
        self.code = salted(256, 1)
        if fold:
            self.code[65:91] = self.code[97:123]
        self.base = int(salted(1, 2)[0])
        self.power = self.inverse = np.ones(1, dtype=np.uint64)

    def _reach(self, n: int) -> None:
        if len(self.power) < n:
            size = max(n, self.PIECE)
            for name, base in (("power", self.base), ("inverse", pow(self.base, -1, 2**64))):
                steps = np.full(size, base, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def hashes(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = np.empty(len(start), dtype=np.uint64)
        lo = 0
        while lo < len(start):
            hi = max(lo + 1, int(np.searchsorted(start, start[lo] + self.PIECE)))
            a, b = int(start[lo]), int(end[hi - 1])
            self._reach(b - a + 1)
            sums = np.zeros(b - a + 1, dtype=np.uint64)
            np.cumsum(self.code[data[a:b]] * self.power[: b - a], out=sums[1:])
            i, j = start[lo:hi] - a, end[lo:hi] - a
            out[lo:hi] = mix64((sums[j] - sums[i]) * self.inverse[i] + (j - i).astype(np.uint64))
            lo = hi
        return out


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """``(doc, hash)`` of every run of ``size`` words; a shorter text is one shingle."""
    factors = salted(size, 3)
    n = len(words.hash)
    parts_doc, parts_hash = [], []
    if n >= size:
        whole = np.zeros(n - size + 1, dtype=np.uint64)
        for k in range(size):
            whole += words.hash[k : n - size + 1 + k] * factors[k]
        same = words.doc[: n - size + 1] == words.doc[size - 1 :]
        parts_doc.append(words.doc[: n - size + 1][same])
        parts_hash.append(mix64(whole[same]))
    counts = np.diff(words.first)
    for d in np.flatnonzero((counts > 0) & (counts < size)):
        lo, hi = words.first[d], words.first[d + 1]
        parts_doc.append(np.array([d]))
        total = (words.hash[lo:hi] * factors[: hi - lo]).sum(dtype=np.uint64)
        parts_hash.append(mix64(np.array([total], dtype=np.uint64)) ^ np.uint64(hi - lo))
    if not parts_doc:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    doc, value = np.concatenate(parts_doc), np.concatenate(parts_hash)
    order = np.argsort(doc, kind="stable")
    return doc[order], value[order]
