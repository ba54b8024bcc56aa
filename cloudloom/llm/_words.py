"""Vectorised word splitting and hashing of Arrow text batches.

A batch of texts is laid end to end in one byte buffer, words are found with a
256-entry byte table, and every word gets a 64-bit polynomial hash from prefix
sums, so no Python code runs per word.  Hashes propose; callers that need exact
answers compare the bytes of the words afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_MIX = np.uint64(0xFF51AFD7ED558CCD)

_bytes = np.arange(256)
#: Words are runs of anything but space and \t..\r.
NOT_SPACE = ~((_bytes == 0x20) | ((_bytes >= 0x09) & (_bytes <= 0x0D)))
#: Words are runs of digits, lower-case letters and non-ASCII bytes.
ALNUM = ((_bytes >= 0x30) & (_bytes <= 0x39)) | ((_bytes >= 0x61) & (_bytes <= 0x7A)) | (_bytes >= 0x80)
#: Lower-cases A-Z and leaves every other byte alone.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

#: Texts are worked on in groups of about this many bytes; a longer text is a group of its own.
GROUP_BYTES = 1 << 20


@dataclass
class WordBatch:
    """Words of some consecutive texts: word i is ``raw[starts[i]:ends[i]]``; text d has words ``first[d]:first[d + 1]``."""

    raw: bytes
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def n_docs(self) -> int:
        return len(self.first) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        buf = np.frombuffer(self.raw, np.uint8)
        n = len(buf)
        power = np.full(n, _P)
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power, out=total[1:])
        inverse = np.full(n, _P_INV)
        inverse[0] = 1
        np.multiply.accumulate(inverse, out=inverse)
        return mix((total[self.ends] - total[self.starts]) * inverse[self.starts])

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), self.counts())

    def room(self) -> np.ndarray:
        """Words from each word to the end of its text, itself included."""
        return np.repeat(self.first[1:], self.counts()) - np.arange(len(self.starts))

    def span(self, i: int, j: int) -> bytes:
        """Words i..j-1 joined by one space."""
        s, e, raw = self.starts[i:j].tolist(), self.ends[i:j].tolist(), self.raw
        return b" ".join([raw[a:b] for a, b in zip(s, e)])


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads entropy over all 64 bits (a bijection)."""
    h = h ^ (h >> np.uint64(33))
    h = h * _MIX
    return h ^ (h >> np.uint64(29))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each word on; the last k - 1 places hold garbage."""
    out = h.copy()
    for j in range(1, k):
        out *= _P
        if j < len(h):
            out[: len(h) - j] += h[j:]
    return mix(out)


def to_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; a null text is empty."""
    return [t if t is not None else b"" for t in column.cast(pa.large_binary()).to_pylist()]


def split(texts: list[bytes], table: np.ndarray, lower: bool) -> WordBatch:
    raw = b" ".join([b"", *texts, b""])
    if lower:
        raw = raw.translate(LOWER)
    is_word = table[np.frombuffer(raw, np.uint8)].view(np.int8)
    edge = np.diff(is_word)
    starts, ends = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=at[1:])
    return WordBatch(raw, starts, ends, np.searchsorted(starts, at + 1))


def groups(texts: list[bytes], most: int = GROUP_BYTES) -> Iterator[slice]:
    """Slices of consecutive texts of about ``most`` bytes."""
    begin = size = 0
    for i, t in enumerate(texts):
        if i > begin and size + len(t) > most:
            yield slice(begin, i)
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield slice(begin, len(texts))


def sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """Index of the least of ``values[i:i + w]`` for each i, the rightmost one on ties; the last w - 1 places hold garbage."""
    n = len(values)
    at = np.arange(n)
    best, done = values.copy(), 1
    while done < w:  # windows of length done -> min(2 * done, w) by joining two that overlap
        step = min(done, w - done)
        if step >= n:
            break
        right, right_at = best[step:], at[step:]
        better = right <= best[: n - step]
        new, new_at = best.copy(), at.copy()
        new[: n - step][better] = right[better]
        new_at[: n - step][better] = right_at[better]
        best, at, done = new, new_at, done + step
    return at
