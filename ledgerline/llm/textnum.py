"""Vectorised word finding and hashing over Arrow string columns.

Everything here is a small numpy helper that runs inside Spark tasks: it takes a string array,
looks at its UTF-8 bytes and returns, for all texts of a slice at once, where the words lie and a
64-bit hash of every word or word window.  Nulls count as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once: bounds the scratch arrays (about 60 bytes a byte of text).
SLICE_BYTES = 500_000

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_STEP = _U(0xD1342543DE82EF95 | 1)


def _inverse(a: int) -> int:
    return pow(a, -1, 1 << 64)


class _Powers:
    """base**i and base**-i modulo 2**64, grown on demand."""

    def __init__(self, base: np.uint64):
        self.base, self.inv = base, _U(_inverse(int(base)))
        self.up = self.down = np.ones(1, _U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            m = max(n, 1 << 16)
            for name, b in (("up", self.base), ("down", self.inv)):
                x = np.full(m, b, _U)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))
        return self.up[:n], self.down[:n]


_bytes_pow, _word_pow, _other_pow = _Powers(_BASE), _Powers(_STEP), _Powers(_U(0xA0761D6478BD642F))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that all bits of a hash can be used."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x = x * _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _table(separators: list[tuple[int, int]], lower: bool) -> np.ndarray:
    """Byte -> 0 for a separator, else the (lower-cased) byte plus one."""
    t = np.arange(1, 257, dtype=np.uint16)
    if lower:
        t[0x41:0x5B] += 32
    for a, b in separators:
        t[a : b + 1] = 0
    return t


#: Words are what white space separates; bytes as they are, or A-Z lower-cased.
SPACE_WORDS = _table([(0x20, 0x20), (0x09, 0x0D)], lower=False)
SPACE_WORDS_LOWER = _table([(0x20, 0x20), (0x09, 0x0D)], lower=True)
#: Words are runs of ASCII letters and digits and of all other than ASCII characters; A-Z lower-cased.
PLAIN_WORDS = _table([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)], lower=True)

_VALUES = mix(np.arange(1, 258, dtype=_U) * _U(0x2545F4914F6CDD1D))
_VALUES[0] = 0
_OTHERS = mix(np.arange(1, 258, dtype=_U) * _U(0xE7037ED1A0B428DB))
_OTHERS[0] = 0


@dataclass
class Words:
    """Words of a slice of texts. first[i]:first[i+1] are the words of text i (row0 + i of the batch)."""

    row0: int
    data: np.ndarray  # the slice's bytes
    text_at: np.ndarray  # byte offsets of the texts in data, one more than texts
    first: np.ndarray
    start: np.ndarray  # byte offsets of the words in data
    end: np.ndarray
    hash: np.ndarray

    @property
    def n_texts(self) -> int:
        return len(self.first) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_texts), self.counts())

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all windows of n words within one text, and the index of their first word."""
        total = len(self.hash)
        if total < n:
            return np.zeros(0, _U), np.zeros(0, np.int64)
        up, down = _word_pow.get(total + 1)
        sums = np.zeros(total + 1, _U)
        np.cumsum(self.hash * up[:total], out=sums[1:])
        h = mix((sums[n:] - sums[:-n]) * down[: total - n + 1])
        last = np.repeat(self.first[1:], self.counts())[: total - n + 1]  # end of the text that holds word i
        at = np.flatnonzero(np.arange(n, total + 1) <= last)
        return h[at], at


def window_hash(word_hashes: np.ndarray) -> np.uint64:
    """The hash that Words.windows gives for this sequence of word hashes."""
    up, _ = _word_pow.get(len(word_hashes) + 1)
    with np.errstate(over="ignore"):
        return mix(np.array([(word_hashes * up[: len(word_hashes)]).sum(dtype=_U)], _U))[0]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), at


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of texts of about `most` bytes; a longer text is its own run."""
    if not len(column):
        return
    data, at = utf8(column)
    row, n = 0, len(at) - 1
    while row < n:
        to = max(row + 1, int(np.searchsorted(at, at[row] + most, "right")) - 1)
        yield row, data[at[row] : at[to]], at[row : to + 1] - at[row]
        row = to


def second_hashes(w: Words, table: np.ndarray) -> np.ndarray:
    """Another 64-bit hash of every word, independent of the first."""
    n = len(w.data)
    up, down = _other_pow.get(n + 1)
    sums = np.zeros(n + 1, _U)
    np.cumsum(_OTHERS[table[w.data]] * up[:n], out=sums[1:])
    return mix((sums[w.end] - sums[w.start]) * down[w.start] + (w.end - w.start).astype(_U))


def words(column: pa.Array, table: np.ndarray, most: int = SLICE_BYTES) -> Iterator[Words]:
    """Words of whole texts, slice by slice."""
    for row0, data, at in slices(column, most):
        n = len(data)
        code = table[data]
        is_word = np.zeros(n + 2, bool)
        is_word[1:-1] = code != 0
        before, after = is_word[:-2].copy(), is_word[2:].copy()
        edges = at[1:-1]
        before[edges[edges < n]] = False
        after[edges[edges > 0] - 1] = False
        inner = is_word[1:-1]
        start = np.flatnonzero(inner & ~before)
        end = np.flatnonzero(inner & ~after) + 1
        up, down = _bytes_pow.get(n + 1)
        sums = np.zeros(n + 1, _U)
        np.cumsum(_VALUES[code] * up[:n], out=sums[1:])
        h = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(_U))
        yield Words(row0, data, at, np.searchsorted(start, at), start, end, h)
