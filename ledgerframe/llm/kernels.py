"""Vectorised text kernels over Arrow string columns.

Every kernel works on slices of at most about ``SLICE_BYTES`` of text (one document at
least), so that a Python worker's memory follows the slice or its longest document, never
the size of a partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 17

_U = np.uint64
#: Bytes that end a word when words are `[^\x20\x09-\x0D]+`.
WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: A-Z to a-z, every other byte unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit integers (the finaliser of splitmix64)."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


class Rolling:
    """Polynomial hashes modulo 2**64 of any span of a sequence, from one prefix sum.

    The base is odd, hence invertible; coefficients pass through :func:`mix` or a random
    byte table, so that small values don't produce structured sums.
    """

    def __init__(self, base: int):
        self.base = base | 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self._up = self._down = np.ones(1, _U)

    def _powers(self, n: int) -> None:
        if len(self._up) >= n:
            return
        n = max(n, 2 * len(self._up))
        up, down = np.full(n, self.base, _U), np.full(n, self.inverse, _U)
        up[0] = down[0] = 1
        self._up, self._down = np.cumprod(up, dtype=_U), np.cumprod(down, dtype=_U)

    def prefix(self, coefficients: np.ndarray) -> np.ndarray:
        n = len(coefficients)
        self._powers(n + 1)
        out = np.empty(n + 1, _U)
        out[0] = 0
        np.cumsum(coefficients * self._up[:n], dtype=_U, out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((prefix[ends] - prefix[starts]) * self._down[starts])


def _table(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)


BYTES_A, BYTES_B = _table(11), _table(12)
ROLL_BYTES_A, ROLL_BYTES_B = Rolling(0x9E3779B97F4A7C15), Rolling(0xD1B54A32D192ED03)
ROLL_WORDS_A, ROLL_WORDS_B = Rolling(0xA0761D6478BD642F), Rolling(0xE7037ED1A0B428DB)


class Texts:
    """A run of texts as one byte buffer with offsets; nulls are empty texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int):
        self.data, self.offsets, self.first = data, offsets, first

    def __len__(self) -> int:
        return len(self.offsets) - 1


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Texts]:
    """Cut an Arrow string column into :class:`Texts` of about ``limit`` bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    if not wide and not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    _, offs, data = column.buffers()
    n = len(column)
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32, n + 1 + column.offset)[column.offset :].astype(np.int64) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        to = min(max(to, at + 1), n)
        yield Texts(raw[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], at)
        at = to


def words(t: Texts, is_word: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of all words, and the index of each text's first word.

    ``is_word`` is a mask over the bytes; by default every byte that isn't ASCII white space.
    """
    if is_word is None:
        is_word = ~WHITE[t.data]
    n = len(is_word)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(t) + 1, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[t.offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = is_word[:-1]
    starts = np.flatnonzero(is_word & (~before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = is_word[1:]
    ends = np.flatnonzero(is_word & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, t.offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, second: bool = False) -> np.ndarray:
    table, roll = (BYTES_B, ROLL_BYTES_B) if second else (BYTES_A, ROLL_BYTES_A)
    return roll.spans(roll.prefix(table[data]), starts, ends)


def window_hashes(hashes: np.ndarray, firsts: np.ndarray, size: int, second: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the ``size`` words from each position, and whether that window stays within its text."""
    n = len(hashes)
    if n < size:
        return np.zeros(0, _U), np.zeros(0, bool)
    roll = ROLL_WORDS_B if second else ROLL_WORDS_A
    at = np.arange(n - size + 1)
    last = np.repeat(firsts[1:], np.diff(firsts))[: n - size + 1]
    return roll.spans(roll.prefix(hashes), at, at + size), at + size <= last


def owners(firsts: np.ndarray) -> np.ndarray:
    """The index of the text that holds each word."""
    return np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))


def repeated(keys: np.ndarray) -> np.ndarray:
    """Whether each key occurs more than once."""
    if not len(keys):
        return np.zeros(0, bool)
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    same = s[1:] == s[:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def per_text(values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Sums of ``values`` by text."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[firsts[1:]] - total[firsts[:-1]]
