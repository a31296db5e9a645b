"""Vectorised word and window hashing over Arrow string columns.

Words are maximal runs of bytes outside 0x20 and 0x09-0x0D; those bytes never occur inside a multi-byte
UTF-8 character, so all of this works on the encoded text and never copies a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
WORD = r"[^\x20\x09-\x0D]+"
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers (splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _stream(seed: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed))


class _Powers:
    """Powers of an odd number modulo 2**64 and of its inverse, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.up = self.down = np.ones(1, dtype=U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 1 << 16)
            for name, base in (("up", self.base), ("down", self.inverse)):
                steps = np.full(n, base, dtype=U)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up, self.down


_BYTES, _LETTERS, _WORDS = _stream(7, 256), _Powers(0x9E3779B97F4A7C15 | 1), _Powers(0xD6E8FEB86659FD93 | 1)
_BYTES_AGAIN, _LETTERS_AGAIN, _WORDS_AGAIN = _stream(11, 256), _Powers(0xA0761D6478BD642F | 1), _Powers(0xE7037ED1A0B428DB | 1)


def _runs(values: np.ndarray, powers: _Powers) -> np.ndarray:
    up, _ = powers.get(len(values) + 1)
    out = np.zeros(len(values) + 1, dtype=U)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


class Words:
    """The words of a slice of a string column.

    start, end: byte ranges in ``data``; row: the row of each word; first: index of each row's first word
    (one more entry closes the last row); key: 64-bit hash of each word.
    """

    def __init__(self, column: pa.Array, fold: bool = False) -> None:
        self.rows = len(column)
        self.data, self.offsets = raw(column)
        data = self.data
        if fold:
            data = self.data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
        inside = ~SEPARATOR[data]
        starts = inside.copy()
        starts[1:] &= ~inside[:-1]
        heads = self.offsets[:-1][self.offsets[:-1] < len(data)]
        starts[heads] = inside[heads]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        tails = self.offsets[1:][self.offsets[1:] > 0] - 1
        ends[tails] = inside[tails]
        self.start, self.end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        self.row = np.searchsorted(self.offsets, self.start, side="right") - 1
        self.first = np.searchsorted(self.start, self.offsets)
        self._key: np.ndarray | None = None
        self._total: np.ndarray | None = None

    @property
    def key(self) -> np.ndarray:
        if self._key is None:
            total = _runs(_BYTES[self.data], _LETTERS)
            _, down = _LETTERS.get(len(self.data) + 1)
            self._key = mix((total[self.end] - total[self.start]) * down[self.start])
        return self._key

    def spans(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Hash of the words from each start to before each stop (word indexes)."""
        if self._total is None:
            self._total = _runs(self.key, _WORDS)
        _, down = _WORDS.get(len(self._total))
        return mix((self._total[stop] - self._total[start]) * down[start] + (stop - start).astype(U))

    def checks(self, at: np.ndarray, width: int) -> np.ndarray:
        """A second hash, of 31 bits and independent of the first, of the ``width`` words from each of ``at`` on."""
        total = _runs(_BYTES_AGAIN[self.data], _LETTERS_AGAIN)
        _, down = _LETTERS_AGAIN.get(len(self.data) + 1)
        words = _runs(mix((total[self.end] - total[self.start]) * down[self.start]), _WORDS_AGAIN)
        _, down = _WORDS_AGAIN.get(len(words))
        return (mix((words[at + width] - words[at]) * down[at]) >> U(33)).astype(np.int32)

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the ``width`` words from each word on, and whether they lie in one row."""
        n = len(self.key)
        m = max(0, n - width + 1)
        out, whole = np.zeros(n, dtype=U), np.zeros(n, dtype=bool)
        out[:m] = self.spans(np.arange(m), np.arange(width, width + m))
        whole[:m] = self.row[:m] == self.row[width - 1 :][:m]
        return out, whole


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    if not len(column) or at is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    at = np.frombuffer(at, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def slices(column: pa.Array, most: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes of text, at least one row each: bounds the arrays made per range."""
    _, at = raw(column)
    row, n = 0, len(at) - 1
    while row < n:
        stop = max(row + 1, int(np.searchsorted(at, at[row] + most, side="right")) - 1)
        yield row, min(stop, n)
        row = stop
