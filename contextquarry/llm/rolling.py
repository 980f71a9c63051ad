"""Hashes of words and of runs of words, in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

_A, _B, _P = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
REMEMBERED = 400_000


class WordHashes(dict):
    """Word (bytes) -> 64-bit hash, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


#: Powers of _P and of its inverse modulo 2 ** 64 are products of two: of the last bits of the exponent, and of the others.
LOW_BITS = 16
_powers: list[list[np.ndarray]] = []


def _power_tables(n: int) -> list[list[np.ndarray]]:
    """Of _P and of its inverse: the powers up to 2 ** LOW_BITS, and those of the multiples of that up to n at least."""
    if not _powers or len(_powers[0][1]) <= n >> LOW_BITS:
        tables = []
        for base in (int(_P), pow(int(_P), -1, 1 << 64)):
            pair = []
            for step, size in ((base, 1 << LOW_BITS), (pow(base, 1 << LOW_BITS, 1 << 64), max(64, 2 << (n >> LOW_BITS).bit_length()))):
                steps = np.full(size, step, np.uint64)
                steps[0] = 1
                pair.append(np.multiply.accumulate(steps))
            tables.append(pair)
        _powers[:] = tables
    return _powers


def range_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of values[start:end] for each range, from running sums of a polynomial."""
    (low, high), (down_low, down_high) = _power_tables(len(values) + 1)
    terms = np.add(values, np.uint64(1), dtype=np.uint64)
    for k in range(0, len(terms), 1 << LOW_BITS):
        part = terms[k : k + (1 << LOW_BITS)]
        part *= low[: len(part)]
        part *= high[k >> LOW_BITS]
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(terms, out=sums[1:])
    del terms
    down = down_low[start & ((1 << LOW_BITS) - 1)] * down_high[start >> LOW_BITS]
    return mix((sums[end] - sums[start]) * down + (end - start).astype(np.uint64))


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of binaries, and where each begins."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]] if len(column) else whole[:0], offsets - offsets[0]


def words_of(buffer: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of texts that follow each other in a buffer of bytes: where each begins and ends, and the first word of each text (with the end of the last)."""
    word = np.ones(len(buffer) + 1, bool)
    word[:-1] = (buffer != 32) & ((buffer < 9) | (buffer > 13))
    word[-1] = False
    first = word.copy()
    first[1:] &= ~word[:-1]
    inner = offsets[:-1][offsets[:-1] < len(buffer)]
    first[inner] = word[inner]  # a text's first byte begins a word, even if another text ends just before
    last = word.copy()
    last[:-1] &= ~word[1:]
    last[inner[inner > 0] - 1] = word[inner[inner > 0] - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def runs_of(hashes: np.ndarray, length: int) -> np.ndarray:
    """The hash of each `length` consecutive words, by its start; of all words together, if they are fewer."""
    n = len(hashes)
    if not n:
        return hashes
    length = min(length, n)
    out = np.zeros(n - length + 1, np.uint64)
    for k in range(length):
        out = out * _P + hashes[k : n - length + 1 + k]
    return mix(out + np.uint64(length))


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each `width` consecutive values."""
    have, out = 1, values
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out
