"""Words and shingles of whole texts as 64-bit hashes, computed on Arrow buffers with NumPy.

Hashes are polynomial sums over random byte values, mixed at the end. Two
different strings share one with a probability of about 2^-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
_rng = np.random.default_rng(20240229)
_BYTES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
WORD_BYTE = np.ones(256, bool)
WORD_BYTE[[0x20, *range(0x09, 0x0E)]] = False
_powers = np.ones(1, np.uint64)


def byte_values(lower: bool) -> np.ndarray:
    values = _BYTES.copy()
    if lower:
        values[65:91] = values[97:123]
    return values


_VALUES = {True: byte_values(True), False: byte_values(False)}


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        size = max(n, 2 * len(_powers), 1024)
        _powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _BASE)]), dtype=np.uint64)
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * _A
    h = h ^ (h >> np.uint64(27))
    h = h * _B
    return h ^ (h >> np.uint64(31))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def _blocks(data: np.ndarray, offsets: np.ndarray, word_byte: np.ndarray) -> Iterator[tuple[int, int]]:
    """Spans of about BLOCK_BYTES that end after a text or before a word."""
    at, n = 0, len(data)
    while at < n:
        to = min(n, at + BLOCK_BYTES)
        if to < n:
            end = offsets[np.searchsorted(offsets, to, "right") - 1]
            if end > at:
                to = int(end)
            else:
                gap = np.flatnonzero(~word_byte[data[at:to]])
                while not len(gap) and to < n:
                    step = min(n, to + BLOCK_BYTES)
                    gap, to = np.flatnonzero(~word_byte[data[at:step]]), step
                    if not len(gap) and offsets[np.searchsorted(offsets, to, "right") - 1] > at:
                        break
                end = int(offsets[np.searchsorted(offsets, to, "right") - 1])
                to = end if end > at else at + int(gap[-1]) + 1 if len(gap) else to
        yield at, to
        at = to


def word_hashes(
    data: np.ndarray, offsets: np.ndarray, lower: bool = False, word_byte: np.ndarray = WORD_BYTE
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, its first byte, first word of each text and the total): a CSR layout over the texts.

    ``word_byte`` says of each byte value whether it belongs to words.
    """
    values, hashes, firsts = _VALUES[lower], [], []
    for a, b in _blocks(data, offsets, word_byte):
        part = data[a:b]
        inside = np.flatnonzero(word_byte[part])
        if not len(inside):
            continue
        begins = np.ones(len(inside), bool)
        begins[1:] = inside[1:] != inside[:-1] + 1
        cut = offsets[(offsets > a) & (offsets < b)] - a
        at = np.searchsorted(inside, cut)
        ok = at < len(inside)
        begins[at[ok][inside[at[ok]] == cut[ok]]] = True
        heads = np.flatnonzero(begins)
        lengths = np.diff(np.append(heads, len(inside)))
        place = np.arange(len(inside)) - np.repeat(heads, lengths)
        power = powers(int(lengths.max()))
        hashes.append(mix(np.add.reduceat(values[part[inside]] * power[place], heads)))
        firsts.append(inside[heads] + a)
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    first = np.concatenate(firsts) if firsts else np.zeros(0, np.int64)
    return h, first, np.searchsorted(first, offsets)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k words in a row, across text borders too; callers use the ones inside a text."""
    if len(words) < k:
        return np.zeros(0, np.uint64)
    n = len(words) - k + 1
    h = words[:n].copy()
    for i in range(1, k):
        h = mix(h * _BASE + words[i : i + n])
    return h


def whole_hash(words: np.ndarray) -> np.uint64:
    """Hash of a sequence shorter than a shingle."""
    h = np.full(1, len(words), np.uint64)
    for w in words:
        h = mix(h * _BASE + w)
    return h[0]


def shingle_set(words: np.ndarray, shingles: np.ndarray, a: int, b: int, k: int) -> np.ndarray:
    """Sorted distinct shingles of words a..b; the whole sequence as one if it is shorter; empty without words."""
    if b - a >= k:
        return np.unique(shingles[a : b - k + 1])
    return np.array([whole_hash(words[a:b])], np.uint64) if b > a else np.zeros(0, np.uint64)


def texts_in_parts(column: pa.Array, most: int = 8 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with about ``most`` bytes."""
    data, offsets = buffers(column)
    n, at = len(offsets) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        to = min(to, n)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to
