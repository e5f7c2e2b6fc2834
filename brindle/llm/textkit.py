"""Vectorised word work over Arrow text columns.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D after A-Z are
lower-cased, so the same words come out of Python, Java regexes and SQL.  All
functions take the bytes of many texts at once and never loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at a time; bounds the memory of the arrays below.
CHUNK_BYTES = 1 << 20
#: The same where many arrays of eight bytes a byte are made: a worker keeps what it once needed, beside the others of its executor.
SMALL_BYTES = 1 << 18

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_PLAIN = _LOWER.copy()
_PLAIN[[b for b in range(128) if not chr(b).isalnum()]] = 0x20

_MUL = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser with full avalanche over uint64; a bijection."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def stream(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random uint64 values."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) * _MUL)


_BYTE_VALUE = stream(256, 7)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_cache: list[tuple[np.ndarray, np.ndarray]] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _cache or len(_cache[0][0]) < n:
        size = SMALL_BYTES * 2
        while size < n:
            size *= 2
        tables = _powers(_MUL, size), _powers(_INV, size)
        if size > CHUNK_BYTES * 2:  # one very long text: do not keep its tables
            return tables
        _cache[:] = [tables]
    return _cache[0]


def text_chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets) of slices of at most `most` bytes, or one text.

    Null counts as the empty text.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and for each text the index of its first word (one more at the end)."""
    word = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    left = np.ones(len(data), bool)
    left[1:] = ~word[:-1]
    right = np.ones(len(data), bool)
    right[:-1] = ~word[1:]
    starts = np.flatnonzero(word & (left | edge[:-1]))
    ends = np.flatnonzero(word & (right | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def plain(data: np.ndarray) -> np.ndarray:
    """The bytes with ASCII letters in lower case and ASCII punctuation as spaces."""
    return _PLAIN[data]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the lower-cased words; a function of a word's bytes alone."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    power, inverse = _power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUE[_LOWER[data]] * power[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def lower(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


_GRAM = stream(16, 11) | np.uint64(1)


def gram_hashes(words: np.ndarray, first: np.ndarray, n: int, whole_if_short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word shingles of each text, and the index of each text's first one.

    A text of fewer than n words has its whole sequence as one shingle if
    `whole_if_short`, none otherwise; a text without words has none.
    """
    count = np.diff(first)
    full = np.maximum(count - n + 1, 0)
    made = np.where((count > 0) & (count < n), 1, full) if whole_if_short else full
    begin = np.concatenate([[0], np.cumsum(made)])
    text = np.repeat(np.arange(len(count)), full)
    at = np.arange(int(full.sum())) - np.repeat(np.cumsum(full) - full, full) + first[text]
    sums = np.zeros(len(at), np.uint64)
    for k in range(n):
        sums += words[at + k] * _GRAM[k]
    out = np.zeros(int(begin[-1]), np.uint64)
    out[np.arange(len(at)) - np.repeat(np.cumsum(full) - full, full) + begin[text]] = mix(sums)
    if whole_if_short:
        for d in np.flatnonzero((count > 0) & (count < n)):
            own = words[first[d] : first[d + 1]]
            total = (own * _GRAM[: len(own)]).sum(dtype=np.uint64) + np.uint64(len(own) * 0x1000193)
            out[begin[d]] = mix(np.array([total], np.uint64))[0]
    return out, begin
