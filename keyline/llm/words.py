"""Words and shingles of whole Arrow batches as 64-bit hashes, without Python per word.

Words are runs of bytes other than space and \\x09-\\x0D; A-Z are lower-cased. A
word's hash is a polynomial over random values of its bytes, finished by a mixer;
a shingle's hash combines those of its words by position.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 2**63, 256, dtype=_U) * _U(2) + _U(1)
_BYTE[65:91] = _BYTE[97:123]
_PLACE = _rng.integers(1, 2**63, 64, dtype=_U) * _U(2) + _U(1)
_BASE = int(_rng.integers(1, 2**62)) * 4 + 1
_INVERSE = pow(_BASE, -1, 2**64)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True

#: Texts are hashed in groups of about so many bytes, which bounds memory.
GROUP_BYTES = 1 << 20

_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse for i < n, kept between calls."""
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(n, GROUP_BYTES + (GROUP_BYTES >> 2)).bit_length()
        both = []
        for base in (_BASE, _INVERSE):
            table = np.ones(1, _U)
            while len(table) < size:
                table = np.concatenate([table, table * _U(pow(base, len(table), 2**64))])
            both.append(table)
        _powers[:] = both
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finisher (the one of splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    where = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or where[-1] == where[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[where[0] : where[-1]], where - where[0]


def groups(column: pa.Array, most: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``most`` bytes each; a longer text is a group alone."""
    _, where = utf8(column)
    start = 0
    while start < len(column):
        end = max(start + 1, int(np.searchsorted(where, where[start] + most, "right")) - 1)
        yield start, end
        start = end


def word_hashes(data: np.ndarray, where: np.ndarray, blank: np.ndarray = _BLANK) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and for each row the index of its first word (n + 1).

    ``blank`` says which bytes separate words.
    """
    if not len(data):
        return np.zeros(0, _U), np.zeros(len(where), np.int64)
    solid = ~blank[data]
    first = np.empty_like(solid)
    first[0] = True
    np.logical_not(solid[:-1], out=first[1:])
    begins = where[:-1]
    first[begins[begins < len(data)]] = True
    starts = np.flatnonzero(first & solid)
    if not len(starts):
        return np.zeros(0, _U), np.zeros(len(where), np.int64)
    power, inverse = _power_tables(len(data))
    value = _BYTE[data]
    value *= power[: len(data)]
    value[~solid] = 0
    hashes = mix(np.add.reduceat(value, starts) * inverse[starts])
    return hashes, np.searchsorted(starts, where)


def shingles(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, one row after another; starts (n + 1).

    A row with fewer than ``size`` words, but one at least, has one shingle: all of them.
    """
    data, where = utf8(column)
    words, start = word_hashes(data, where)
    n = len(where) - 1
    counts = np.diff(start)
    made = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    begin = np.concatenate([[0], np.cumsum(made)])
    out = np.zeros(int(begin[-1]), _U)
    if not len(out):
        return out, begin
    long = counts >= size
    if long.any():
        whole = np.zeros(max(len(words) - size + 1, 0), _U)
        for j in range(size):
            whole += words[j : j + len(whole)] * _PLACE[j]
        whole = mix(whole)
        owner = np.repeat(np.flatnonzero(long), made[long])
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(made[long]) - made[long], made[long])
        out[begin[owner] + nth] = whole[start[owner] + nth]
    for i in np.flatnonzero((counts > 0) & ~long):
        few = words[start[i] : start[i + 1]]
        out[begin[i]] = mix((few * _PLACE[: len(few)]).sum(dtype=_U, keepdims=True) + _U(len(few)))[0]
    for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
        if b - a > 1:
            out[a:b].sort()
    row = np.repeat(np.arange(n), made)
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != out[:-1]) | (row[1:] != row[:-1])
    return out[keep], np.concatenate([[0], np.cumsum(keep)])[begin]
