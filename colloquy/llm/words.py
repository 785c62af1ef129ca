"""Words of Arrow string columns as numpy arrays of 64-bit hashes, without making Python strings.

A word is a maximal run of bytes that a table marks; its hash is a polynomial of its (folded) bytes, taken from a
running sum, so that all words of a chunk, and any of their prefixes and suffixes, are hashed at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes that are processed at once. A longer text makes a longer chunk of its own, hashed piece by piece.
CHUNK = 1 << 20

_P = 0x9E3779B97F4A7C15
_POWERS = np.cumprod(np.full(CHUNK + 1, _P, np.uint64)) * np.uint64(pow(_P, -1, 1 << 64))
_INVERSES = np.cumprod(np.full(CHUNK + 1, pow(_P, -1, 1 << 64), np.uint64)) * np.uint64(_P)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers under which near values land far apart."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_KEYS = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))

#: White space of the document contracts: U+0020 and U+0009 to U+000D.
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[[9, 10, 11, 12, 13, 32]] = False
#: ASCII letters, and all bytes of longer characters.
LETTERS = np.zeros(256, bool)
LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True
ALNUM = LETTERS.copy()
ALNUM[48:58] = True

SAME = np.arange(256, dtype=np.uint8)
LOWER = SAME.copy()
LOWER[65:91] += 32


def columns(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column without nulls."""
    if pa.types.is_large_string(array.type):
        kind = np.int64
    else:
        kind = np.int32
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    return at, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


@dataclass
class Chunk:
    """Words of the texts first .. first + len(bounds) - 2; bounds: where each text's words begin in the arrays."""

    first: int
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    data: np.ndarray

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def running(data: np.ndarray, fold: np.ndarray) -> np.ndarray:
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_KEYS[fold[data]] * _POWERS[: len(data)], out=total[1:])
    return total


def spans(total: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the byte ranges [starts, ends) of a chunk with the given running sums."""
    return mixed((total[ends] - total[starts]) * _INVERSES[starts] + (ends - starts).astype(np.uint64))


def boundaries(data: np.ndarray, inside: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the words of data; no word crosses a cut (where texts begin)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    held = inside[data]
    new = np.zeros(len(data) + 1, bool)
    new[cuts] = True
    start = held.copy()
    start[1:] &= ~held[:-1] | new[1:-1]
    stop = np.zeros(len(data) + 1, bool)
    stop[1:] = held
    stop[1:-1] &= ~held[1:] | new[1:-1]
    return np.flatnonzero(start), np.flatnonzero(stop)


def chunks(array: pa.Array, inside: np.ndarray = NOT_BLANK, fold: np.ndarray = LOWER, size: int = CHUNK) -> Iterator[Chunk]:
    """The words of a string column, whole texts at a time."""
    at, data = columns(array)
    row = 0
    while row < len(array):
        stop = max(row + 1, int(np.searchsorted(at, at[row] + size, "right")) - 1)
        stop = min(stop, len(array))
        part = data[at[row] : at[stop]]
        cuts = at[row : stop + 1] - at[row]
        if len(part) <= CHUNK:
            starts, ends = boundaries(part, inside, cuts)
            hashes = spans(running(part, fold), starts, ends)
        else:
            starts, ends, hashes = _long(part, inside, fold)
        yield Chunk(row, np.searchsorted(starts, cuts), starts, ends, hashes, part)
        row = stop


def _long(data: np.ndarray, inside: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, ...]:
    starts, ends = boundaries(data, inside, np.array([0, len(data)]))
    return starts, ends, hash_spans(data, starts, ends, fold)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray = SAME) -> np.ndarray:
    """Hashes of ordered byte ranges of data of any length, made in pieces that end between ranges; a range longer than a piece is hashed by its parts."""
    hashes = np.zeros(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + CHUNK, "right")))
        base, top = starts[a], ends[b - 1]
        if top - base <= CHUNK:
            hashes[a:b] = spans(running(data[base:top], fold), starts[a:b] - base, ends[a:b] - base)
        else:
            h = np.uint64(0)
            for x in range(base, top, CHUNK):
                y = min(top, x + CHUNK)
                h = mixed(h + spans(running(data[x:y], fold), np.array([0]), np.array([y - x]))[0] + np.uint64(1))
            hashes[a] = h
        a = b
    return hashes


def shingles(hashes: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds) of the runs of width words of each text; a text with fewer words has its whole sequence as one, one without words none."""
    n = np.diff(bounds)
    take = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    new = np.concatenate([[0], np.cumsum(take)])
    at = np.repeat(bounds[:-1] - new[:-1], take) + np.arange(new[-1])
    last = np.repeat(bounds[1:], take)
    factors = mixed(np.arange(1, width + 1, dtype=np.uint64))
    out = np.zeros(len(at), np.uint64)
    for k in range(width):
        there = at + k < last
        word = hashes[np.minimum(at + k, last - 1)]
        out += np.where(there, (word | np.uint64(1)) * factors[k] + (word >> np.uint64(1)), np.uint64(0))
    return mixed(out + np.minimum(last - at, width).astype(np.uint64)), new
