"""Words of many texts at once, in numpy over Arrow's string buffers.

A word is a run of ASCII letters and digits and of all non-ASCII characters; every other ASCII character separates.
Where asked for, each character of a script that is written without spaces is a word of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that one step works on; bounds the memory of the arrays beside the text.
STEP = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUE = _LOWER.astype(np.uint64) + np.uint64(1)
#: Bounds of the scripts written without spaces: Thai to Tibetan, Myanmar, Khmer, Chinese and Japanese (but not Korean).
_UNSPACED = np.array([0x0E00, 0x1000, 0x1000, 0x10A0, 0x1780, 0x1800, 0x2E80, 0x3130, 0x3190, 0xA000, 0xAA60, 0xAA80, 0xF900, 0xFB00, 0xFF66, 0xFFA0, 0x20000, 0x40000])
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse, modulo 2^64."""
    global _powers
    if len(_powers[0]) < n:
        up, down = np.full(n, _BASE), np.full(n, _INVERSE)
        up[0] = down[0] = 1
        _powers = np.cumprod(up), np.cumprod(down)
    return _powers


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit finaliser."""
    h = h ^ np.uint64(seed * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Rolling:
    """64-bit hashes of any stretches of bytes, from one running sum; ASCII capitals count as small letters."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        up, self.down = _power_tables(n + 1)
        self.total = np.zeros(n + 1, np.uint64)
        value = _VALUE[data]
        value *= up[:n]
        np.cumsum(value, out=self.total[1:])

    def of(self, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
        return mix((self.total[end] - self.total[start]) * self.down[start], seed)


def ascii_lower(data: np.ndarray) -> np.ndarray:
    """Bytes with ASCII capitals as small letters; offsets stay what they were."""
    return _LOWER[data]


def steps(texts: pa.Array, limit: int = STEP) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of consecutive texts: (first row, end row, bytes, offsets into them). A null is an empty text.

    A run holds about `limit` bytes, or one text alone if that is longer.
    """
    if pa.types.is_large_string(texts.type):
        kind = np.int64
    else:
        texts, kind = texts.cast(pa.string()), np.int32
    _, where, data = texts.buffers()
    if not len(texts):
        return
    offsets = np.frombuffer(where, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = min(len(texts), max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1))
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


@dataclass
class Words:
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray


def unspaced(data: np.ndarray) -> np.ndarray:
    """Where characters of scripts without spaces begin and end."""
    at = np.flatnonzero(data >= 0xE0)
    if not len(at):
        return at
    lead = data[at].astype(np.int64)
    size = np.where(lead >= 0xF0, 4, 3)
    byte = lambda k: data[np.minimum(at + k, len(data) - 1)].astype(np.int64) & 63
    code = (lead & 15) << 12 | byte(1) << 6 | byte(2)
    code = np.where(size == 4, (lead & 7) << 18 | byte(1) << 12 | byte(2) << 6 | byte(3), code)
    hit = np.searchsorted(_UNSPACED, code, "right") % 2 == 1
    return np.concatenate([at[hit], (at + size)[hit]])


def words(data: np.ndarray, offsets: np.ndarray, hashed: bool = True, split: bool = False) -> Words:
    """Bounds, text number and 64-bit hash of each word, in order; split: see unspaced."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none, none, np.zeros(0, np.uint64))
    # bounds are where letters and other characters meet, and where a text ends inside letters
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = _ALNUM[data]
    bounds = np.flatnonzero(inside[1:] != inside[:-1])
    edges = np.concatenate([offsets, unspaced(data)]) if split else offsets
    edges = edges[(edges > 0) & (edges < n)]
    cut = np.unique(edges[inside[edges] & inside[edges + 1]])
    if len(cut):
        bounds = np.sort(np.concatenate([bounds, cut, cut]))
    start, end = bounds[::2], bounds[1::2]
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(start, offsets)))
    if not hashed:
        return Words(start, end, row, np.zeros(0, np.uint64))
    return Words(start, end, row, Rolling(data).of(start, end))


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of each run of `size` words, by text; a text of fewer words has one shingle, of all its words."""
    n = len(w.hash)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    factor = [np.uint64(pow(0xBF58476D1CE4E5B9, k, 1 << 64)) for k in range(1, size + 1)]
    rows, counts = np.unique(w.row, return_counts=True)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    whole = max(0, n - size + 1)
    total = np.zeros(whole, np.uint64)
    for k in range(size):
        total += w.hash[k : k + whole] * factor[k]
    keep = w.row[:whole] == w.row[size - 1 : size - 1 + whole]
    row, value = w.row[:whole][keep], total[keep]
    # short texts, all at once: their words times the factors of their places, added up from the length
    short = counts < size
    if not short.any():
        return row, mix(value)
    begin, length = first[short], counts[short]
    at = np.repeat(begin - np.cumsum(length) + length, length) + np.arange(length.sum())
    place = at - np.repeat(begin, length)
    parts = w.hash[at] * np.array(factor)[place]
    whole = np.add.reduceat(parts, np.cumsum(length) - length) + length.astype(np.uint64)
    row, value = np.concatenate([row, rows[short]]), np.concatenate([value, whole])
    order = np.argsort(row, kind="stable")
    return row[order], mix(value[order])
