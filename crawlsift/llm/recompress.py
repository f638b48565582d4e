"""Removal of long repeats of words by recompression: equal stretches get equal symbols wherever they stand.

A round names each run of equal symbols, then each pair of a left and a right symbol; which symbols are left ones is a
bit of their hash, new in each round. Names are hashes of what they name, so all tasks give the same ones without a
dictionary. A symbol knows the words that decided it (its context): wherever these words stand, the same symbol stands.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlsift.llm.storage import drop, saved
from crawlsift.llm.words import mix

WINDOW = 35
#: Bytes of text in a block, whose names travel together; of a piece of a long text; and of one step of a task.
BLOCK_BYTES, PIECE_BYTES, STEP_BYTES = 8 << 20, 1 << 20, 1 << 20
#: Rounds after which symbols are looked up as the cores of windows, and rounds at most. Neither changes a result.
LEVEL, ROUNDS = 5, 64
#: Names that one bucket gathers, about.
BUCKET_NAMES = 1 << 21
_WORD, _SPACE = re.compile(rb"[^ \t-\r]+"), re.compile(rb"[ \t-\r]")
_IN_WORD = np.ones(256, bool)
_IN_WORD[[9, 10, 11, 12, 13, 32]] = False
_SHORT = 64
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_POWERS = [np.cumprod(np.full(_SHORT, b, np.uint64)) for b in _BASES]
_NONE = np.zeros(0, np.int64)


def pieces(text: bytes, size: int = PIECE_BYTES, window: int = WINDOW) -> Iterator[tuple[bytes, int]]:
    """(piece, how many of its last words belong to the next one): each window lies in the piece that its first word is of."""
    at = 0
    while True:
        cut = _SPACE.search(text, at + size)
        if not cut:
            yield text[at:] if at else text, 0
            return
        tail, end = 0, cut.start()
        for m in _WORD.finditer(text, cut.start()):
            tail, end = tail + 1, m.end()
            if tail == window - 1:
                break
        yield text[at:end], tail
        at = cut.start()


@dataclass
class Words:
    """The words of some pieces: bounds in data, number of the piece, and two independent hashes of each."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    piece: np.ndarray
    bounds: np.ndarray  # of each piece, in words
    hashes: tuple[np.ndarray, np.ndarray]
    sums: list = field(default_factory=list)

    def of(self, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
        """Hash of the words of each stretch."""
        if not self.sums:
            n = len(self.start)
            for h, base in zip(self.hashes, _BASES, strict=True):
                up, down = (np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, b, np.uint64))]) for b in (base, pow(base, -1, 1 << 64)))
                self.sums.append((np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[:-1])]), down))
        total, down = self.sums[which]
        return mix((total[end] - total[start]) * down[start], which)


def split(texts: list[bytes]) -> Words:
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    inside = np.concatenate([[False], _IN_WORD[data], [False]])
    at = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = at[::2], at[1::2]
    offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
    bounds = np.searchsorted(start, offsets)
    size = end - start
    letters = data[inside[1:-1]].astype(np.uint64) + np.uint64(1)
    first = np.cumsum(size) - size
    place = np.arange(len(letters)) - np.repeat(first, size)
    hashes = []
    for which, powers in enumerate(_POWERS):
        h = mix(np.add.reduceat(letters * powers[place % _SHORT], first), which) if len(first) else np.zeros(0, np.uint64)
        hashes.append(h ^ size.astype(np.uint64))
    for i in np.flatnonzero(size > _SHORT).tolist():
        raw = hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=16).digest()
        for which in (0, 1):
            hashes[which][i] = int.from_bytes(raw[8 * which : 8 * which + 8], "little")
    return Words(data, start, end, np.repeat(np.arange(len(texts)), np.diff(bounds)), bounds, (hashes[0], hashes[1]))


@dataclass
class Level:
    """Symbols in order: name, words that each stands for, and its context. A context that goes beyond its piece is open."""

    name: np.ndarray
    start: np.ndarray
    end: np.ndarray
    since: np.ndarray
    until: np.ndarray
    piece: np.ndarray


def _runs(x: Level, w: Words) -> tuple[Level, np.ndarray]:
    """Runs of equal symbols become one; second: which ones are new."""
    n = len(x.name)
    meets = x.piece[1:] == x.piece[:-1]
    head = np.flatnonzero(np.concatenate([[True], ~(meets & (x.name[1:] == x.name[:-1]))]))
    last = np.append(head[1:], n) - 1
    times = (last - head + 1).astype(np.uint64)
    name = np.where(times > 1, mix(x.name[head] * np.uint64(0xD6E8FEB86659FD93) + times, 11), x.name[head])
    since, until = x.since[head].copy(), x.until[last].copy()
    word = w.hashes[0]
    inner = np.concatenate([[False], meets])[head]  # has a neighbour on the left
    h = head[inner]
    differs = word[x.end[h - 1] - 1] != word[x.end[h] - 1]
    since[inner] = np.minimum(since[inner], np.where(differs, x.start[h] - 1, x.since[h - 1]))
    since[~inner] = w.bounds[x.piece[head[~inner]]] - 1
    inner = np.concatenate([meets, [False]])[last]
    h = last[inner]
    differs = word[x.start[h + 1]] != word[x.start[h]]
    until[inner] = np.maximum(until[inner], np.where(differs, x.end[h] + 1, x.until[h + 1]))
    until[~inner] = w.bounds[x.piece[last[~inner]] + 1] + 1
    return Level(name, x.start[head], x.end[last], since, until, x.piece[head]), times > 1


def _pairs(x: Level, w: Words, seed: int) -> tuple[Level, np.ndarray]:
    """Pairs of a left and a right symbol become one."""
    left = (mix(x.name, seed) >> np.uint64(40)) & np.uint64(1) == 0
    meets = x.piece[1:] == x.piece[:-1]
    pair = np.append(meets & left[:-1] & ~left[1:], False)
    keep = np.flatnonzero(~np.concatenate([[False], pair[:-1]]))
    is_pair = pair[keep]
    other = np.where(is_pair, keep + 1, keep)
    name = np.where(is_pair, mix(x.name[keep] * np.uint64(0xA0761D6478BD642F) ^ x.name[other] * np.uint64(0xE7037ED1A0B428DB), 13), x.name[keep])
    since, until = x.since[keep].copy(), x.until[other].copy()
    alone = ~is_pair & left[keep]  # has seen that a left symbol or nothing follows
    follows = np.append(meets, False)[keep]
    at = np.flatnonzero(alone & follows)
    until[at] = x.until[keep[at] + 1]
    at = np.flatnonzero(alone & ~follows)
    until[at] = w.bounds[x.piece[keep[at]] + 1] + 1
    alone = ~is_pair & ~left[keep]
    before = np.concatenate([[False], meets])[keep]
    at = np.flatnonzero(alone & before)
    since[at] = x.since[keep[at] - 1]
    at = np.flatnonzero(alone & ~before)
    since[at] = w.bounds[x.piece[keep[at]]] - 1
    return Level(name, x.start[keep], x.end[other], since, until, x.piece[keep]), is_pair


def _least(priority: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Where each range [low, high) has its least priority, the first among equals."""
    tables, n = [np.arange(len(priority))], len(priority)
    reach = (high - low).max()
    while (2 << (len(tables) - 1)) <= reach:
        half, t = 1 << (len(tables) - 1), tables[-1]
        a, b = t[: n - 2 * half + 1], t[half : n - half + 1]
        tables.append(np.where(priority[b] < priority[a], b, a))
    out = np.empty(len(low), np.int64)
    power = np.log2(high - low).astype(int)
    for k, t in enumerate(tables):
        some = np.flatnonzero(power == k)
        a, b = t[low[some]], t[high[some] - (1 << k)]
        out[some] = np.where(priority[b] < priority[a], b, a)
    return out


@dataclass
class Parsed:
    """Of some pieces: starts of windows and the key of each one's core; keys of all cores; and all symbols of a window's
    length or more, with two hashes each."""

    words: Words
    at: np.ndarray
    core: np.ndarray
    cores: np.ndarray
    start: np.ndarray
    end: np.ndarray
    name: np.ndarray
    check: np.ndarray


def parse(texts: list[bytes], window: int = WINDOW) -> Parsed:
    """Symbols of all levels, and the core of each window: among the symbols of the highest level up to LEVEL whose
    context lies in the window, that of least key. The key is a hash of the context's words, so equal windows have
    equal cores at equal places."""
    w = split(texts)
    n = len(w.start)
    at = np.arange(max(0, n - window + 1))
    at = at[w.piece[at] == w.piece[at + window - 1]] if n >= window else _NONE
    i = np.arange(n)
    x = Level(w.hashes[0], i, i + 1, i, i + 1, w.piece)
    levels, long = [x], []
    for r in range(ROUNDS):
        if len(x.name) == (np.diff(w.bounds) > 0).sum() or not len(at):
            break
        for step in (_runs, lambda y, z, seed=100 + r: _pairs(y, z, seed)):
            x, new = step(x, w)
            some = np.flatnonzero(new & (x.end - x.start >= window))
            long.append((x.name[some], x.start[some], x.end[some]))
        if r < LEVEL:
            levels.append(x)
    name, start, end = (np.concatenate([y[k] for y in long]) if long else _NONE for k in range(3))
    core, cores = np.zeros(len(at), np.uint64), []
    left = np.arange(len(at))
    for y in reversed(levels):
        if not len(left):
            break
        p = at[left]
        low, high = np.searchsorted(y.since, p, "left"), np.searchsorted(y.until, p + window, "right")
        some = np.flatnonzero(low < high)
        if len(some):
            key = w.of(np.clip(y.since, 0, n), np.clip(y.until, 0, n), 0)
            best = _least(key, low[some], high[some])
            core[left[some]] = key[best]
            cores.append(key[np.unique(best)])
        left = left[low >= high]
    return Parsed(w, at, core, np.concatenate(cores) if cores else np.zeros(0, np.uint64), start, end, name.astype(np.uint64), w.of(start, end, 1))


def _rows(rows: list[tuple], kind: str) -> pa.RecordBatch:
    types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    names, of = zip(*(c.split() for c in kind.split(", ")), strict=True)
    columns = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, t in zip(columns, of, strict=True)], list(names))


PIECES = "block long, row long, piece int, doc_id long, tail int, text binary"


def _cut(block_bytes: int, piece_bytes: int, window: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, row = TaskContext.get().partitionId() << 32, 0, 0
        for batch in batches:
            rows, size = [], 0
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for k, (piece, tail) in enumerate(pieces(text or b"", piece_bytes, window)):
                    rows.append((block, row, k, doc_id, tail, piece))
                    held, size = held + len(piece), size + len(piece)
                    if size > STEP_BYTES:
                        yield _rows(rows, PIECES)
                        rows, size = [], 0
                row += 1
                if held > block_bytes:
                    block, held = block + 1, 0
            yield _rows(rows, PIECES)

    return run


def _steps(rows: list[tuple], size: int) -> Iterator[list[tuple]]:
    """Rows in order, about `size` bytes of text at a time; the text comes last in a row."""
    part, held = [], 0
    for r in rows:
        part.append(r)
        held += len(r[-1])
        if held > size:
            yield part
            part, held = [], 0
    if part:
        yield part


def _unique(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, where each distinct key begins in it, how often it occurs)."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    head = np.flatnonzero(new)
    return order, head, np.diff(np.append(head, len(order)))


NAMES = "bucket int, block long, kind int, one binary, two binary, times binary"
CORE, SYMBOL, SEEN, ASKED = range(4)


def _named(block: int, kind: int, one: np.ndarray, two: np.ndarray | None, times: np.ndarray, buckets: int) -> list[tuple]:
    """Rows of names by bucket; times counts to 2."""
    if not len(one):
        return []
    bucket = ((one >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    names, first = np.unique(bucket[order], return_index=True)
    return [(int(b), block, kind, one[o].tobytes(), two[o].tobytes() if two is not None else None, np.minimum(times[o], 2).astype(np.uint8).tobytes()) for b, o in zip(names, np.split(order, first[1:]), strict=True)]


def _first_names(buckets: int, window: int) -> Callable:
    """Cores and long symbols of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, cores, symbols = None, [], []

        def flush() -> pa.RecordBatch:
            one = np.concatenate([np.zeros(0, np.uint64), *cores])
            order, head, times = _unique(one)
            rows = _named(block, CORE, one[order[head]], None, times, buckets)
            one, two = (np.concatenate([np.zeros(0, np.uint64), *(s[i] for s in symbols)]) for i in (0, 1))
            order, head, times = _unique(one, two)
            rows += _named(block, SYMBOL, one[order[head]], two[order[head]], times, buckets)
            cores.clear()
            symbols.clear()
            return _rows(rows, NAMES)

        for batch in batches:
            for part in _steps(list(zip(*(c.to_pylist() for c in batch.columns), strict=True)), STEP_BYTES):
                numbers = sorted({r[0] for r in part})
                for b in numbers:
                    if b != block:
                        if block is not None:
                            yield flush()
                        block = b
                    p = parse([r[-1] for r in part if r[0] == b], window)
                    cores.append(p.cores)
                    symbols.append((p.name, p.check))
        if block is not None:
            yield flush()

    return run


ANSWERS = "block long, kind int, one binary, two binary, keeps binary"


def _judge(table: pa.Table) -> pa.Table:
    """Which names of a bucket occur more than once, told to each block that has them. keeps: whether the block has the
    first occurrence. Windows that a block has only seen (SEEN) count, but are not told."""
    out = []
    blocks, kinds = table.column("block").to_numpy(), table.column("kind").to_numpy()
    for kinds_wanted in ((CORE,), (SYMBOL,), (SEEN, ASKED)):
        rows = np.flatnonzero(np.isin(kinds, kinds_wanted))
        if not len(rows):
            continue
        part = table.take(pa.array(rows))
        one, times = (np.frombuffer(b"".join(part.column(c).to_pylist()), t) for c, t in (("one", np.uint64), ("times", np.uint8)))
        two = np.frombuffer(b"".join(part.column("two").to_pylist()), np.uint64) if kinds_wanted != (CORE,) else np.zeros(len(one), np.uint64)
        sizes = [len(x) // 8 for x in part.column("one").to_pylist()]
        block, kind = np.repeat(blocks[rows], sizes), np.repeat(kinds[rows], sizes)
        order, head, count = _unique(one, two)
        total = np.add.reduceat(times[order].astype(np.int64), head)
        least = np.minimum.reduceat(block[order], head)
        some = np.repeat(total > 1, count)
        keeps = block[order] == np.repeat(least, count)
        chosen = np.flatnonzero(some & (kind[order] != SEEN))
        if not len(chosen):
            continue
        at, keeps = order[chosen], keeps[chosen]
        by = np.argsort(block[at], kind="stable")
        names, first = np.unique(block[at][by], return_index=True)
        for b, o in zip(names.tolist(), np.split(by, first[1:]), strict=True):
            k = kinds_wanted[-1]
            out.append((b, k, one[at[o]].tobytes(), None if k == CORE else two[at[o]].tobytes(), keeps[o].tobytes() if k == SYMBOL else None))
    return pa.Table.from_batches([_rows(out, ANSWERS)])


class Names:
    """Names of a block, to be looked up."""

    def __init__(self, one: list[bytes], two: list[bytes] | None = None, keeps: list[bytes] | None = None):
        a = np.frombuffer(b"".join(one), np.uint64)
        b = np.frombuffer(b"".join(two), np.uint64) if two is not None else np.zeros(len(a), np.uint64)
        order = np.lexsort((b, a))
        self.one, self.two = a[order], b[order]
        self.keeps = np.frombuffer(b"".join(keeps), bool)[order] if keeps is not None else None
        self.seen = np.zeros(len(order), bool)

    def find(self, one: np.ndarray, two: np.ndarray | None = None) -> np.ndarray:
        """The place of each name, -1 where it is not held."""
        out = np.full(len(one), -1)
        at = np.searchsorted(self.one, one)
        left = np.flatnonzero(at < len(self.one))
        while len(left):
            same = self.one[at[left]] == one[left]
            left = left[same]
            hit = self.two[at[left]] == (two[left] if two is not None else 0)
            out[left[hit]] = at[left[hit]]
            left = left[~hit]
            at[left] += 1
            left = left[at[left] < len(self.one)]
        return out


def _marked(start: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Which of n places some stretch [start, end) covers."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, start, 1)
    np.add.at(d, end, -1)
    return np.cumsum(d[:-1]) > 0


SECOND = (
    "kind int, bucket int, block long, row long, piece int, doc_id long, tail int, n_words long, n_removed long, sha string, "
    "one binary, two binary, times binary, covered binary, asks binary, text binary"
)
RESULT_ROW, OPEN_PIECE, WINDOW_ROW = range(3)


def _kept(w: Words, first: int, last: int, removed: np.ndarray) -> bytes:
    """Words first to last that are not removed, each followed by a space."""
    size = np.where(removed[first:last], 0, w.end[first:last] - w.start[first:last] + 1)
    at = np.repeat(w.start[first:last] - np.cumsum(size) + size, size) + np.arange(size.sum())
    out = w.data[at]
    out[np.cumsum(size)[size > 0] - 1] = 32
    return out.tobytes()


def _by_block(batches: Iterator[pa.RecordBatch], rows_of: Callable, names_of: Callable, flush: Callable) -> Iterator[pa.RecordBatch]:
    """Streams blocks: first the answers for one (rows without a piece), then its pieces in order."""
    block, answers, names = None, [], None
    for batch in batches:
        part: list[tuple] = []
        for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if r[0] != block:
                if part:
                    yield from rows_of(block, names, part)
                    part = []
                if block is not None:
                    yield from flush(block)
                block, answers, names = r[0], [], None
            if r[1] is None:
                answers.append(r)
                continue
            if names is None:
                names, answers = names_of(answers), []
            part.append(r)
        if part:
            yield from rows_of(block, names, part)
    if block is not None:
        yield from flush(block)


def _resolve(buckets: int, window: int, settle: bool) -> Callable:
    """Words that repeated symbols of a window's length cover; documents of one piece in which no other window may be
    repeated are done. Of the others, windows that may be repeated are asked for. A window inside a repeated symbol is
    seen at the symbol's first occurrence only, so copies ask once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows: dict[int, list] = {SEEN: [], ASKED: []}

        def names_of(answers: list[tuple]) -> tuple[Names, Names]:
            cores = [r for r in answers if r[6] == CORE]
            symbols = [r for r in answers if r[6] == SYMBOL]
            return Names([r[7] for r in cores]), Names(*([r[i] for r in symbols] for i in (7, 8, 9)))

        def rows_of(block: int, names: tuple[Names, Names], rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            cores, symbols = names
            for part in _steps(rows, STEP_BYTES):
                p = parse([r[-1] for r in part], window)
                w, n = p.words, len(p.words.start)
                place = symbols.find(p.name, p.check)
                hit = np.flatnonzero(place >= 0)
                covered = _marked(p.start[hit], p.end[hit], n)
                # of a symbol that this block keeps, the first occurrence in it
                first = np.zeros(len(hit), bool)
                order = np.argsort(p.start[hit], kind="stable")
                _, lead = np.unique(place[hit][order], return_index=True)
                first[order[lead]] = True
                first &= symbols.keeps[place[hit]] & ~symbols.seen[place[hit]]
                symbols.seen[place[hit]] = True
                copies = hit[~first]
                skipped = _marked(p.start[copies], p.end[copies] - window + 1, n)
                some = (cores.find(p.core) >= 0) & ~skipped[p.at]
                at = p.at[some]
                bare = np.append(0, np.cumsum(~covered))
                asks = bare[at + window] > bare[at]
                one, two = w.of(at, at + window, 0), w.of(at, at + window, 1)
                for kind, chosen in ((SEEN, ~asks), (ASKED, asks)):
                    windows[kind].append((one[chosen], two[chosen]))
                asked = at[asks]
                out = []
                for i, r in enumerate(part):
                    a, b = int(w.bounds[i]), int(w.bounds[i + 1])
                    mine = asked[np.searchsorted(asked, a) : np.searchsorted(asked, b)] - a
                    if len(mine) or r[4] or r[2] or not settle:
                        out.append((OPEN_PIECE, None, *r[:5], None, None, None, None, None, None, np.packbits(covered[a:b]).tobytes(), mine.astype(np.int32).tobytes(), r[-1]))
                    else:
                        sha = hashlib.sha256(_kept(w, a, b, covered)[:-1]).hexdigest()
                        out.append((RESULT_ROW, None, *r[:5], b - a, int(covered[a:b].sum()), sha, *[None] * 6))
                yield _rows(out, SECOND)

        def flush(block: int) -> Iterator[pa.RecordBatch]:
            out = []
            for kind, parts in windows.items():
                one, two = (np.concatenate([np.zeros(0, np.uint64), *(x[i] for x in parts)]) for i in (0, 1))
                order, head, times = _unique(one, two)
                found = _named(block, kind, one[order[head]], two[order[head]], times, buckets)
                out += [(WINDOW_ROW, b, block, None, k, None, None, None, None, None, x, y, t, None, None, None) for b, _, k, x, y, t in found]
                parts.clear()
            yield _rows(out, SECOND)

        yield from _by_block(batches, rows_of, names_of, flush)

    return run


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _finish(window: int, with_text: bool) -> Callable:
    """Removes what the answers tell of the windows asked for; the state between pieces of a document is its digest and
    which of the next words are removed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha, counts, text, fresh, carry = None, None, [0, 0], [], True, np.zeros(0, bool)
        done: list[tuple] = []

        def close() -> None:
            if now is not None:
                done.append((now[2], *counts, sha.hexdigest(), *[b"".join(text).decode()] * with_text))

        def names_of(answers: list[tuple]) -> Names:
            return Names([r[6] for r in answers], [r[7] for r in answers])

        def rows_of(block: int, names: Names, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            nonlocal now, sha, counts, text, fresh, carry
            for part in _steps(rows, STEP_BYTES):
                w = split([r[-1] for r in part])
                for i, (_, row, piece, doc_id, tail, *_, covered, asks, _) in enumerate(part):
                    a, b = int(w.bounds[i]), int(w.bounds[i + 1])
                    removed = np.unpackbits(np.frombuffer(covered, np.uint8), count=b - a).astype(bool)
                    at = np.frombuffer(asks, np.int32).astype(np.int64) + a
                    at = at[names.find(w.of(at, at + window, 0), w.of(at, at + window, 1)) >= 0] - a
                    removed |= _marked(at, at + window, b - a)
                    if now is None or now[:2] != (block, row):
                        close()
                        now, sha, counts, text, fresh, carry = (block, row, doc_id), hashlib.sha256(), [0, 0], [], True, np.zeros(0, bool)
                    k = min(len(carry), b - a)
                    removed[:k] |= carry[:k]
                    own = b - a - tail
                    carry = removed[own:]
                    whole = np.zeros(len(w.start), bool)
                    whole[a:b] = removed
                    kept = _kept(w, a, a + own, whole)
                    if kept:
                        kept = (b"" if fresh else b" ") + kept[:-1]
                        sha.update(kept)
                        fresh = False
                        if with_text:
                            text.append(kept)
                    counts = [counts[0] + own, counts[1] + int(removed[:own].sum())]
                yield _rows(done, RESULT + ", text string" * with_text)
                done.clear()

        yield from _by_block(batches, rows_of, names_of, lambda block: ())
        close()
        yield _rows(done, RESULT + ", text string" * with_text)

    return run


def deduplicated(documents: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, piece_bytes: int = PIECE_BYTES, bucket_names: int = BUCKET_NAMES, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of each document without the words of any window of words that starts
    anywhere else as well; with_text adds what is left.

    Three rounds over Spark: names of cores and of long symbols are counted by bucket, and each block of documents is
    told which of its own occur again; what repeated long symbols cover is settled, and only windows that reach beyond,
    and whose core occurs again, are asked for by two 64-bit hashes; then the texts that asked are finished. Each step
    parses about STEP_BYTES of text; long texts are cut to pieces that overlap by a window less a word. Nothing but
    one number reaches the driver.

    A null text has no words. Repeated rows repeat each other and give a row each; a null doc_id stays null; no rows give
    none; other columns take no part.
    """
    spark = documents.sparkSession
    given = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    cut = saved(given.mapInArrow(_cut(block_bytes, piece_bytes, window), PIECES), "recompress-pieces", compression="zstd")
    size = cut.agg(F.sum(F.length("text"))).first()[0] or 0
    # a core in about 12 words of 6 bytes
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / 64 / bucket_names))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / (4 * block_bytes)))
    names = cut.select("block", "text").mapInArrow(_first_names(buckets, window), NAMES)
    answers = saved(names.groupBy("bucket").applyInArrow(_judge, ANSWERS), "recompress-names")
    column = lambda c, kind: F.lit(None).cast(kind).alias(c)
    told = answers.select("block", column("row", "long"), column("piece", "int"), column("doc_id", "long"), column("tail", "int"), column("pad", "int"), "kind", "one", "two", "keeps", column("text", "binary"))
    asked = cut.select("block", "row", "piece", "doc_id", "tail", column("pad", "int"), column("kind", "int"), column("one", "binary"), column("two", "binary"), column("keeps", "binary"), "text")
    streamed = told.unionByName(asked).repartition(parts, "block").sortWithinPartitions("block", "row", "piece")
    second = saved(streamed.mapInArrow(_resolve(buckets, window, not with_text), SECOND), "recompress-resolved", compression="zstd")
    drop(cut, answers)
    windows = second.where(F.col("kind") == WINDOW_ROW).select("bucket", "block", F.col("piece").alias("kind"), "one", "two", "times")
    answers = saved(windows.groupBy("bucket").applyInArrow(_judge, ANSWERS), "recompress-windows")
    told = answers.select("block", column("row", "long"), column("piece", "int"), column("doc_id", "long"), column("tail", "int"), "kind", "one", "two", column("covered", "binary"), column("asks", "binary"), column("text", "binary"))
    left = second.where(F.col("kind") == OPEN_PIECE).select("block", "row", "piece", "doc_id", "tail", column("kind", "int"), column("one", "binary"), column("two", "binary"), "covered", "asks", "text")
    streamed = told.unionByName(left).repartition(parts, "block").sortWithinPartitions("block", "row", "piece")
    finished = streamed.mapInArrow(_finish(window, with_text), RESULT + ", text string" * with_text)
    settled = second.where(F.col("kind") == RESULT_ROW).select("doc_id", "n_words", "n_removed", F.col("sha").alias("kept_sha256"))
    if not with_text:
        finished = finished.unionByName(settled)
    out = saved(finished, "recompress-rows")
    drop(second, answers)
    return out


def op13_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Per row of documents; see deduplicated for nulls, ties and repeats."""
    return deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), p AS (
  SELECT k, i, array_to_string(w[i:i + 34], ' ') AS s FROM (SELECT k, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)
), again AS (
  SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY s) AS n FROM p) WHERE n > 1
), words AS (
  SELECT k, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d
), judged AS (
  SELECT w.k, w.i, w.word, coalesce(w.i - max(a.i) OVER (PARTITION BY w.k ORDER BY w.i) < 35, false) AS gone
  FROM words w LEFT JOIN again a ON a.k = w.k AND a.i = w.i
), summed AS (
  SELECT k, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM judged GROUP BY k
)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN summed USING (k)
"""
