"""Alignment of two tokenizers over the same texts by a sweep over the ends of their tokens."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from itertools import chain, repeat

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlsift.llm.storage import drop, saved

A_FILE = public_tokenizers.path("byte_bpe_50k.json")
B_FILE = public_tokenizers.path("piece_bpe_32k.model")
#: Characters of text that one row of events stands for, and bytes of units that a worker remembers; both bound memory only.
SLICE, CACHE_BYTES, UNIT_BYTES = 1 << 16, 64 << 20, 250
#: Characters of text that are encoded at once.
STEP = 1 << 18
#: Pairs of ids whose counts are broadcast (12 bytes each); the counts of all others are joined.
SHARED_PAIRS = 1 << 21
#: Groups of B ids that counts are summed in; a group has 1/256 of all (A id, B id) pairs that the vocabularies allow at most.
BUCKETS = 256
#: A unit begins where a space or a line feed follows anything but white space. No token of either tokenizer spans such a place.
_UNIT = re.compile(r"(?<=[^\s▁])(?=[ \n])")
#: Documents of one batch lie this far apart on the sweep's line.
_DOC = 40


class Tokens:
    """Ids of many units in a row, in arrays that grow by doubling."""

    def __init__(self):
        self.first, self.flat, self.units, self.ids = np.zeros(1024, np.int64), np.zeros(1024, np.uint16), 0, 0

    def add(self, counts: np.ndarray, ids: np.ndarray) -> None:
        for name, need in (("first", self.units + len(counts) + 1), ("flat", self.ids + len(ids))):
            if need > len(old := getattr(self, name)):
                setattr(self, name, np.concatenate([old, np.zeros(max(need, len(old)), old.dtype)]))
        self.first[self.units + 1 : self.units + 1 + len(counts)] = self.ids + np.cumsum(counts)
        self.flat[self.ids : self.ids + len(ids)] = ids
        self.units, self.ids = self.units + len(counts), self.ids + len(ids)

    def of(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the units, where those of each end)."""
        begin, count = self.first[at], self.first[at + 1] - self.first[at]
        ends = np.cumsum(count)
        return self.flat[np.repeat(begin - ends + count, count) + np.arange(ends[-1])], ends


class Spelling:
    """What the tokens of one side spell."""

    def __init__(self, tokens: dict[int, bytes]):
        raw = [tokens.get(i, b"") for i in range(1 << 16)]
        self.length = np.array([len(x) for x in raw])
        self.begin = np.cumsum(self.length) - self.length
        self.data = np.frombuffer(b"".join(raw), np.uint8)

    def of(self, ids: np.ndarray) -> np.ndarray:
        size = self.length[ids]
        ends = np.cumsum(size)
        return self.data[np.repeat(self.begin[ids] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]


class Pair:
    """Both tokenizers: ids of the tokens of a unit of text, remembered."""

    def __init__(self, a_json: bytes, b_model: bytes):
        self.a = tokenizers.Tokenizer.from_str(a_json.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        if any("▁" in p.lstrip("▁") for p in pieces) or any("\n" in p for p in pieces):
            raise ValueError("a piece spans a place where units are cut")
        self.space = self.b.piece_to_id("▁")
        self.a_bytes = {i: _byte_level(t) for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.b_bytes = {i: bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)}
        self.spelling = Spelling(self.a_bytes), Spelling(self.b_bytes)
        self.plain = _ranked(json.loads(a_json), self.a_bytes)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.held = 0
        self.bad: set[int] = set()
        self.tokens = Tokens(), Tokens()

    def a_ids(self, units: list[str]) -> list[list[int]]:
        """By the rank library where it agrees with the other one for certain, several times faster."""
        if self.plain is None:
            return [e.ids for e in self.a.encode_batch_fast(units, add_special_tokens=False)]
        encode = self.plain._core_bpe.encode_ordinary
        out = [encode(u) if _LATIN.fullmatch(u) else None for u in units]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, e in zip(rest, self.a.encode_batch_fast([units[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out

    def learn(self, units: list[str]) -> None:
        """Tokens of new units; a unit is good if the tokens of both are its own bytes."""
        b = self.b.encode([u[1:] if u[0] == " " else u for u in units], num_threads=1)
        # the model puts a space before each text; a unit that does not begin with one has it as a token of its own
        b = [x if u[0] == " " and x else [self.space] if u[0] == " " else x[1:] for u, x in zip(units, b, strict=True)]
        raw = [u.encode() for u in units]
        whole, size = np.frombuffer(b"".join(raw), np.uint8), np.array([len(w) for w in raw])
        begin, bad = np.cumsum(size) - size, np.zeros(len(units), bool)
        for ids, tokens, spelling in zip((self.a_ids(units), b), self.tokens, self.spelling, strict=True):
            counts = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter(chain.from_iterable(ids), np.uint16, int(counts.sum()))
            tokens.add(counts, flat)
            spelt = np.append(0, np.cumsum(spelling.length[flat]))
            ends = np.cumsum(counts)
            length = spelt[ends] - spelt[ends - counts]
            bad |= length != size
            if not bad.any() and np.array_equal(spelling.of(flat), whole):
                continue
            text = spelling.of(flat).tobytes()
            upto = np.cumsum(length)
            bad |= [text[x:y] != w for x, y, w in zip(upto - length, upto, raw, strict=True)]
        self.bad.update((np.flatnonzero(bad) + len(self.known)).tolist())
        self.known.update(zip(units, range(len(self.known), len(self.known) + len(units)), strict=True))
        self.held += len(whole) + UNIT_BYTES * len(units)

    def encode(self, texts: list[str]) -> list[tuple[bool, bytes, bytes]]:
        """Of each text: whether its tokens spell it, A ids, B ids, as 16-bit numbers."""
        if self.held > CACHE_BYTES:
            self.forget()
        units, upto = [], []
        for t in texts:
            units += _UNIT.split(t)
            upto.append(len(units))
        at = np.fromiter(map(self.known.get, units, repeat(-1)), np.int64, len(units))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new = [units[i] for i in missing.tolist()]
            self.learn(list(dict.fromkeys(new)))
            at[missing] = np.fromiter(map(self.known.__getitem__, new), np.int64, len(new))
        bounds = [0, *upto]
        bad = np.isin(at, list(self.bad)) if self.bad else np.zeros(len(at), bool)
        some = np.append(0, np.cumsum(bad))[bounds]
        parts = []
        for tokens in self.tokens:
            ids, ends = tokens.of(at)
            ends = np.append(0, ends)[bounds]
            parts.append([ids[x:y].tobytes() for x, y in zip(ends, ends[1:])])
        return list(zip((some[1:] == some[:-1]).tolist(), *parts, strict=True))


#: Texts of these characters alone are split alike by both libraries (tested for all pairs of them).
_LATIN = re.compile("[\n\x20-\x7e\xa1-\u017f]*")


def _ranked(model: dict, tokens: dict[int, bytes]) -> tiktoken.Encoding | None:
    """The same merges as ranks, where the file's order of merges is that of its ids; else None."""
    kind = model["pre_tokenizer"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
    made = [model["model"]["vocab"].get("".join(m)) for m in merges]
    simple = kind["type"] == "ByteLevel" and kind["use_regex"] and not kind["add_prefix_space"] and not model["normalizer"] and not model["model"].get("ignore_merges")
    if not simple or None in made or any(x >= y for x, y in zip(made, made[1:])):
        return None
    ranks = {tokens[i]: i for i in [*(i for i, t in tokens.items() if len(t) == 1), *made]}
    return tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}) if len(ranks) == 256 + len(made) else None


def _byte_level(token: str) -> bytes:
    """Bytes of a byte-level token: printable Latin-1 stands for itself, the other bytes for U+0100 and what follows."""
    return bytes(_BYTES[c] for c in token) if all(c in _BYTES for c in token) else token.encode()


_PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTES = {chr(b): b for b in _PLAIN} | {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in _PLAIN)}


def slices(text: str, size: int = SLICE) -> Iterator[str]:
    """The text in slices of about `size` characters, cut where units are."""
    at = 0
    while at < len(text):
        cut = _UNIT.search(text, at + size) if at + size < len(text) else None
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


EVENTS = "k long, doc_id long, at long, side int, ids binary"
NO_TOKENS = 2


def _events(files, size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pair_of(files.value)

        def rows(documents: list[tuple[int, int, list[str]]]) -> pa.RecordBatch:
            found, out = iter(both.encode([s for *_, parts in documents for s in parts])), []
            for k, doc, parts in documents:
                at, mine, good = 0, [], True
                for s in parts:
                    fine, a, b = next(found)
                    good &= fine
                    mine += [(k, doc, at, 0, a), (k, doc, at, 1, b)]
                    at += len(s.encode())
                out += mine if good else [(k, doc, -1, NO_TOKENS, None)]
            return _batch(out, EVENTS)

        for batch in batches:
            waiting, held = [], 0
            none = []
            for k, doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not text:
                    none.append((k, doc, -1, NO_TOKENS, None))
                    continue
                waiting.append((k, doc, list(slices(f" {text}", size))))
                held += len(text)
                if held > STEP:
                    yield rows(waiting)
                    waiting, held = [], 0
            if waiting:
                yield rows(waiting)
            yield _batch(none, EVENTS)

    return run


def _batch(rows: list[tuple], kind: str) -> pa.RecordBatch:
    types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    names, of = zip(*(c.split() for c in kind.split(", ")), strict=True)
    columns = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, t in zip(columns, of, strict=True)], list(names))


#: The decimal digits of each id, right-aligned behind a place for the sign before it, and which places count.
_IDS = np.arange(1 << 16)
_DIGITS = np.stack([np.full(1 << 16, 44), *(48 + _IDS // 10**p % 10 for p in (4, 3, 2, 1, 0))], axis=1).astype(np.uint8)
_PLACES = np.stack([np.ones(1 << 16, bool), *(_IDS >= 10**p for p in (4, 3, 2, 1)), np.ones(1 << 16, bool)], axis=1)

#: Bytes of ids that the sweep works on at once.
SWEEP_BYTES = 1 << 20


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about SWEEP_BYTES of ids."""
    step = np.cumsum([len(x) if x else 0 for x in batch.column(4).to_pylist()]) // SWEEP_BYTES
    bounds = [0, *(np.flatnonzero(step[1:] != step[:-1]) + 1).tolist(), batch.num_rows]
    for x, y in zip(bounds, bounds[1:]):
        yield batch.slice(x, y - x)


SWEPT = "k long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pa binary, pb binary, times binary"
GROUPS = "doc_id long, end long, a array<int>, b array<int>"


def _sweep(a_length: np.ndarray, b_length: np.ndarray, groups: bool = False) -> Callable:
    """The machine that events go through by document and offset. Its state: the document, its digest so far, and the
    tokens since the last place where tokens of both sides ended."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_k, open_doc, sha, fresh = None, None, hashlib.sha256(), True
        rest = {s: (np.zeros(0, np.uint16), np.zeros(0, np.int64)) for s in (0, 1)}  # ids and end offsets of the open document

        def closed() -> list[tuple]:
            return [] if open_k is None else [(open_k, open_doc, 0, 0, 0, 0, "" if fresh else sha.hexdigest(), None, None, None)]

        for batch in (part for whole in batches for part in _parts(whole)):
            out: list[tuple] = []
            k, doc, at, side = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            docs = batch.column(1)
            if not len(k):
                continue
            data = batch.column(4)
            names, number = np.unique(k, return_inverse=True)  # keys ascend
            begins = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
            if open_k is not None and names[0] != open_k:
                out += closed()
                open_k = None
            ids, ends = {}, {}
            for s, length in ((0, a_length), (1, b_length)):
                rows = np.flatnonzero(side == s)
                parts = [np.frombuffer(data[int(r)].as_py(), np.uint16) for r in rows]
                base = np.repeat((number[rows].astype(np.int64) << _DOC) + at[rows], [len(x) for x in parts])
                part = np.concatenate([np.zeros(0, np.uint16), *parts])
                run_ = np.cumsum(length[part])
                first = np.cumsum([0, *map(len, parts)])[:-1]
                before = np.repeat(np.concatenate([[0], run_])[first], [len(x) for x in parts]) if len(parts) else run_
                own, own_ends = (rest[s] if open_k is not None else (np.zeros(0, np.uint16), np.zeros(0, np.int64)))
                ids[s], ends[s] = np.concatenate([own, part]), np.concatenate([own_ends, base + run_ - before])
            last = len(names) - 1
            # cuts: where tokens of both sides end; whatever lies behind the last of them waits
            to_b = np.searchsorted(ends[1], ends[0])
            is_cut = to_b < len(ends[1])
            is_cut[is_cut] = ends[1][to_b[is_cut]] == ends[0][is_cut]
            cuts = ends[0][is_cut]
            upto = cuts[-1] if len(cuts) else -1
            done = {s: int(np.searchsorted(ends[s], upto, "right")) for s in (0, 1)}
            rest = {s: (ids[s][done[s] :], ends[s][done[s] :] - (last << _DOC)) for s in (0, 1)}
            a, b = ids[0][: done[0]], ids[1][: done[1]]
            ea, eb = ends[0][: done[0]], ends[1][: done[1]]
            to_b, is_cut = to_b[: done[0]], is_cut[: done[0]]
            # an end of either side is the end of one overlap: of the two tokens that lie before it
            to_a = np.searchsorted(ea, eb)
            inner = ea[to_a] != eb
            left = np.concatenate([a, a[to_a[inner]]]).astype(np.uint64)
            right = np.concatenate([b[to_b], b[inner]]).astype(np.uint64)
            link_doc = (np.concatenate([ea, eb[inner]]) >> _DOC).astype(np.uint64)
            links = np.sort(link_doc << np.uint64(32) | right << np.uint64(16) | left)
            heads = np.flatnonzero(np.append(True, links[1:] != links[:-1])) if len(links) else np.zeros(0, np.int64)
            times = np.diff(np.append(heads, len(links))).astype(np.uint32)
            links = links[heads]
            link_bounds = np.searchsorted(links, np.arange(last + 2, dtype=np.uint64) << np.uint64(32))
            count = lambda x: np.bincount(x >> _DOC, minlength=last + 1)
            n_a, n_b, n_g, n_l = count(ea), count(eb), count(cuts), np.bincount(link_doc.astype(np.int64), minlength=last + 1)
            # the groups as text: in each group A's ids, then B's, every id behind the sign that goes before it
            ga, gb = np.searchsorted(cuts, ea), np.searchsorted(cuts, eb)
            a_upto, b_upto = np.searchsorted(ea, cuts, "right"), np.searchsorted(eb, cuts, "right")
            order = np.empty(len(a) + len(b), np.int64)
            pos_a = np.arange(len(a)) + np.append(0, b_upto)[ga]
            pos_b = np.arange(len(b)) + a_upto[gb]
            flat = np.empty(len(order), np.uint16)
            flat[pos_a], flat[pos_b] = a, b
            sign = np.full(len(order), 44, np.uint8)
            if len(cuts):
                sign[pos_a[np.append(0, a_upto[:-1])]] = 59
                sign[pos_b[np.append(0, b_upto[:-1])]] = 124
            text = _DIGITS[flat]
            text[:, 0] = sign
            keep = _PLACES[flat]
            size = np.append(0, np.cumsum(keep.sum(axis=1)))
            text = text[keep]
            token_bounds = np.append(0, np.cumsum(n_a + n_b))
            if groups:
                lists = [np.append(0, x) for x in (a_upto, b_upto)]
                yield pa.RecordBatch.from_arrays([docs.take(pa.array(begins[cuts >> _DOC])), pa.array(cuts & ((1 << _DOC) - 1)), *(pa.ListArray.from_arrays(pa.array(o, pa.int32()), pa.array(x, pa.int32())) for o, x in zip(lists, (a, b), strict=True))], ["doc_id", "end", "a", "b"])
            for i in range(last + 1):
                if open_k is None:
                    open_k, open_doc, sha, fresh = int(names[i]), docs[int(begins[i])].as_py(), hashlib.sha256(), True
                piece = text[size[token_bounds[i]] : size[token_bounds[i + 1]]]
                if len(piece):
                    sha.update(piece[1:] if fresh else piece)
                    fresh = False
                mine = slice(link_bounds[i], link_bounds[i + 1])
                packed = [None] * 3 if mine.start == mine.stop else [links[mine].astype(np.uint16).tobytes(), (links[mine] >> np.uint64(16)).astype(np.uint16).tobytes(), times[mine].tobytes()]
                whole = i < last
                out.append((open_k, open_doc, int(n_a[i]), int(n_b[i]), int(n_g[i]), int(n_l[i]), ("" if fresh else sha.hexdigest()) if whole else None, *packed))
                if whole:
                    open_k = None
            if not groups:
                yield _batch(out, SWEPT)
        if not groups and open_k is not None:
            yield _batch(closed(), SWEPT)

    return run


def _summed(pairs: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(pairs, kind="stable")
    pairs, times = pairs[order], times[order]
    heads = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1])) if len(pairs) else np.zeros(0, np.int64)
    return pairs[heads], np.add.reduceat(times, heads) if len(heads) else times


PARTS = "bucket int, pairs binary, times binary"


def _unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(pair, times) of all rows of packed links: pair is B id * 2^16 + A id."""
    a, b, times = (np.frombuffer(b"".join(x for x in c.to_pylist() if x), t) for c, t in zip(batch.columns[-3:], (np.uint16, np.uint16, np.uint32), strict=True))
    return b.astype(np.uint32) << np.uint32(16) | a, times.astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a task's pairs, by bucket of their B id; given away whenever they are many."""
    held, new, size = (np.zeros(0, np.uint32), np.zeros(0, np.int64)), [], 0

    def parts() -> pa.RecordBatch:
        bucket = (held[0] >> np.uint32(16)) % BUCKETS
        order = np.argsort(bucket, kind="stable")
        bounds = np.searchsorted(bucket[order], np.arange(BUCKETS + 1))
        return _batch([(i, held[0][order[x:y]].tobytes(), held[1][order[x:y]].tobytes()) for i, (x, y) in enumerate(zip(bounds, bounds[1:])) if x < y], PARTS)

    for batch in batches:
        new.append(_unpacked(batch))
        size += len(new[-1][0])
        if size > 1 << 21:
            held = _summed(*(np.concatenate(x) for x in zip(held, *new, strict=True)))
            new, size = [], 0
            if len(held[0]) > 1 << 21:
                yield parts()
                held = (held[0][:0], held[1][:0])
    held = _summed(*(np.concatenate(x) for x in zip(held, *new, strict=True)))
    yield parts()


COUNTS = "bucket int, pairs binary, counts binary, b binary, best binary"


def _bucket(table: pa.Table) -> pa.Table:
    pairs, counts = (np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in (("pairs", np.uint32), ("times", np.int64)))
    pairs, counts = _summed(pairs, counts)
    b, first = np.unique(pairs >> np.uint32(16), return_index=True)
    best = np.maximum.reduceat(counts, first)
    return pa.Table.from_batches([_batch([(table.column("bucket")[0].as_py(), pairs.tobytes(), counts.tobytes(), b.astype(np.uint16).tobytes(), best.tobytes())], COUNTS)])


class Lookup:
    """Counts of pairs by open addressing, and the highest count of each B id."""

    def __init__(self, pairs: np.ndarray, counts: np.ndarray, best: np.ndarray):
        self.bits = max(10, int(len(pairs) * 2).bit_length())
        self.key, self.count, self.best = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int64), best
        left = np.arange(len(pairs))
        step = 0
        while len(left):
            at = self._at(pairs[left], step)
            free = self.key[at] < 0
            self.key[at[free]] = pairs[left[free]]  # of several that want a place, the last has it
            won = self.key[at] == pairs[left]
            self.count[at[won]] = counts[left[won]]
            left, step = left[~won], step + 1
        self.steps = step

    def _at(self, pairs: np.ndarray, step: int) -> np.ndarray:
        h = pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (((h >> np.uint64(64 - self.bits)) + np.uint64(step)) & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def of(self, pairs: np.ndarray) -> np.ndarray:
        """The count of each pair, 0 where it is not among those held."""
        out = np.zeros(len(pairs), np.int64)
        left = np.arange(len(pairs))
        for step in range(self.steps):
            at = self._at(pairs[left], step)
            hit = self.key[at] == pairs[left]
            out[left[hit]] = self.count[at[hit]]
            left = left[~hit & (self.key[at] >= 0)]
            if not len(left):
                break
        return out


JUDGED = "k long, n_best long, count_sum long, rare_pairs array<long>, rare_times array<long>"


def _judged(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(*shared.value)
        for batch in batches:
            pairs, times = _unpacked(batch)
            bounds = np.append(0, np.cumsum([len(x) // 2 if x else 0 for x in batch.column(1).to_pylist()]))
            counts = lookup.of(pairs)
            rare = np.append(0, np.cumsum(counts == 0))
            sums = np.append(0, np.cumsum(counts * times))
            bests = np.append(0, np.cumsum(np.where(counts == lookup.best[pairs >> np.uint32(16)], times, 0)))
            some = counts == 0
            lists = [pa.ListArray.from_arrays(pa.array(rare[bounds], pa.int32()), pa.array(x[some].astype(np.int64))) for x in (pairs, times)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x[bounds[1:]] - x[bounds[:-1]]) for x in (bests, sums)), *lists], [c.split()[0] for c in JUDGED.split(", ")])

    return run


_pairs: dict[str, Pair] = {}


def pair_of(files: tuple[bytes, bytes]) -> Pair:
    """One a worker process and pair of vocabularies: what was encoded for one task serves the next."""
    key = "".join(hashlib.sha256(f).hexdigest() for f in files)
    if key not in _pairs:
        _pairs[key] = Pair(*files)
    return _pairs[key]


def events(documents: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE, slice_chars: int = SLICE) -> DataFrame:
    """(k, doc_id, at, side, ids): a row holds the token ends of one side in a slice of a document, as the tokens' ids
    from byte offset `at` on; k tells the rows of documents apart. A document without tokens has one row of side 2."""
    rows = documents.select(F.monotonically_increasing_id().alias("k"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    with open(a_file, "rb") as f, open(b_file, "rb") as g:
        files = documents.sparkSession.sparkContext.broadcast((f.read(), g.read()))
    return rows.mapInArrow(_events(files, slice_chars), EVENTS)


def _swept(documents: DataFrame, a_file: str, b_file: str, groups: bool, slice_chars: int = SLICE) -> DataFrame:
    spark = documents.sparkSession
    with open(a_file, "rb") as f, open(b_file, "rb") as g:
        a_length, b_length = (x.length for x in pair_of((f.read(), g.read())).spelling)
    dealt = events(documents, a_file, b_file, slice_chars).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "k").sortWithinPartitions("k", "at", "side")
    return dealt.mapInArrow(_sweep(a_length, b_length, groups), GROUPS if groups else SWEPT)


def groups(documents: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE) -> DataFrame:
    """(doc_id, end, a, b): the least groups of tokens of both sides that end together, and the byte offset of that end in
    space + text. Documents whose text is null, empty or not what their tokens spell give no rows."""
    return _swept(documents, a_file, b_file, True)


def aligned(documents: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE, shared_pairs: int = SHARED_PAIRS, slice_chars: int = SLICE) -> DataFrame:
    """Groups and links of each document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Ends of both sides' tokens are events; they are dealt by document, sorted by offset and go through a machine that
    knows the current document and the tokens since the last common end. Events travel packed, a row a slice of one
    side; slices of a long text are cut at spaces and line feeds, where both sides end. Counts of linked pairs are summed
    within tasks, then by B id; the most frequent ones, shared_pairs at most, are broadcast, and the others joined.

    A null or empty text, and one that its tokens do not spell, has zeros and an empty digest. Repeated rows give a row
    each and count each; a null doc_id stays null; no rows give none; other columns take no part.
    """
    spark = documents.sparkSession
    swept = saved(_swept(documents, a_file, b_file, False, slice_chars), "align-swept", compression="zstd")
    packed = swept.where(F.col("pa").isNotNull()).select("k", "pa", "pb", "times")
    counts = saved(packed.mapInArrow(_counted, PARTS).groupBy("bucket").applyInArrow(_bucket, COUNTS), "align-counts")
    best = np.zeros(1 << 16, np.int64)
    for r in counts.select("b", "best").toLocalIterator():
        best[np.frombuffer(r.b, np.uint16)] = np.frombuffer(r.best, np.int64)
    least = _least_shared(counts, shared_pairs)
    often = counts.select("pairs", "counts").mapInArrow(_at_least(least), "pairs binary, counts binary").collect()
    pairs, number = (np.frombuffer(b"".join(r[i] for r in often), t) for i, t in ((0, np.uint32), (1, np.int64)))
    judged = packed.mapInArrow(_judged(spark.sparkContext.broadcast((pairs, number, best))), JUDGED)
    parts = judged.select("k", "n_best", "count_sum")
    if least > 1:
        judged = saved(judged, "align-judged")
        parts = judged.select("k", "n_best", "count_sum").unionByName(_rare(judged, counts, least, best))
    stats = swept.select("k", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", F.lit(0).cast("long").alias("n_best"), F.lit(0).cast("long").alias("count_sum"))
    rows = stats.unionByName(parts, allowMissingColumns=True).groupBy("k").agg(
        F.max("doc_id").alias("doc_id"), *(F.sum(c).alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), F.max("groups_sha256").alias("groups_sha256")
    )
    out = saved(rows.drop("k"), "align-rows")
    drop(swept, counts, *[judged] * (least > 1))
    return out


def _least_shared(counts: DataFrame, shared_pairs: int) -> int:
    """The least power of two such that at most shared_pairs pairs have at least so many links."""

    def by_power(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(64, np.int64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                total += np.bincount(np.log2(np.frombuffer(x, np.int64)).astype(int), minlength=64)
        yield pa.RecordBatch.from_pydict({"power": pa.array(range(64), pa.int32()), "n": pa.array(total)})

    n = {r.power: r.n for r in counts.select("counts").mapInArrow(by_power, "power int, n long").groupBy("power").agg(F.sum("n").alias("n")).collect()}
    power, total = 64, 0
    while power and total + n.get(power - 1, 0) <= shared_pairs:
        power -= 1
        total += n.get(power, 0)
    return 1 << power


def _at_least(least: int, below: bool = False) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                p, c = np.frombuffer(p, np.uint32), np.frombuffer(c, np.int64)
                some = (c < least) if below else (c >= least)
                yield pa.RecordBatch.from_pydict({"pairs": pa.array([p[some].tobytes()], pa.binary()), "counts": pa.array([c[some].tobytes()], pa.binary())})

    return run


def _rare(judged: DataFrame, counts: DataFrame, least: int, best: np.ndarray) -> DataFrame:
    """(k, n_best, count_sum) of links whose pair has fewer than `least`: joined by pair."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                p, c = np.frombuffer(p, np.uint32), np.frombuffer(c, np.int64)
                yield pa.RecordBatch.from_pydict({"pair": pa.array(p.astype(np.int64)), "n": pa.array(c), "top": pa.array(c == best[p >> np.uint32(16)])})

    known = counts.select("pairs", "counts").mapInArrow(_at_least(least, below=True), "pairs binary, counts binary").mapInArrow(listed, "pair long, n long, top boolean")
    asked = judged.select("k", F.explode(F.arrays_zip("rare_pairs", "rare_times")).alias("r")).select("k", F.col("r.rare_pairs").alias("pair"), F.col("r.rare_times").alias("times"))
    met = asked.join(known, "pair")
    return met.groupBy("k").agg(F.sum(F.when(F.col("top"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum"))


def op11_token_alignment(spark, sf_dir: str) -> DataFrame:
    """Per row of documents; see aligned for nulls, ties and repeats. All B ids' highest counts take ties along."""
    return aligned(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
