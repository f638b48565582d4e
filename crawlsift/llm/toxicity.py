"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlsift.llm.marks import among, marked
from crawlsift.llm.sample import binary_labels, class_counts, fold, sample
from crawlsift.llm.storage import saved, saving
from crawlsift.llm.words import Rolling, Words, ascii_lower, mix, shingles, steps, words

FOLDS, HELD_OUT, CUT = 5, 0, 0.5
#: Training texts that are not toxic, and that are.
PER_CLASS = {0: 2500, 1: 1000}
#: Hashed weights; words of a block. A line is one chain; a longer one goes through the model block by block.
BITS, CHAIN = 18, 64
#: Chains without a toxic word that training keeps, whatever the number of texts.
PLAIN_CHAINS = 12_000
PREFIXES, SUFFIXES = (3, 4, 5, 6), (3, 4, 5)
RESULT = "score double, predicted int, spans array<struct<start:int,end:int>>"
LIMIT = 30.0
#: A toxic feature stands in so many toxic documents at least, has so many times the share of them that it has of the
#: others, and is one of those of which a part of FALSE_PART at most is expected to be there by chance. None of the
#: three grows with the corpus.
LEAST_DOCS, LEAST_TIMES, FALSE_PART = 3, 12, 0.01
#: Weights: one a feature, then those of words without and with a toxic feature.
PLACES = (1 << BITS) + 2
HASHES, HASHED, BLOCK = 3, "doc_id long, version long, h array<long>", 1 << 12


def features(data: np.ndarray, w: Words) -> np.ndarray:
    """Places in the weight table of each word's features: the word, its first and last few bytes."""
    rolling, length = Rolling(data), w.end - w.start
    bounds = [(w.start, w.end, 1)]
    bounds += [(w.start, w.start + np.minimum(k, length), 10 + k) for k in PREFIXES]
    bounds += [(w.end - np.minimum(k, length), w.end, 20 + k) for k in SUFFIXES]
    out = np.empty((len(w.start), len(bounds)), np.int32)
    for i, (start, end, seed) in enumerate(bounds):
        out[:, i] = rolling.of(start, end, seed) >> np.uint64(64 - BITS)
    return out


def chains(data: np.ndarray, w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(number of each word's block, rising; place of each block in its line): a new one at each text, line and CHAIN words."""
    n = len(w.start)
    lines = np.concatenate([[0], np.cumsum(data == 10)])[w.start]
    new = np.ones(n, bool)
    new[1:] = (w.row[1:] != w.row[:-1]) | (lines[1:] != lines[:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    within = np.arange(n) - first
    block = np.cumsum(within % CHAIN == 0) - 1
    return block, (within[within % CHAIN == 0] // CHAIN)


@dataclass
class CRF:
    """Two states: 0 plain, 1 toxic. weights score state 1 against state 0; moves[i, j] scores state j after i."""

    weights: np.ndarray
    moves: np.ndarray
    start: float

    def grid(self, chain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of each word in its chain, length of each chain)."""
        length = np.bincount(chain) if len(chain) else np.zeros(0, np.int64)
        return np.arange(len(chain)) - np.repeat(np.cumsum(length) - length, length), length

    def messages(self, emission: np.ndarray, length: np.ndarray, place: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds of state 1 from the left (emission included) and from the right, by block and place in it.

        With two states a message is one number, so forward-backward is a recursion on log-odds. place tells where a
        block is in its line (none: each block is a line): messages go on from a block to the next one of its line.
        Blocks of the same place go together, so a batch takes as many rounds as its longest line has blocks.
        """
        m = np.exp(np.clip(self.moves, -LIMIT, LIMIT))
        rows, span = emission.shape
        left, right = np.zeros((rows, span)), np.zeros((rows, span))
        step_right = lambda r: np.log((m[0, 1] + m[1, 1] * r) / (m[0, 0] + m[1, 0] * r))
        step_left = lambda r: np.log((m[1, 0] + m[1, 1] * r) / (m[0, 0] + m[0, 1] * r))
        odds = lambda x: np.exp(np.clip(x, -LIMIT, LIMIT))
        groups = [np.arange(rows)] if place is None else np.split(np.argsort(place, kind="stable"), np.cumsum(np.bincount(place))[:-1])
        for k, g in enumerate(groups):
            left[g, 0] = emission[g, 0] + (self.start if k == 0 else step_right(odds(left[g - 1, span - 1])))
            for t in range(1, span):
                left[g, t] = emission[g, t] + step_right(odds(left[g, t - 1]))
        goes_on = np.zeros(rows, bool) if place is None else np.append(place[1:] > 0, False)
        for g in reversed(groups):
            on = g[goes_on[g]]
            right[on, span - 1] = step_left(odds(emission[on + 1, 0] + right[on + 1, 0]))
            for t in range(span - 2, -1, -1):
                right[g, t] = np.where(t + 1 < length[g], step_left(odds(emission[g, t + 1] + right[g, t + 1])), 0.0)
        return left, right

    def marginals(self, places: np.ndarray, block: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Chance of state 1 at each word."""
        if not len(block):
            return np.zeros(0)
        at, length = self.grid(block)
        emission = np.zeros((len(length), CHAIN))
        emission[block, at] = self.weights[places].sum(axis=1)
        left, right = self.messages(emission, length, place)
        return 1 / (1 + np.exp(-np.clip((left + right)[block, at], -LIMIT, LIMIT)))


def train(places: np.ndarray, chain: np.ndarray, label: np.ndarray, rounds: int = 6, batch: int = 512, rate: float = 0.2) -> CRF:
    """Gradient ascent (AdaGrad) on the chains' log-likelihood: what the labels have less what the model expects."""
    crf = CRF(np.zeros(PLACES), np.zeros((2, 2)), -2.0)
    seen_w, seen_m, seen_s = np.full(PLACES, 1e-2), np.full((2, 2), 1e-2), 1e-2
    if not len(chain):
        return crf
    at, length = crf.grid(chain)
    first = np.cumsum(length) - length
    rng = np.random.default_rng(10)
    # chains without a toxic word teach little once they are understood: each round takes part of them
    toxic = np.flatnonzero(np.bincount(chain, label) > 0)
    plain = np.setdiff1d(np.arange(len(length)), toxic)
    for _ in range(rounds):
        taken = np.concatenate([toxic, rng.permutation(plain)[: max(4 * len(toxic), 2000)]])
        for chosen in np.array_split(rng.permutation(taken), max(1, len(taken) // batch)):
            n = length[chosen]
            word = np.repeat(first[chosen], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            row, column = np.repeat(np.arange(len(chosen)), n), at[word]
            emission, y = np.zeros((len(chosen), CHAIN)), np.zeros((len(chosen), CHAIN))
            emission[row, column], y[row, column] = crf.weights[places[word]].sum(axis=1), label[word]
            left, right = crf.messages(emission, n)
            p = 1 / (1 + np.exp(-np.clip(left + right, -LIMIT, LIMIT)))
            # pair marginals from both messages: odds of the four (previous, this) pairs
            here = emission[:, 1:] + right[:, 1:]
            pair = np.stack([[np.zeros_like(here) + crf.moves[0, 0], here + crf.moves[0, 1]], [left[:, :-1] + crf.moves[1, 0], left[:, :-1] + here + crf.moves[1, 1]]])
            pair = np.exp(np.clip(pair - pair.max(axis=(0, 1)), -50, 0))
            pair /= pair.sum(axis=(0, 1))
            live = np.arange(1, CHAIN)[None, :] < n[:, None]
            had = [[((y[:, :-1] == i) & (y[:, 1:] == j) & live).sum() for j in (0, 1)] for i in (0, 1)]
            g_move = (np.array(had) - (pair * live).sum(axis=(2, 3))) - 1e-3 * crf.moves
            g_start = (y[:, 0] - p[:, 0]).sum()
            touched, inverse = np.unique(places[word], return_inverse=True)
            error = np.repeat((y[row, column] - p[row, column])[:, None], places.shape[1], axis=1)
            g = np.bincount(inverse.ravel(), error.ravel(), len(touched)) - 1e-3 * crf.weights[touched]
            seen_w[touched] += g**2
            crf.weights[touched] += rate * g / np.sqrt(seen_w[touched])
            seen_m += g_move**2
            crf.moves += rate * g_move / np.sqrt(seen_m)
            seen_s += g_start**2
            crf.start += rate * g_start / np.sqrt(seen_s)
    return crf


def toxic_places(bad: np.ndarray, good: np.ndarray, n_bad: float, n_good: float) -> np.ndarray:
    """Which features are toxic, from the documents of each class that have them.

    A feature is toxic if its share of the toxic documents is many times that of the others, and its likelihood ratio is
    beyond chance: of all features in LEAST_DOCS toxic documents, as many of the largest ratios are taken as keep the
    part that is there by chance under FALSE_PART (the step-up rule for false discoveries).
    """
    n_bad, n_good = max(1, n_bad), max(1, n_good)
    share, other = bad / n_bad, (good + 0.5) / n_good
    part = n_bad / (n_bad + n_good)
    part_of = lambda n, p: n * np.log(np.maximum(n, 1e-9) / np.maximum((bad + good) * p, 1e-9))
    ratio = 2 * (part_of(bad, part) + part_of(good, 1 - part))
    asked = np.flatnonzero(bad >= LEAST_DOCS - 1e-6)
    # chance of as large a ratio, on this side, of a feature that is equally frequent in both classes
    chance = np.array([0.5 * math.erfc(math.sqrt(max(0.0, r) / 2)) for r in ratio[asked]])
    chance = np.where(share[asked] > good[asked] / n_good, chance, 1.0)
    order = np.argsort(chance, kind="stable")
    fits = np.flatnonzero(chance[order] <= FALSE_PART * np.arange(1, len(asked) + 1) / max(1, len(asked)))
    out = np.zeros(len(bad), bool)
    if len(fits):
        out[asked[order[: fits[-1] + 1]]] = True
    return out & (share > LEAST_TIMES * other)


def flagged(places: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """features with one more column, by which the chain model knows toxic words that its sample does not have."""
    return np.column_stack([places, (1 << BITS) + toxic[places].any(axis=1)]).astype(np.int32)


def word_labels(places: np.ndarray, row: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Labels of words from labels of their documents: 1 where a word of a toxic document has a toxic feature."""
    return ((places[:, -1] == PLACES - 1) & (y[row] == 1)).astype(np.int8)


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offsets in steps(batch.column(2)):
            found = [np.array(h, np.uint64).view(np.int64) for h in least_hashes(ascii_lower(data), offsets)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "version", "h"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with each feature, of either class; texts that are there several times count once in all."""
    counts = np.zeros((2, 1 << BITS))
    for batch in batches:
        y, part = batch.column(0).to_numpy(), 1 / batch.column(1).to_numpy()
        for a, _, data, offsets in steps(batch.column(2)):
            low = ascii_lower(data)
            w = words(low, offsets, hashed=False)
            if not len(w.start):
                continue
            for column in features(low, w).T:
                doc_place = np.unique(w.row.astype(np.int64) << BITS | column)
                docs, place = (doc_place >> BITS) + a, doc_place & (1 << BITS) - 1
                for v in (0, 1):
                    mine = y[docs] == v
                    counts[v] += np.bincount(place[mine], part[docs[mine]], 1 << BITS)
    yield _blocks({i: counts[:, i * BLOCK : (i + 1) * BLOCK] for i in range((1 << BITS) // BLOCK)})


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found[block] = np.frombuffer(data) + found.get(block, 0.0)
    yield _blocks(found)


def _blocks(found: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"block": pa.array(list(found), pa.int32()), "data": pa.array([b.tobytes() for b in found.values()], pa.binary())})


def evidence(documents: DataFrame, known: DataFrame) -> np.ndarray:
    """Toxic features, from all labelled documents (known: doc_id, y) whatever their number and length.

    Near copies count once: a text counts if it is the first of those with its value of each of its MinHashes. The
    counts are added up by Spark in a table of fixed size.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"), "text")
    rows = docs.mapInArrow(_hashes, HASHED).where(F.size("h") == HASHES).join(known, "doc_id")
    texts = rows.groupBy("doc_id", "version").agg(F.max("y").alias("y"), F.count("*").alias("copies"), F.first("h").alias("h"))
    own = texts.select(F.struct("doc_id", "version", "y", "copies").alias("who"), F.posexplode("h").alias("k", "v"))
    firsts = own.groupBy("k", "v").agg(F.min("who").alias("who")).groupBy("who").agg(F.count("*").alias("n"))
    fresh = saved(firsts.where(F.col("n") == HASHES).select("who.*"), "toxic-fresh")
    n = class_counts(fresh)
    counts, kind = np.zeros(((1 << BITS) // BLOCK, 2, BLOCK)), "block int, data binary"
    marks = marked(fresh.select("doc_id"))

    def among_them(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(among(marks.value, batch.column(0).to_numpy())))

    with saving(documents.sparkSession):
        # few unlabelled texts move; the hint keeps one plan at every size, as labels are not bounded
        likely = docs.where(F.col("doc_id").isNotNull()).mapInArrow(among_them, docs.schema)
        labelled = likely.join(fresh.hint("merge"), ["doc_id", "version"]).select("y", "copies", "text")
        found = labelled.mapInArrow(_count, kind).repartition("block").mapInArrow(_sum, kind).collect()
    marks.destroy()
    for r in found:
        counts[r.block] = np.frombuffer(r.data).reshape(2, BLOCK)
    good, bad = counts.swapaxes(0, 1).reshape(2, -1)
    return toxic_places(bad, good, n.get(1, 0), n.get(0, 0))


def least_hashes(data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, ...]]:
    """Three MinHash values of each text's five-word shingles; none of a text without words."""
    row, value = shingles(words(data, offsets), 5)
    found: list[tuple[int, ...]] = [()] * (len(offsets) - 1)
    if len(row):
        texts, first = np.unique(row, return_index=True)
        least = [np.minimum.reduceat(value * np.uint64(x), first) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
        for i, t in enumerate(texts):
            found[t] = tuple(int(v[i]) for v in least)
    return found


def unlike(hashes: list[tuple[int, ...]]) -> np.ndarray:
    """Texts that share no MinHash value with an earlier one: near copies would count as evidence of their own."""
    keep, seen = np.ones(len(hashes), bool), [set(), set(), set()]
    for i, mine in enumerate(hashes):
        keep[i] = not any(v in s for v, s in zip(mine, seen, strict=False))
        for v, s in zip(mine, seen, strict=False):
            s.add(v)
    return keep


@dataclass
class Lessons:
    """Blocks to learn from, and each text's standing: blocks with a toxic word, and a bounded part of the others."""

    places: np.ndarray
    block: np.ndarray
    label: np.ndarray
    fresh: np.ndarray


def lessons(texts: list[str], y: np.ndarray, toxic: np.ndarray, third: np.ndarray) -> Lessons:
    """From labelled texts, a step of text at a time: near copies and every third text teach nothing.

    Of the blocks without a toxic word, those with the least hashes of their place are kept, PLAIN_CHAINS of them.
    """
    hashes: list[tuple[int, ...]] = []
    for _, _, data, offsets in steps(pa.array(texts, pa.string())):
        hashes += least_hashes(ascii_lower(data), offsets)
    fresh = unlike(hashes)
    kept: list[tuple[np.ndarray, np.ndarray]] = []
    plain: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # (keys, bounds, features)
    before = 0
    for a, _, data, offsets in steps(pa.array(texts, pa.string())):
        low = ascii_lower(data)
        w = words(low, offsets, hashed=False)
        if not len(w.start):
            continue
        block, _ = chains(low, w)
        row = w.row + a
        use = (fresh & ~third)[row]
        places = flagged(features(low, w), toxic)
        label = word_labels(places, row, y)
        some = np.bincount(block, label) > 0
        taken = use & some[block]
        for b in np.unique(block[taken]):
            i, j = np.searchsorted(block, [b, b + 1])
            kept.append((places[i:j], label[i:j]))
        rest = use & ~some[block]
        ids, first = np.unique(block[rest], return_index=True)
        if len(ids):
            plain.append((mix((ids + before).astype(np.uint64), 5), np.append(first, rest.sum()), places[rest]))
        if sum(len(k) for k, _, _ in plain) > 2 * PLAIN_CHAINS:
            plain = _least(plain)
        before += int(block[-1]) + 1
    plain = _least(plain)
    every = kept + [(p[a:b], np.zeros(b - a, np.int8)) for _, bounds, p in plain for a, b in zip(bounds, bounds[1:], strict=False)]
    if not every:
        return Lessons(np.zeros((0, 2 + len(PREFIXES) + len(SUFFIXES)), np.int32), np.zeros(0, np.int64), np.zeros(0, np.int8), fresh)
    block = np.repeat(np.arange(len(every)), [len(p) for p, _ in every])
    return Lessons(np.concatenate([p for p, _ in every]), block, np.concatenate([x for _, x in every]), fresh)


def _least(plain: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The PLAIN_CHAINS blocks with the least keys, as one entry."""
    if not plain:
        return plain
    keys = np.concatenate([k for k, _, _ in plain])
    if len(keys) <= PLAIN_CHAINS:
        return plain
    cut = np.partition(keys, PLAIN_CHAINS - 1)[PLAIN_CHAINS - 1]
    out = []
    for k, bounds, p in plain:
        keep = k <= cut
        size = np.diff(bounds)
        out.append((k[keep], np.concatenate([[0], np.cumsum(size[keep])]), p[np.repeat(keep, size)]))
    return out


def summaries(crf: CRF, texts: list[str], toxic: np.ndarray) -> np.ndarray:
    """summary of each text, a step of text at a time."""
    out = []
    for _, _, data, offsets in steps(pa.array(texts, pa.string())):
        low = ascii_lower(data)
        w = words(low, offsets, hashed=False)
        p = crf.marginals(flagged(features(low, w), toxic), *chains(low, w)) if len(w.start) else np.zeros(0)
        out.append(summary(p, w.row, len(offsets) - 1))
    return np.concatenate(out)


def summary(p: np.ndarray, row: np.ndarray, texts: int) -> np.ndarray:
    """Of each text: a one, log of the expected toxic words, log-odds of the most toxic word.

    Words of little chance do not add up, so a text does not become toxic by its length.
    """
    total, most = np.bincount(row, np.where(p >= 0.2, p, 0.0), texts), np.zeros(texts)
    np.maximum.at(most, row, p)
    most = np.clip(most, 1e-3, 1 - 1e-3)
    return np.stack([np.ones(texts), np.log(total + 0.05), np.log(most / (1 - most))], axis=1)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weighted ridge logistic regression by Newton's method."""
    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -LIMIT, LIMIT)))
        g = x.T @ (weight * (y - p)) - ridge * b
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b))
        step = np.linalg.solve(h, g)
        b += step * min(1.0, 4 / max(1e-9, np.abs(step).max()))
    return b


@dataclass
class Model:
    crf: CRF
    head: np.ndarray
    toxic: np.ndarray

    def score(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, Words]:
        """(score of each text, marginal of each word, the words)."""
        low = ascii_lower(data)
        w = words(low, offsets, hashed=False)
        p = self.crf.marginals(flagged(features(low, w), self.toxic), *chains(low, w)) if len(w.start) else np.zeros(0)
        z = summary(p, w.row, len(offsets) - 1) @ self.head
        return 1 / (1 + np.exp(-np.clip(z, -LIMIT, LIMIT))), p, w


def fit(documents: DataFrame, labels: DataFrame) -> Model:
    """Finds toxic features in all labelled documents outside the held-out fold, and trains on a bounded sample of them.

    Labels of an id that occurs repeatedly count once, as the largest; rows of documents that repeat one, once a text.
    Null ids, labels and texts teach nothing. Without texts of both classes every text gets the share of toxic ones.
    """
    known = binary_labels(labels, "toxic", FOLDS, HELD_OUT).withColumn("y", (F.col("y") > 0).cast("int"))
    counts = class_counts(known)
    rows = sample(documents, known, sorted(counts), PER_CLASS)
    if len({y for _, y in rows}) < 2:
        prior = np.clip(np.mean([y for _, y in rows] or [0.0]), 1e-3, 1 - 1e-3)
        return Model(CRF(np.zeros(PLACES), np.zeros((2, 2)), -2.0), np.array([np.log(prior / (1 - prior)), 0, 0]), np.zeros(1 << BITS, bool))
    y = np.array([v for _, v in rows])
    texts = [t for t, _ in rows]
    del rows
    toxic = evidence(documents, known)
    # the chain model learns from two thirds of the texts, the score's scale from the others
    third = np.arange(len(y)) % 3 == 0
    learn = lessons(texts, y, toxic, third)
    fresh = learn.fresh
    crf = train(learn.places, learn.block, learn.label)
    x = summaries(crf, texts, toxic)
    taken = {v: max(1, int((y == v).sum())) for v in counts}
    weight = np.array([counts[v] / taken[v] for v in y])
    rest = third & fresh if len(set(y[third & fresh])) == 2 else np.ones(len(y), bool)
    weight = weight[rest] * rest.sum() / weight[rest].sum()
    return Model(crf, logistic(x[rest], y[rest].astype(float), weight, ridge=0.1), toxic)


def _spans(p: np.ndarray, w: Words, data: np.ndarray, texts: int, offsets: np.ndarray) -> pa.Array:
    """Character bounds within its text of each run of toxic words."""
    hit = np.flatnonzero(p >= 0.5)
    new = np.ones(len(hit), bool)
    new[1:] = (hit[1:] != hit[:-1] + 1) | (w.row[hit[1:]] != w.row[hit[:-1]])
    head = hit[new]
    tail = hit[np.append(np.flatnonzero(new)[1:] - 1, len(hit) - 1)] if len(hit) else hit
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    base = chars[offsets[w.row[head]]]
    pairs = pa.StructArray.from_arrays([pa.array((chars[w.start[head]] - base).astype(np.int32)), pa.array((chars[w.end[tail]] - base).astype(np.int32))], ["start", "end"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(w.row[head], np.arange(texts + 1)).astype(np.int32)), pairs)


def scored(documents: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """doc_id, score, predicted and toxic spans (character offsets) of each whole text.

    A null text counts as empty: it has no words, so its score is that of a text without toxic words. Each row of
    documents gives one, repeated rows and rows without a doc_id as well; no rows give none; other columns take no
    part. Lines are scored side by side, whole; a text's length adds lines, not memory beyond the step at hand.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in steps(batch.column(1)):
                score, p, w = shared.value.score(data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(score), pa.array((score >= cut).astype(np.int32)), _spans(p, w, data, b - a, offsets)], ["doc_id", "score", "predicted", "spans"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, {RESULT}")


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(documents, model).withColumn("held_out", fold(F.col("doc_id"), FOLDS) == HELD_OUT)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that score as toxic. The texts are scored in the pass that filters them: no join."""
    shared = spark.sparkContext.broadcast(fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in steps(batch.column(at)):
                yield batch.slice(a, b - a).filter(pa.array(shared.value.score(data, offsets)[0] < CUT))

    return docs.mapInArrow(run, docs.schema)
