"""Line dedup: an exact set-similarity join of lines by prefix, positional and length filters."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlsift.llm.marks import among, marked
from crawlsift.llm.storage import saved, saving
from crawlsift.llm.words import mix, steps, words

#: Token counts are kept by hash in this many places, so that the table of rarity has one size for any corpus.
#: Tokens that share a place count as less rare than they are, which costs candidates but no match.
COUNT_BITS, COUNT_BLOCK = 24, 1 << 14
#: Tokens counted more often than this are frequent: their lines are first held against each token's first line.
FREQUENT = 1024
LINES = "doc_id long, version long, line int, n int, k1 long, k2 long, parity long, parity2 long, rare int, prefix array<int>"
SETS = "doc_id long, version long, line int, k1 long, k2 long, tokens array<long>"


@dataclass(frozen=True)
class Rule:
    """Lines of min_words words or more are copies if the Jaccard similarity of their token sets is threshold or more."""

    threshold: float = 0.8
    min_words: int = 5

    def ceil(self, x: np.ndarray) -> np.ndarray:
        return np.ceil(x - 1e-9).astype(np.int64)

    def overlap(self, a: Column, b: Column) -> Column:
        """Tokens that sets of these sizes must share."""
        return F.ceil((a + b) * F.lit(self.threshold / (1 + self.threshold)) - 1e-9)

    def similar(self, a: Column, b: Column) -> Column:
        """The Jaccard similarity of two arrays of distinct tokens is the threshold or more."""
        shared = F.size(F.array_intersect(a, b))
        return shared * F.lit(1 + self.threshold) >= (F.size(a) + F.size(b)) * F.lit(self.threshold) - 1e-9

    def index_length(self, n: Column) -> Column:
        """Prefix of a set that is matched by sets of its size or larger ones only."""
        return n - F.ceil(n * F.lit(2 * self.threshold / (1 + self.threshold)) - 1e-9) + 1


#: The operator's rule: all lines with a word take part. Sets of up to three words are similar to equal ones only, which
#: grouping finds, so they have no prefix.
EVERY = Rule(min_words=1)


def rarity_class(counts: np.ndarray) -> np.ndarray:
    return np.minimum(255, (8 * np.log2(counts + 1.0)).astype(np.int64)).astype(np.uint8)


def _place(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - COUNT_BITS)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1 << COUNT_BITS, np.uint16)
    for batch in batches:
        for _, _, data, offsets in steps(batch.column(0)):
            places = np.sort(_place(words(data, offsets, split=True).hash).astype(np.uint32))
            first = np.flatnonzero(np.append(True, places[1:] != places[:-1])) if len(places) else places
            at = places[first]
            counts[at] = np.minimum(counts[at] + np.diff(np.append(first, len(places))), 65535)
    yield _blocks({i: b for i, b in enumerate(counts.reshape(-1, COUNT_BLOCK)) if b.any()})


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            part = np.frombuffer(data, np.uint16).astype(np.int64)
            found[block] = part + found[block] if block in found else part
    yield _blocks({i: rarity_class(b) for i, b in found.items()})


def _blocks(found: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"block": pa.array(list(found), pa.int32()), "data": pa.array([b.tobytes() for b in found.values()], pa.binary())})


def token_rarity(documents: DataFrame) -> Broadcast:
    """Rarity class of every place: counts of all tokens of all documents, added up by Spark."""
    kind = "block int, data binary"
    classes = np.zeros(1 << COUNT_BITS, np.uint8).reshape(-1, COUNT_BLOCK)
    with saving(documents.sparkSession):
        rows = documents.select("text").mapInArrow(_count, kind).repartition("block").mapInArrow(_sum, kind).collect()
    for row in rows:
        classes[row.block] = np.frombuffer(row.data, np.uint8)
    return documents.sparkSession.sparkContext.broadcast(classes.tobytes())


@dataclass
class Lines:
    """Token sets of lines, tokens from rare to frequent: first[i] is where line i's begin."""

    row: np.ndarray
    number: np.ndarray
    first: np.ndarray
    token: np.ndarray
    rarity: np.ndarray

    @property
    def size(self) -> np.ndarray:
        return np.diff(np.append(self.first, len(self.token)))

    def keys(self) -> list[np.ndarray]:
        return [np.add.reduceat(mix(self.token, seed), self.first).view(np.int64) for seed in (1, 2)]


def token_sets(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray | None, min_words: int) -> Iterator[Lines]:
    """The lines of min_words words or more. Without classes all tokens count as equally rare."""
    w = words(data, offsets, split=True)
    if not len(w.start):
        return
    newlines = np.flatnonzero(data == 10)
    number = np.searchsorted(newlines, w.start) - np.searchsorted(newlines, offsets[:-1])[w.row]
    new = np.ones(len(w.row), bool)
    new[1:] = (w.row[1:] != w.row[:-1]) | (number[1:] != number[:-1])
    line = np.cumsum(new) - 1
    long = np.bincount(line) >= min_words
    keep = long[line]
    if not keep.any():
        return
    h, row, number, line = w.hash[keep], w.row[keep], number[keep], (np.cumsum(long) - 1)[line[keep]]
    # 2^14 lines at a time: line, rarity and 42 bits of the hash then fit one sort key
    cuts = np.searchsorted(line, np.arange(0, line[-1] + 1, 1 << 14))
    for a, b in zip(cuts, np.append(cuts[1:], len(line)), strict=True):
        part, token = line[a:b] - line[a], h[a:b]
        rarity = classes[_place(token)] if classes is not None else np.zeros(len(token), np.uint8)
        order = np.argsort(part.astype(np.uint64) << np.uint64(50) | rarity.astype(np.uint64) << np.uint64(42) | token >> np.uint64(22))
        token, part, rarity = token[order], part[order], rarity[order]
        fresh = np.ones(len(token), bool)
        fresh[1:] = (part[1:] != part[:-1]) | (token[1:] != token[:-1])
        token, part, rarity, at = token[fresh], part[fresh], rarity[fresh], (order + a)[fresh]
        first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        yield Lines(row[at[first]], number[at[first]], first, token, rarity)


def _lines(rule: Rule, shared: Broadcast) -> Callable:
    frequent = int(rarity_class(np.array([FREQUENT]))[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            ids, versions = batch.column(0), batch.column(1)
            for a, b, data, offsets in steps(batch.column(2)):
                for x in token_sets(data, offsets, classes, rule.min_words):
                    n = x.size
                    length = n - rule.ceil(n * rule.threshold) + 1
                    length[n / (n + 1) < rule.threshold - 1e-9] = 0  # no other set can be similar
                    within = np.arange(len(x.token)) - np.repeat(x.first, n)
                    taken = within < np.repeat(length, n)
                    rare = np.add.reduceat(taken & (x.rarity <= frequent), x.first, dtype=np.int32)
                    bit = np.uint64(1) << (x.token & np.uint64(63))
                    half = x.token & np.uint64(64) > 0
                    parity, parity2 = (np.bitwise_xor.reduceat(np.where(half == h, bit, np.uint64(0)), x.first).view(np.int64) for h in (False, True))
                    parity[length == 0] = parity2[length == 0] = 0  # no filter asks for them
                    prefix = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(length)]).astype(np.int32), (x.token[taken] >> np.uint64(32)).astype(np.uint32).view(np.int32))
                    at = pa.array(x.row + a)
                    yield pa.RecordBatch.from_arrays([ids.take(at), versions.take(at), pa.array(x.number.astype(np.int32)), pa.array(n.astype(np.int32)), *map(pa.array, x.keys()), pa.array(parity), pa.array(parity2), pa.array(rare), prefix], [c.split()[0] for c in LINES.split(", ")])

    return run


def _sets(rule: Rule, texts: Broadcast, bits: Broadcast) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(among(texts.value, batch.column(3).to_numpy(zero_copy_only=False))))
            ids, versions = batch.column(0), batch.column(1)
            for a, b, data, offsets in steps(batch.column(2)):
                for x in token_sets(data, offsets, None, rule.min_words):
                    k1, k2 = x.keys()
                    hit = among(bits.value, k1)
                    taken = np.repeat(hit, x.size)
                    tokens = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(x.size[hit])]).astype(np.int32), x.token[taken].view(np.int64))
                    at = pa.array((x.row + a)[hit])
                    yield pa.RecordBatch.from_arrays([ids.take(at), versions.take(at), pa.array(x.number[hit].astype(np.int32)), pa.array(k1[hit]), pa.array(k2[hit]), tokens], [c.split()[0] for c in SETS.split(", ")])

    return run


def packed(token: Column, n: Column, at: Column) -> Column:
    """Token, size and place in one long: what a prefix row carries decides how much the join moves.

    Sizes end at 2^20 - 1 and places at 4095, which only loosens the filters.
    """
    return F.shiftleft(token.cast("long"), 32).bitwiseOR(F.shiftleft(F.least(n, F.lit((1 << 20) - 1)).cast("long"), 12)).bitwiseOR(F.least(at, F.lit(4095)).cast("long"))


def token(side: str) -> Column:
    return F.shiftright(F.col(f"{side}.head"), 32)


def size(side: str) -> Column:
    return F.shiftright(F.col(f"{side}.head"), 12).bitwiseAND(F.lit((1 << 20) - 1))


def place(side: str) -> Column:
    return F.col(f"{side}.head").bitwiseAND(F.lit(4095))


def _may_match(rule: Rule, x: str, y: str) -> Column:
    """Length, positional and parity filters for rows x, y that share a prefix token."""
    c = lambda side, name: F.col(f"{side}.{name}")
    need = rule.overlap(size(x), size(y))
    differ = F.bit_count(c(x, "parity").bitwiseXOR(c(y, "parity"))) + F.bit_count(c(x, "parity2").bitwiseXOR(c(y, "parity2")))
    return (
        (F.least(size(x), size(y)) >= F.greatest(size(x), size(y)) * F.lit(rule.threshold) - 1e-9)
        & (F.least(size(x) - place(x), size(y) - place(y)) >= need)
        & (differ <= size(x) + size(y) - 2 * need)
    )


def _verified(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """(k1, k2) of every set that is similar to the other one of a pair (a, b) of k1s and comes later."""
    side = lambda c: sets.select(F.col("k1").alias(c), F.struct("first", "k1", "k2").alias(f"who_{c}"), F.col("tokens").alias(f"t{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    near = both.where(rule.similar(F.col("ta"), F.col("tb")))
    return near.where(F.col("who_a") != F.col("who_b")).select(F.greatest("who_a", "who_b").alias("who")).select("who.k1", "who.k2").distinct()


def duplicate_lines(documents: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """(doc_id, version, lines, removed) of each distinct pair of doc_id and text with a line long enough to compare.

    Null and empty texts have none; rows that repeat a doc_id and text are one; other columns take no part.

    version is xxhash64(text); lines counts lines of rule.min_words words or more, removed lists (from 0) those
    whose set of words (ASCII letters in lower case; each character of scripts without spaces) is similar to that of an earlier line: one of a smaller doc_id
    (null first), then version, then line number. Lines removed still count as earlier. Equal sets are found by
    grouping, so a line that very many documents share is one row of the join.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"), "text").where(F.length("text") > 0)
    rarity = token_rarity(docs)
    lines = saved(docs.mapInArrow(_lines(rule, rarity), LINES), "lines")
    rarity.destroy()
    best = lines.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "version", "line", "n", "parity", "parity2", "rare", "prefix")).alias("r"))
    reps = saved(best.select("k1", "k2", F.struct("r.doc_id", "r.version", "r.line").alias("first"), "r.n", "r.parity", "r.parity2", "r.rare", "r.prefix"), "line-reps")
    probe = ["head", "k1", "parity", "parity2"]
    tokens = reps.where(F.size("prefix") > 0).select("k1", "n", "parity", "parity2", "rare", "first", F.posexplode("prefix").alias("at", "token")).withColumn("head", packed(F.col("token"), F.col("n"), F.col("at")))
    # rare tokens: all pairs of a token's lines; at most FREQUENT lines have such a token
    rare = tokens.where(F.col("at") < F.col("rare"))
    x, y = rare.select(*probe).alias("x"), rare.where(F.col("at") < rule.index_length(F.col("n"))).select(*probe).alias("y")
    larger = (size("x") > size("y")) | ((size("x") == size("y")) & (F.col("x.k1") > F.col("y.k1")))
    pairs = x.join(y, (token("x") == token("y")) & larger & _may_match(rule, "x", "y"))
    pairs = saved(pairs.select(F.col("x.k1").alias("a"), F.col("y.k1").alias("b")).distinct(), "line-pairs")
    # frequent tokens: each line against the first line of the token, then only lines not known as copies yet
    often = saved(tokens.where(F.col("at") >= F.col("rare")).select(*probe, "token", "first"), "line-often")
    heads = often.groupBy("token").agg(F.min(F.struct("first", *probe)).alias("h")).select(*(f"h.{c}" for c in probe))
    heads = saved(heads, "line-heads")
    match = (token("x") == token("y")) & (F.col("x.k1") != F.col("y.k1")) & _may_match(rule, "x", "y")
    led = often.alias("x").join(heads.alias("y"), match).select(F.col("x.k1").alias("a"), F.col("y.k1").alias("b"))
    pairs = pairs.unionByName(saved(led.distinct(), "line-led"))
    often = often.select(*probe)
    open_lines = saved(often.alias("x").join(often.alias("y"), match, "left_semi"), "line-open")  # lines with any candidate
    # token sets of those lines only, from the texts that have them first
    wanted = saved(pairs.select(F.col("a").alias("k1")).union(pairs.select("b")).union(open_lines.select("k1")).distinct(), "line-wanted")
    text = F.xxhash64("doc_id", "version")
    texts = reps.select("k1", "first.doc_id", "first.version").join(wanted, "k1", "left_semi").select(text)
    marks = marked(texts), marked(wanted)
    sets = docs.withColumn("key", text).mapInArrow(_sets(rule, *marks), SETS)
    sets = sets.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "version", "line", "tokens")).alias("r"))
    sets = saved(sets.select("k1", "k2", F.struct("r.doc_id", "r.version", "r.line").alias("first"), "r.tokens"), "line-sets")
    for m in marks:
        m.destroy()
    known = saved(_verified(pairs, sets, rule), "line-known")
    whole = sets.select("k1", "first", "tokens")
    left = open_lines.join(known.select("k1").distinct(), "k1", "left_anti")
    x, y = saved(left.join(whole, "k1"), "line-left").alias("x"), saved(open_lines.join(whole, "k1"), "line-whole").alias("y")
    # a semi join stops at a line's first match and gives no pairs
    same = rule.similar(F.col("x.tokens"), F.col("y.tokens")) & (F.col("y.first") < F.col("x.first"))
    more = x.join(y, match & same, "left_semi").select("k1").distinct()
    late = saved(known.unionByName(sets.select("k1", "k2").join(more, "k1", "left_semi")).distinct(), "line-late")
    kept = reps.select("k1", "k2", "first").join(late, ["k1", "k2"], "left_anti").select("first.*", F.lit(True).alias("kept"))
    every = lines.select("doc_id", "version", "line", F.lit(False).alias("kept")).unionByName(kept)
    listed = every.groupBy("doc_id", "version").agg(F.collect_set(F.when(~F.col("kept"), F.col("line"))).alias("all"), F.collect_set(F.when(F.col("kept"), F.col("line"))).alias("good"))
    return listed.select("doc_id", "version", F.size("all").alias("lines"), F.array_sort(F.array_except("all", "good")).alias("removed"))


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Per document: how many of its lines were compared, and which are removed. Texts of one doc_id make a row each."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = duplicate_lines(documents, EVERY)
    keys = documents.select("doc_id", F.xxhash64("text").alias("version"))
    of = found.select(F.col("doc_id").alias("of"), F.col("version").alias("of_version"), "lines", "removed")
    rows = keys.join(of, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("version") == F.col("of_version")), "left")
    none = F.array().cast("array<int>")
    return rows.select("doc_id", F.coalesce("lines", F.lit(0)).alias("n_lines"), F.coalesce(F.size("removed"), F.lit(0)).alias("n_removed"), F.coalesce("removed", none).alias("removed"))


def without_lines(text: Column, removed: Column) -> Column:
    """text without the lines at these numbers."""
    lines = F.split(text, "\n")
    return F.array_join(F.filter(lines, lambda _, i: ~F.array_contains(removed, i)), "\n")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with copied lines taken out of their texts; a document none of whose lines is left goes.

    Null and empty texts, and texts without copied lines, stay as they are.
    """
    found = saved(duplicate_lines(docs, EVERY).where(F.size("removed") > 0), "line-removed")
    # the documents' columns are one struct, so that none of them can have a name of the join's own
    whole = docs.select(F.struct(*docs.columns).alias("doc"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("hash"))
    joined = whole.join(found, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("version")), "left")
    text = F.when(F.col("removed").isNull(), F.col("doc.text")).otherwise(without_lines(F.col("doc.text"), F.col("removed")))
    gone = F.col("removed").isNotNull() & ~text.rlike(r"\S")
    return joined.where(~gone).select(*(text.alias(c) if c == "text" else F.col("doc")[c].alias(c) for c in docs.columns))
