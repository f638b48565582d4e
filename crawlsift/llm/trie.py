"""Prefix trie of conversations: a Cartesian tree over the common prefixes of neighbours in sorted order."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlsift.llm.storage import drop, saved

#: Bytes of a turn's digest, bytes of digests that one block of sorted conversations holds, and characters of a row of ids.
WIDTH, BLOCK_BYTES, ENDS_CHARS = 16, 16 << 20, 1 << 18
#: Turns of the first conversation of a hundred that others may begin with are fewer than this.
HEADS = 6


def digest(role: Column, text: Column) -> Column:
    """Hexadecimal digits that stand for a turn; a null is empty."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(c, key, points): of each conversation, as rebuilt, its turns' digests in a row and their texts' code points.

    Turns are ordered by number, null first, those of one number by digest. Rows without a conv_id take no part.
    """
    turn = F.struct("turn", digest(F.col("role"), F.col("text")).alias("hex"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("points"))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("c"), turn.alias("t"))
    own = rows.groupBy("c").agg(F.array_sort(F.collect_list("t")).alias("own"))
    head = own.where(F.col("c") % 100 == 0).select(F.col("c").alias("base"), F.slice("own", 1, HEADS - 1).alias("head"))
    met = own.join(head, F.col("c") - F.col("c") % 100 == F.col("base"), "left")
    h = (F.crc32(F.col("c").cast("string").cast("binary")) % HEADS).cast("int")
    turns = F.concat(F.slice(F.coalesce("head", F.slice("own", 1, 0)), F.lit(1), h), F.slice("own", h + 1, F.greatest(F.size("own") - h, F.lit(0))))
    return met.select("c", turns.alias("t")).select("c", F.unhex(F.array_join(F.col("t.hex"), "")).alias("key"), F.col("t.points").alias("points"))


NODES = (
    "kind int, block int, depth long, left boolean, right boolean, low long, parent_low long, parent_left boolean, n long, children long, "
    "leaves long, saved long, points long, sha string, chunk long, ends string, first binary, last binary, cover long, last_length long"
)
INNER, EDGE, ENDS, BLOCK = range(4)


def _common(a: bytes, b: bytes) -> int:
    """Turns that two keys begin with in common."""
    m = min(len(a), len(b))
    if a[:m] == b[:m]:
        return m // WIDTH
    x, y = (np.frombuffer(k, np.uint64, m // 8).reshape(-1, 2) for k in (a, b))
    return int((x != y).any(axis=1).argmax())


def _block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The trie of one block of sorted conversations.

    A node belongs to the first conversation of its interval, which ends before the next value of the common prefixes
    that is smaller than its depth: found with a stack. The block counts as if nothing lay before and behind it; nodes
    that touch its ends are edges, whose parts are put together later.
    """
    ids, keys, points = [], [], []
    for batch in batches:
        ids += batch.column(0).to_pylist()
        keys += batch.column(1).to_pylist()
        points += batch.column(2).to_pylist()
    n = len(ids)
    if not n:
        return
    block = TaskContext.get().partitionId()
    length = [len(k) // WIDTH for k in keys]
    common = [-1, *map(_common, keys, keys[1:])]
    owner, depth, parent, end, stack = [], [], [], [], []
    for i in range(n):
        for v in stack[common[i] + 1 :]:
            end[v] = i
        del stack[common[i] + 1 :]
        above = stack[-1] if stack else -1
        new = range(len(owner), len(owner) + length[i] - common[i])
        owner += [i] * len(new)
        depth += range(common[i] + 1, length[i] + 1)
        parent += [above, *new[:-1]] if new else []
        end += [n] * len(new)
        stack += new
    nodes = len(owner)
    # leaves and ends of conversations; the last of equal ones is a leaf if the next one does not go on from it
    top = [0] * n  # the node in which a conversation ends
    last = -1
    for v in range(nodes):
        if depth[v] == length[owner[v]]:
            top[owner[v]] = v
    for i in range(n):
        if length[i] > common[i] or i == 0:
            last = top[i]
        top[i] = last
    leaves, children, low, saved_ = [0] * nodes, [0] * nodes, [None] * nodes, [0] * nodes
    ends: dict[int, list[int]] = {}
    for i in range(n):
        v = top[i]
        leaves[v] += i == n - 1 or common[i + 1] < length[i]
        low[v] = ids[i] if low[v] is None else min(low[v], ids[i])
        ends.setdefault(v, []).append(ids[i])
    left, right = [o == 0 for o in owner], [e == n for e in end]
    own = [points[owner[v]][depth[v] - 1] if depth[v] else 0 for v in range(nodes)]
    for v in reversed(range(nodes)):
        if not (left[v] or right[v]):
            saved_[v] += (end[v] - owner[v] - 1) * own[v]
        if (u := parent[v]) >= 0:
            children[u] += 1
            leaves[u] += leaves[v]
            saved_[u] += saved_[v]
            low[u] = low[v] if low[u] is None else min(low[u], low[v])
    rows = []

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)
        rows.clear()
        return out

    for v in range(nodes):
        u, edge = parent[v], left[v] or right[v]
        row = {"kind": EDGE if edge else INNER, "block": block, "depth": depth[v], "left": left[v], "right": right[v], "low": low[v], "n": end[v] - owner[v], "children": children[v], "leaves": leaves[v], "saved": saved_[v], "points": own[v]}
        if u >= 0:
            row |= {"parent_left": left[u]} | ({} if left[u] or right[u] else {"parent_low": low[u]})
        mine = ends.get(v, [])
        if not edge:
            sha = hashlib.sha256()
            for k in range(0, len(mine), 10_000):
                sha.update((("," if k else "") + ",".join(map(str, mine[k : k + 10_000]))).encode())
            row["sha"] = sha.hexdigest()
        else:
            step = ENDS_CHARS // 20
            rows += [{"kind": ENDS, "block": block, "depth": depth[v], "left": left[v], "chunk": k, "ends": ",".join(map(str, mine[k : k + step]))} for k in range(0, len(mine), step)]
        rows.append(row)
        if len(rows) >= 10_000:
            yield flush()
    rows.append({"kind": BLOCK, "block": block, "first": keys[0], "last": keys[-1], "cover": min([length[0], *common[1:]]), "last_length": length[-1]})
    yield flush()


_TYPES = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}
_SCHEMA = pa.schema([(c.split()[0], _TYPES[c.split()[1]]) for c in NODES.split(", ")])


def _boundaries(table: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each block with rows, in order: number, turns in common with the block before (-1 for the first), depth to which
    one node covers it whole, length of its last conversation. Four numbers a block reach the driver, no keys."""
    spark = table.sparkSession
    blocks = table.where(F.col("kind") == BLOCK).select("block", "first", "last", "cover", "last_length")
    known = sorted(blocks.select("block", "cover", "last_length").collect())
    number = [r.block for r in known]
    common = {}
    if len(number) > 1:
        pairs = spark.createDataFrame(list(zip(number[1:], number)), "block int, before int")
        met = blocks.select("block", "first").join(pairs, "block").join(blocks.select(F.col("block").alias("before"), "last"), "before")

        def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = list(map(_common, batch.column(1).to_pylist(), batch.column(2).to_pylist()))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["block", "common"])

        common = {r.block: r.common for r in met.select("block", "first", "last").mapInArrow(compared, "block int, common long").collect()}
    return tuple(np.array(x, np.int64) for x in (number, [common.get(b, -1) for b in number], [r.cover for r in known], [r.last_length for r in known]))


HOMES = "block int, depth long, left boolean, home int, home_left boolean, goes_on boolean, child_goes_on boolean, leaf_goes_on boolean"


def _homes(shared) -> Callable:
    """Where the node that an edge is a part of begins: all nearest smaller values among the blocks' minima."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, common, cover, last_length = shared.value
        least = [np.minimum(cover, common)]  # least[k][i]: the minimum of 2^k blocks that end with block i
        while (1 << len(least)) <= len(number):
            x, half = least[-1], 1 << (len(least) - 1)
            least.append(np.append(x[:half], np.minimum(x[half:], x[:-half])))
        for batch in batches:
            out = []
            for b, d, left, right in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = int(np.searchsorted(number, b))
                goes_on = left and d <= common[at]
                home, home_left = at, left
                if goes_on:
                    home = at - 1
                    for k in reversed(range(len(least))):
                        # 2^k blocks before that the node fills, each joined to the one before
                        if home - (1 << k) + 1 >= 0 and least[k][home] >= d:
                            home -= 1 << k
                    home_left = bool(d <= cover[home])
                leaf = right and at + 1 < len(number) and common[at + 1] == last_length[at]
                out.append((b, d, left, int(number[home]), home_left, goes_on, left and d + 1 <= common[at], bool(leaf)))
            names = [c.split()[0] for c in HOMES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(x, _TYPES[c.split()[1]]) for x, c in zip(zip(*out, strict=True) if out else [[]] * len(names), HOMES.split(", "), strict=True)], names)

    return run


def _shas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's ids from rows in order: one digest is open at a time."""
    now, sha = None, hashlib.sha256()

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"home": pa.array([now[0]], pa.int32()), "depth": pa.array([now[1]], pa.int64()), "home_left": pa.array([now[2]]), "sha": [sha.hexdigest()]})

    for batch in batches:
        for home, depth, left, _, _, ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now != (home, depth, left):
                if now is not None:
                    yield row()
                now, sha = (home, depth, left), hashlib.sha256(ends.encode())
            else:
                sha.update(f",{ends}".encode())
    if now is not None:
        yield row()


RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie(conversations: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row a node of the prefix trie of all rebuilt conversations: conv_id (smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Conversations are sorted in ranges by their turns' digests and id, so that equal ones lie side by side, in several
    ranges if they are many. Each range builds its own Cartesian tree of common prefixes, with equal values merged and
    missing depths filled in. Nodes that touch a range's ends are put together by the ranges' minima; only four numbers a
    range reach the driver. A conversation's digests lie in one row, 16 bytes a turn; texts are not shuffled.

    Null roles and texts are empty; rows without a conv_id take no part; repeated rows are turns of their own; no rows
    give no nodes; other columns take no part.
    """
    spark = conversations.sparkSession
    convs = saved(rebuilt(conversations), "trie-convs")
    size = convs.agg(F.sum(F.length("key") + 8)).first()[0] or 0
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / block_bytes))
    table = saved(convs.repartitionByRange(blocks, "key", "c").sortWithinPartitions("key", "c").mapInArrow(_block, NODES), "trie-nodes")
    shared = spark.sparkContext.broadcast(_boundaries(table))
    edges = table.where(F.col("kind") == EDGE)
    place = ["block", "depth", "left"]
    homes = saved(edges.select(*place, "right").mapInArrow(_homes(shared), HOMES), "trie-homes")
    node = ["home", "depth", "home_left"]
    parts = edges.join(homes, place)
    whole = saved(
        parts.groupBy(*node).agg(
            F.min("low").alias("low"), F.sum("n").alias("n"), F.sum("saved").alias("saved"), F.max("points").alias("points"),
            F.sum(F.col("children") - F.col("child_goes_on").cast("long")).alias("children"), F.sum(F.col("leaves") - F.col("leaf_goes_on").cast("long")).alias("leaves"),
            F.max(F.when(~F.col("goes_on"), F.col("parent_left"))).alias("parent_left"),
        ),
        "trie-whole",
    )
    # a node counts for those above it where it begins: along the block's left edge, or its right one and what both share
    weighed = parts.select(*place, "right", *node[::2], "goes_on").join(whole.select(*node, ((F.col("n") - 1) * F.col("points")).alias("w")), node)
    weighed = weighed.withColumn("w", F.when(F.col("goes_on"), 0).otherwise(F.col("w")))
    below = F.sum("w").over(Window.partitionBy("block", "left").orderBy(F.col("depth").desc()))
    beside = F.sum(F.when(~F.col("left"), F.col("w")).otherwise(0)).over(Window.partitionBy("block"))
    gained = weighed.withColumn("w", below + F.when(F.col("left") & F.col("right"), beside).otherwise(0)).groupBy(*node).agg(F.sum("w").alias("gained"))
    ends = table.where(F.col("kind") == ENDS).select(*place, "chunk", "ends").join(homes, place).select(*node, "block", "chunk", "ends")
    ends = ends.repartition(*node).sortWithinPartitions(*node, "block", "chunk").mapInArrow(_shas, "home int, depth long, home_left boolean, sha string")
    nothing = hashlib.sha256(b"").hexdigest()
    outer = whole.join(gained, node).join(ends, node, "left")
    outer = outer.select(F.col("home").alias("block"), "depth", "low", F.lit(None).cast("long").alias("parent_low"), "parent_left", "n", "children", "leaves", (F.col("saved") + F.col("gained")).alias("saved"), F.coalesce("sha", F.lit(nothing)).alias("sha"))
    inner = table.where(F.col("kind") == INNER).select(*outer.columns)
    lows = homes.join(whole.select(*node, "low"), node).select(F.col("block"), (F.col("depth") + 1).alias("depth"), F.col("left").alias("parent_left"), F.col("low").alias("edge_low"))
    rows = inner.unionByName(outer).join(lows, ["block", "depth", "parent_left"], "left")
    out = rows.select(F.col("low"), "depth", F.coalesce("parent_low", "edge_low"), "n", "children", "leaves", "saved", "sha").toDF(*RESULT)
    out = saved(out, "trie-rows")
    drop(convs, table, homes, whole)
    return out


def op12_prefix_trie(spark, sf_dir: str) -> DataFrame:
    """Per node of the trie of conversations; see trie for nulls, ties and repeats."""
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))


OP12_SQL = """
WITH raw AS (
  SELECT conv_id AS c, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT c, list({'r': r, 't': t} ORDER BY turn NULLS FIRST, md5(concat(CAST(length(r) AS VARCHAR), ':', r, t))) AS turns FROM raw GROUP BY c
), h AS (
  SELECT c, turns, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(CAST(c AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST(c AS VARCHAR), i, 1)) AS BIGINT))),
    lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda x, k: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 6 AS h
  FROM own
), whole AS (
  SELECT a.c, list_concat(coalesce(b.turns[1:a.h], []), a.turns[a.h + 1:]) AS s FROM h a LEFT JOIN own b ON b.c = a.c - a.c % 100
), prefixes AS (
  SELECT c, d, s[1:d] AS p, len(s) AS n FROM (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM whole)
), nodes AS (
  SELECT d, p, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE n = d), '')) AS ends_sha256,
    (count(*) - 1) * CASE WHEN d = 0 THEN 0 ELSE length(p[d].t) END AS w
  FROM prefixes GROUP BY d, p
), kids AS (
  SELECT m.d, m.p, count(*) AS n_children FROM nodes m JOIN nodes k ON k.d = m.d + 1 AND k.p[1:m.d] = m.p GROUP BY m.d, m.p
), marked AS (
  SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM nodes n LEFT JOIN kids k ON k.d = n.d AND k.p = n.p
), below AS (
  SELECT u AS d, k.p[1:u] AS p, count(*) FILTER (WHERE k.n_children = 0) AS n_leaves, sum(k.w) AS saved
  FROM (SELECT *, unnest(range(0, d + 1)) AS u FROM marked) k GROUP BY u, k.p[1:u]
)
SELECT m.conv_id, CAST(m.d AS BIGINT) AS depth, a.conv_id AS parent_conv_id, m.n_convs, m.n_children, b.n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, m.ends_sha256
FROM marked m JOIN below b ON b.d = m.d AND b.p = m.p LEFT JOIN nodes a ON a.d = m.d - 1 AND a.p = m.p[1:m.d - 1]
"""
