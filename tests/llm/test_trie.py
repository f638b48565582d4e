"""The trie against one built from plain prefixes, with blocks of a few conversations."""

import hashlib
import random
import zlib

import pytest

from crawlsift.llm import trie


def plain(rows):
    """Brute force: {(depth, prefix): row}."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own.setdefault(c, []).append(((turn is not None, turn or 0), hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), (role, text)))
    turns = {c: tuple(t[2] for t in sorted(x)) for c, x in own.items()}
    whole = {c: turns.get(c - c % 100, ())[: zlib.crc32(str(c).encode()) % 6] + t[zlib.crc32(str(c).encode()) % 6 :] for c, t in turns.items()}
    nodes = {}
    for c, t in whole.items():
        for d in range(len(t) + 1):
            nodes.setdefault(t[:d], []).append(c)
    out = []
    for p, cs in nodes.items():
        sub = [(q, m) for q, m in nodes.items() if q[: len(p)] == p]
        kids = lambda q: sum(len(x) == len(q) + 1 and x[: len(q)] == q for x in nodes)
        ends = ",".join(map(str, sorted(c for c in cs if len(whole[c]) == len(p))))
        out.append((min(cs), len(p), min(nodes[p[:-1]]) if p else None, len(cs), kids(p), sum(kids(q) == 0 for q, _ in sub), sum((len(m) - 1) * len(q[-1][1]) for q, m in sub if q), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def made(seed, convs, words, spread):
    rng = random.Random(seed)
    rows = []
    for _ in range(convs):
        c = rng.randrange(spread)
        for turn in range(rng.randrange(1, 9)):
            rows.append((c, turn if rng.random() < 0.9 else None, rng.choice(["user", None, ""]), rng.choice(words)))
    return rows


CASES = [made(1, 60, ["a", "bé", None, ""], 400), made(2, 150, ["same"], 90), made(3, 120, ["x", "yy"], 10_000), [(c, t, "u", "one") for c in range(0, 600, 2) for t in range(3)], [(100, 0, "u", "x"), (100, 0, "u", "x"), (None, 0, "u", "x"), (7, None, None, None)]]


@pytest.mark.parametrize("case", range(len(CASES)))
@pytest.mark.parametrize("block", [40, 1 << 20])
def test_against_plain(spark, case, block):
    docs = spark.createDataFrame([(*r, 9) for r in CASES[case]], "conv_id long, turn long, role string, text string, depth int")
    got = sorted((tuple(r) for r in trie.trie(docs, block_bytes=block).collect()), key=str)
    assert got == plain(CASES[case])


def test_no_rows(spark):
    assert trie.trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
