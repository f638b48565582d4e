"""Initiators that are part of another request's URL, against all pairs."""

import random
from collections import Counter

import pytest

from crawlsift.operators import diff

SCHEMA = "site int, url string, initiator string, _key int"


def brute(rows):
    return [r for r in rows if r[0] is not None and r[1] is not None and r[2] and any(o[0] == r[0] and o[1] is not None and o[1] != r[1] and r[2] in o[1] for o in rows)]


@pytest.mark.parametrize("seed,shortest,longest", [(1, 1, 30), (2, 15, 40), (3, 1, 3), (4, 14, 16)])
def test_initiated_against_all_pairs(spark, seed, shortest, longest):
    rng = random.Random(seed)
    pieces = ["a", "b", "ads", "cdn", ".", "/", "/js/", "example", ".com", "é", "𝒳", "aaaa"]
    urls = ["http://" + "".join(rng.choices(pieces, k=rng.randint(1, 14))) for _ in range(150)]
    rows = []
    for i in range(200):
        u = rng.choice(urls)
        at = rng.randrange(len(u))
        part = u[at : at + rng.randint(shortest, longest)]
        if rng.random() < 0.3:
            part = part[: len(part) // 2] + "q" + part[len(part) // 2 :]
        rows.append((rng.randint(1, 4), rng.choice(urls), part, i))
    rows += rows[:6] + [(None, urls[0], "a", 1), (1, None, "a", 1), (1, urls[0], None, 1), (1, urls[0], "", 1), (9, "http://aaaa/", "aaaa", 1), (8, "http://" + "ab" * 20000, "ab" * 12, 1), (8, "x", "ab" * 12, 2)]
    got = diff.initiated(spark.createDataFrame(rows, SCHEMA), ["site"], "url", "initiator")
    assert got.columns == ["site", "url", "initiator", "_key"]
    assert Counter(map(tuple, got.collect())) == Counter(brute(rows)) and len(brute(rows)) > 20


def test_initiated_of_an_empty_table(spark):
    assert diff.initiated(spark.createDataFrame([], SCHEMA), ["site"], "url", "initiator").count() == 0
