"""Groups of like names against the order-fixed greedy rule."""

import hashlib
import random

import pytest

from crawlsift.operators import diff


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def alike(a, b):
    return 1 - distance(a, b) / max(len(a), len(b), 1)


def greedy(rows):
    digest = lambda n: hashlib.md5(n.encode()).hexdigest()
    out = set()
    for block in {b for b, _, _ in rows}:
        leaders = []
        best = lambda n, some: max(((alike(n, x), digest(x), x) for x in some if alike(n, x) >= 0.7), default=None)
        for n in sorted({n for b, a, n in rows if b == block and a == "variant" and n is not None}, key=digest):
            found = best(n, leaders)
            if found is None:
                leaders.append(n)
                found = (1.0, "", n)
            out.add((block, "variant", n, found[2]))
        for n in {n for b, a, n in rows if b == block and a == "control" and n is not None}:
            found = best(n, leaders)
            if found:
                out.add((block, "control", n, found[2]))
    return out


def run(spark, rows):
    return {tuple(r)[:4] for r in diff.leader_groups(spark.createDataFrame(rows, "block string, arm string, name string"), ["block"], "name").collect()}


def test_groups_are_those_of_the_greedy_rule(spark):
    rng = random.Random(5)
    rows = [("d", rng.choice(("control", "variant")), f"cdn{rng.randrange(300)}") for _ in range(150)]  # a crowd of like names
    rows += [("e", rng.choice(("control", "variant")), "".join(rng.choice("abc") for _ in range(rng.randrange(1, 9)))) for _ in range(120)]
    rows += [("d", "variant", None), ("d", "variant", "cdn1"), ("d", "variant", "cdn1"), ("only", "control", "x"), ("d", "variant", "")]
    got = run(spark, rows)
    assert got == greedy(rows)
    assert len({(b, x) for b, _, _, x in got}) > 10


def test_no_names_and_names_too_far_apart(spark):
    assert run(spark, []) == set() and run(spark, [("d", "control", "a")]) == set()
    with pytest.raises(ValueError):
        diff.leader_groups(spark.createDataFrame([("d", "variant", "a")], "block string, arm string, name string"), ["block"], "name", least=0.3)
