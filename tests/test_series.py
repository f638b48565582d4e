"""Series operators against plain loops over random series."""

import random

import pytest

from crawlsift.operators import series

BINS = 40


def table(spark, seed):
    rng = random.Random(seed)
    rows = [(s, b, rng.choice([0, 0, 0, 0, 1, 2, 3]), rng.choice([0, 0, 0, 1]), rng.choice([0] * 12 + [1])) for s in range(30) for b in range(BINS)]
    return rows, spark.createDataFrame(rows, "s int, bin int, v int, k int, d int")


def by_series(rows):
    out = {}
    for s, *r in rows:
        out.setdefault(s, []).append(r)
    return {s: sorted(r) for s, r in out.items()}


def test_bin_edges(spark):
    times = [(t,) for t in (-5, 0, 1, 100, 101, 200, 24_900, 24_901, 30_000)]
    from pyspark.sql import functions as F

    got = [r[0] for r in spark.createDataFrame(times, "t long").select(series.bin_number(F.col("t"), F.lit(0), 100, 250)).collect()]
    assert got == [0, 0, 0, 0, 1, 1, 248, 249, 249]


def test_runs(spark):
    rows, frame = table(spark, 1)
    got = {r.s: (r.runs, r.mean_run) for r in series.run_stats(frame, ["s"], "v").collect()}
    for s, r in by_series(rows).items():
        sizes, size, zeros = [], 0, 0
        for _, v, _, _ in r:
            if v == 0:
                zeros += 1
                if zeros == 2 and size:
                    sizes.append(size)
                    size = 0
            else:
                zeros = 0
                size += v >= 2
        sizes += [size] * bool(size)
        assert got[s] == (len(sizes), pytest.approx(sum(sizes) / len(sizes) if sizes else 0.0))


def test_delays(spark):
    rows, frame = table(spark, 2)
    got = {r.s: (r.mean_delay, r.delays) for r in series.block_delays(frame, ["s"], "k", "v", start="d").collect()}
    for s, r in by_series(rows).items():
        first = next((b for b, _, _, d in r if d), 0)
        armed, delays = None, []
        for b, v, k, _ in r[first:]:
            if k:
                armed = b
            elif v >= 2 and armed is not None:
                delays.append(b - armed)
                armed = None
        assert got[s] == (pytest.approx(sum(delays) / len(delays) if delays else 0.0), len(delays))


def test_gaps_spikes_and_last(spark):
    rows, frame = table(spark, 3)
    gaps = {r.s: r.mean_gap for r in series.mean_gap(frame, ["s"], "v", 2).collect()}
    spikes = {r.s: r for r in series.spike_stats(frame, ["s"], ["v"]).collect()}
    after = {r.s: r.after_last for r in series.events_after_last(frame, ["s"], "k", ["v"]).collect()}
    for s, r in by_series(rows).items():
        at = [b for b, v, _, _ in r if v >= 2]
        assert gaps[s] == pytest.approx((at[-1] - at[0]) / (len(at) - 1) if len(at) > 1 else 0.0)
        assert (spikes[s].v_spikes, spikes[s].v_last) == (len(at), at[-1] if at else 0)
        last = max((b for b, _, k, _ in r if k), default=None)
        assert after[s] == (0 if last is None else sum(b >= last for b in at))
