"""Scalers against numpy: fits on labelled rows, saved and loaded, applied to others."""

import math
import random

import numpy as np
from pyspark.ml import Pipeline, PipelineModel

from crawlsift.operators import scaling

rng = random.Random(2)
ROWS = [(i, round(rng.lognormvariate(1, 1), 3), float(rng.choice((0, 0, 0, 1, 2, 5))), float(i % 2), 7.0, None if i % 9 == 0 else -float(i % 40)) for i in range(400)]
KIND = "id int, a double, `b.c` double, var_1_dom_as_path double, same double, `some` double"
NAMES = ["a", "b.c", "var_1_dom_as_path", "same", "some"]


def values(k):
    return np.array([r[k] for r in ROWS if r[k] is not None])


def share(x, v, steps):
    t = len(v) - 1
    v = np.sort(v)
    q = np.array([v[i * t // steps] + (v[-(-i * t // steps)] - v[i * t // steps]) * (i * t % steps / steps) for i in range(steps + 1)])
    ref = np.linspace(0, 1, steps + 1)
    mid = (np.interp(x, q, ref) - np.interp(-x, -q[::-1], -ref[::-1])) / 2
    return 0.0 if x <= q[0] else 1.0 if x >= q[-1] else mid


def likelihood(v, p):
    y = np.where(v >= 0, np.log1p(np.abs(v)) if abs(p) < 1e-12 else ((np.abs(v) + 1) ** p - 1) / p, -np.log1p(np.abs(v)) if abs(p - 2) < 1e-12 else -((np.abs(v) + 1) ** (2 - p) - 1) / (2 - p))
    return -len(v) / 2 * math.log(y.var()) + (p - 1) * (np.sign(v) * np.log1p(np.abs(v))).sum(), y


def test_five_scalers_saved_and_loaded(spark, tmp_path):
    rows = spark.createDataFrame(ROWS, KIND)
    stages = {how: scaling.Scaler(how=how, columns=NAMES, steps=50) for how in scaling.HOW}
    for how, stage in stages.items():
        path = str(tmp_path / how)
        Pipeline(stages=[stage]).fit(rows).write().overwrite().save(path)
        out = {r.id: r for r in PipelineModel.load(path).transform(rows).collect()}
        for k, name in enumerate(NAMES, 1):
            got = np.array([out[r[0]][name] for r in ROWS if r[k] is not None])
            v = values(k)
            if name == "var_1_dom_as_path":
                assert (got == v).all()  # flags stay
                continue
            if how == "powertrans":
                if name == "same":
                    assert np.allclose(got, 0)
                    continue
                p = scaling.fitted_powers(scaling._long(rows, [name]))[name][0]
                assert all(likelihood(v, p)[0] >= likelihood(v, p + d)[0] - 1e-6 for d in (-1, -0.1, -0.01, 0.01, 0.1, 1))
                y = likelihood(v, p)[1]
                wanted = (y - y.mean()) / y.std()
            elif how == "quantile":
                wanted = np.array([share(x, v, 50) for x in v])
            else:
                q = np.quantile(v, (0.25, 0.5, 0.75))
                m, d = {"standardscale": (v.mean(), v.std()), "minmax": (v.min(), np.ptp(v)), "robust": (q[1], q[2] - q[0])}[how]
                wanted = (v - m) / (d or 1.0)
            assert np.allclose(got, wanted, atol=1e-6), (how, name)
        assert all(out[r[0]]["some"] is None for r in ROWS if r[5] is None)


def test_fitted_on_labelled_applied_to_others_and_empty(spark, tmp_path):
    rows = spark.createDataFrame(ROWS, KIND)
    out = scaling.scaled_training(rows.where("id < 200"), rows.where("id >= 200"), ["same", "var_1_dom_as_path"], str(tmp_path))
    assert set(out) == set(scaling.HOW) and all(u.count() == 200 for _, u in out.values())
    assert scaling.ScalerModel.load(f"{tmp_path}/scaler_robust").getOrDefault("how") == "robust"
    none = scaling.scaled_training(rows.limit(0), rows, ["a"])
    assert all(u.where("id = 1").first().a == ROWS[1][1] for _, u in none.values())
