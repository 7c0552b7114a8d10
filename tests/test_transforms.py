"""Quantile-normal transforms, pairwise Spearman correlation and blended residuals."""

from __future__ import annotations

import math
import random
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from roadlark.operators import cleaning, models

N = NormalDist()


def test_normal_functions(spark):
    ps = [1e-7, 1e-5, 0.001, 0.02, 0.03, 0.2, 0.5, 0.7, 0.97, 0.98, 0.9999, 1 - 1e-7]
    df = spark.createDataFrame([(p,) for p in ps], "p double").withColumn("z", cleaning.normal_quantile(F.col("p"))).withColumn("back", cleaning.normal_cdf(F.col("z")))
    for r in df.collect():
        assert r.z == pytest.approx(N.inv_cdf(r.p), abs=1e-9) and r.back == pytest.approx(r.p, abs=1e-14)


def shares_by_force(train, x, most):
    """The rule of interpolation from both sides, by numpy."""
    held = np.array([v for v in train if v is not None and math.isfinite(v)])
    middle = np.median(held)
    filled = np.array([v if v is not None and math.isfinite(v) else middle for v in train])
    n = min(most, len(filled))
    ref = np.linspace(0, 1, n)
    q = np.percentile(filled, ref * 100)
    x = np.array([v if v is not None and math.isfinite(v) else middle for v in x])
    both = 0.5 * (np.interp(x, q, ref) - np.interp(-x, -q[::-1], -ref[::-1]))
    return np.where(x <= q[0], 0.0, np.where(x >= q[-1], 1.0, both)), np.clip(x, q[0], q[-1])


def test_quantile_normal_equals_its_rule_and_comes_back(spark):
    rng = random.Random(1)
    value = lambda: rng.choice([None, 0.0, 0.0, 1.0, float("nan"), rng.gauss(0, 3), rng.expovariate(0.2)])
    rows = [(i, i % 2, value(), value(), None) for i in range(500)]
    df = spark.createDataFrame(rows, "i int, fold int, a double, b double, none double").repartition(3)
    train = df.filter("fold = 0")
    fitted = cleaning.QuantileNormal.fit(train, {"g": ["a", "b"], "h": ["none"]}, most=40)
    other = cleaning.QuantileNormal.fit(train.union(df.filter("fold = 1").withColumn("a", F.lit(1e9)).limit(0)), {"g": ["a", "b"], "h": ["none"]}, most=40)
    assert fitted == other and fitted.weights == {"a": 2**-0.5, "b": 2**-0.5, "none": 1.0}
    out = fitted.transform(df.withColumns({f"{c}_share": fitted.share(c) for c in "ab"})).orderBy("i")
    back = [r for r in fitted.inverse(out).orderBy("i").collect()]
    for at, c in ((2, "a"), (3, "b")):
        want, values = shares_by_force([r[at] for r in rows if r[1] == 0], [r[at] for r in rows], 40)
        got = out.collect()
        assert [r[f"{c}_share"] for r in got] == pytest.approx(want.tolist(), abs=1e-12)
        assert [r[c] for r in got] == pytest.approx([N.inv_cdf(min(max(p, 1e-7), 1 - 1e-7)) / math.sqrt(2) for p in want], abs=1e-8)
        run = np.array([abs(v) < 1e-12 or abs(v - 1) < 1e-12 for v in values])  # inside a run of equal references every share comes back
        assert np.array([r[c] for r in back])[~run] == pytest.approx(values[~run], abs=1e-9)
        assert np.array([r[c] for r in back])[run] == pytest.approx(values[run], abs=1e-9)
    assert {r.none for r in out.collect()} == {0.0}


def test_spearman_of_common_rows(spark):
    rng = random.Random(2)
    rows = [tuple(rng.choice([None, float("nan"), float(rng.randint(0, 6)), rng.random()]) for _ in range(4)) + (1.0, None) for _ in range(200)]
    names = ["a", "b", "c", "d", "one", "none"]
    got = cleaning.correlations(spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).repartition(3), names)
    frame = pd.DataFrame([[v if v is not None else np.nan for v in r] for r in rows], columns=names)
    for i, b in enumerate(names):
        for a in names[:i]:
            both = frame[[a, b]].dropna()
            want = both[a].rank().corr(both[b].rank()) if len(both) > 1 else math.nan
            assert got[a, b] is None if math.isnan(want) else got[a, b] == pytest.approx(want, abs=1e-12)
    assert cleaning.correlations(spark.createDataFrame([], "a double, b double"), ["a", "b"]) == {("a", "b"): None}


def auc_by_force(p, y):
    pos, neg = [x for x, t in zip(p, y) if t], [x for x, t in zip(p, y) if not t]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


def test_residuals_are_blended_by_lambdas_of_the_other_folds(spark):
    rng = random.Random(3)
    rows = []
    for i in range(360):
        a, b, g = rng.gauss(0, 1), rng.gauss(0, 1), rng.choice(["low", "low", "high", "few" if i < 30 else "low"])
        p = 1 / (1 + math.exp(-(a + (2 * b if g == "low" else 0))))
        rows.append((i, i % 3, g, a, b, 1 / (1 + math.exp(-a)), int(rng.random() < p)))
    df = spark.createDataFrame(rows, "i int, fold int, g string, a double, b double, p double, y int")
    out, chosen = models.blend_residuals(df, ["b"], "y", "fold", [0, 1, 2], "g", ["low", "few"], {k: "p" for k in range(3)}, "p")
    lam = {(k, g): x for k, g, x in chosen}
    assert set(lam) == {(k, g) for k in range(3) for g in ("low", "few")} and all(lam[k, "few"] == 0 for k in range(3)) and all(lam[k, "low"] > 0 for k in range(3))
    got = {r.i: r for r in out.collect()}
    assert sorted(got) == list(range(360)) and out.columns == [*df.columns, "blended"]
    assert all(r.blended == r.p for r in got.values() if r.g != "low")
    logit = lambda p: math.log(p / (1 - p))
    train = df.filter("g = 'low' and fold <> 0").withColumn("z", F.log(F.col("p") / (1 - F.col("p"))))
    seen = models.out_of_fold(train, ["b", "z"], "y", "fold", [1, 2], name="r").collect()
    blend = lambda x: auc_by_force([round((1 - x) * logit(r.p) + x * logit(r.r), 12) for r in seen], [r.y for r in seen])
    scores = {x: blend(x) for x in (0.0, 0.1, 0.2, 0.3, 0.5)}
    assert lam[0, "low"] == max(sorted(scores), key=lambda x: (scores[x], -x))
    low = [r for r in got.values() if r.g == "low"]
    assert auc_by_force([r.blended for r in low], [r.y for r in low]) > auc_by_force([r.p for r in low], [r.y for r in low]) + 0.05


def test_a_fold_learns_from_its_training_rows_alone(spark):
    from roadlark.operators import fold_transform
    from roadlark.operators.fold_transform import FoldTransform
    from roadlark.sources.files import ContractError

    rng = random.Random(6)
    row = lambda i: (i, rng.choice([None, rng.gauss(0, 1)]), float(i), float(-i), 1.0, rng.choice(["a", "b", None]), "same", rng.choice([None, 0.2, 0.8]))
    train, test = [row(i) for i in range(120)], [row(i) for i in range(120, 150)] + [(200, None, None, None, None, "new", None, None)]
    schema = "i long, x double, u double, v double, one double, t string, s string, r double"
    fit = lambda rows: FoldTransform.fit(spark.createDataFrame(rows, schema).repartition(3), "i", ["x", "u", "v", "one"], ["t", "s"], ["x"], "t", "r", limit=0.999, least=20)
    one, again = fit(train), fit(train[::-1])
    assert one.fingerprint == again.fingerprint != fit(train[1:]).fingerprint and one.rows == 120
    assert {c: why for c, why, _ in one.dropped} == {"v": "spearman_rho", "one": "near_zero_variance", "s": "one_value"}
    assert one.categories == {"t": ["__MISSING__", "a", "b"]} and one.columns == ["x", "u", "x_cohort_z", "x_cohort_pct", "t=__MISSING__", "t=a", "t=b"]
    out = {r.i: tuple(r) for r in one.transform(spark.createDataFrame(test, schema), ["i"]).collect()}
    alone = {r.i: tuple(r) for k in (0, len(test) - 1) for r in one.transform(spark.createDataFrame(test[k : k + 1], schema), ["i"]).collect()}
    assert len(out) == 31 and all(out[k] == pytest.approx(v) for k, v in alone.items())
    assert out[200][-3:] == (0, 0, 0) and None not in out[200]
    held = [r for r in train if r[1] is not None]
    split = np.median([r[7] for r in train if r[7] is not None])
    cohort = lambda r: (r[5], None if r[7] is None else r[7] > split)
    for r in test[:-1]:
        if r[1] is not None:
            own = [q for q in train if cohort(q) == cohort(r)]
            pool = [q[1] for q in (own if len(own) >= 20 else train) if q[1] is not None]
            assert out[r[0]][3:5] == pytest.approx(((r[1] - np.mean(pool)) / np.std(pool), np.mean(np.array(pool) <= r[1])))
        else:
            assert out[r[0]][1] == pytest.approx(np.median([q[1] for q in held]))
    fold_transform.MAX_CATEGORIES, most = 1, fold_transform.MAX_CATEGORIES
    with pytest.raises(ContractError):
        fit(train)
    fold_transform.MAX_CATEGORIES = most


def test_curves_are_fitted_out_of_fold_and_never_fall(spark):
    rng = random.Random(9)
    rows = [(i, i % 3, x := rng.random(), None if i % 20 == 0 else rng.random(), min(1.0, x * x + rng.gauss(0, 0.05))) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, fold int, x double, z double, y double")
    curve = models.monotone_curves(df.filter("fold <> 0"), ["x", "z"], "y", 6)
    got = [r.c for r in df.orderBy("x").select(curve["x"].alias("c")).collect()]
    assert all(a <= b for a, b in zip(got, got[1:])) and 2 < len(set(got)) <= 6
    train = sorted((x, y) for _, f, x, _, y in rows if f != 0)
    edges = np.quantile([x for x, _ in train], [k / 6 for k in range(1, 6)])
    groups = [[y for x, y in train if sum(e <= x for e in edges) == k] for k in range(6)]
    means = [float(np.mean(g)) for g in groups]
    assert means == sorted(means) and sorted(set(got)) == pytest.approx(means)
    mean = float(np.mean([y for _, y in train]))
    assert {round(r.c, 9) for r in df.filter("z is null").select(curve["z"].alias("c")).collect()} == {round(mean, 9)}
    out = models.cross_fit(df, ["x", "z"], "y", "fold", [0, 1, 2], bins=6)
    f, g = models.fidelity(out, "distilled", "y").first(), models.fidelity(models.cross_fit(df.na.fill(0.5), ["x", "z"], "y", "fold", [0, 1, 2]), "distilled", "y").first()
    held = out.collect()
    assert f.penalty_mae == pytest.approx(100 * np.mean([abs(r.distilled - r.y) for r in held])) and f.distance < g.distance
