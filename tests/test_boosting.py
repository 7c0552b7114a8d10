"""Monotone trees and additive models against brute force and against pyspark.ml."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from roadlark.operators import boosting, models
from roadlark.operators.evaluation import auc


def data(spark, n, seed=1, parts=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, c = rng.random(), rng.randint(0, 5), rng.gauss(0, 1)
        p = 1 / (1 + math.exp(-(3 * a - 0.4 * b + math.sin(2 * c) - 0.5)))
        rows.append((i, a, None if rng.random() < 0.05 else float(b), c, int(rng.random() < p)))
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y int").repartition(parts)


def rounded(x):
    return np.round(x * boosting.SCALE) / boosting.SCALE


def tree_by_force(bins, y, score, signs, depth, penalty, least_rows):
    """A value for each row, by trying every split of every node."""
    p = 1 / (1 + np.exp(-score))
    g, h = rounded(p - y), rounded(p * (1 - p))
    out = np.zeros(len(y))

    def grow(rows, lo, hi, left, value):
        out[rows] = value
        if not left:
            return
        best = None
        for f in range(bins.shape[1]):
            for at in sorted(set(bins[rows, f]))[:-1]:
                sides = [rows[bins[rows, f] <= at], rows[bins[rows, f] > at]]
                if min(map(len, sides)) < least_rows:
                    continue
                fit = lambda r: min(hi, max(lo, -g[r].sum() / (h[r].sum() + penalty)))
                loss = lambda r: g[r].sum() * fit(r) + (h[r].sum() + penalty) * fit(r) ** 2 / 2
                a, b = fit(sides[0]), fit(sides[1])
                gain = loss(rows) - loss(sides[0]) - loss(sides[1])
                if signs[f] * (b - a) >= 0 and gain > 1e-9 and (best is None or gain > best[0] + 1e-12):
                    best = (gain, f, sides, a, b)
        if best:
            _, f, sides, a, b = best
            m = (a + b) / 2
            bounds = {1: ((lo, m), (m, hi)), -1: ((m, hi), (lo, m)), 0: ((lo, hi), (lo, hi))}[signs[f]]
            for r, (x, z), v in zip(sides, bounds, (a, b)):
                grow(r, x, z, left - 1, v)

    grow(np.arange(len(y)), -math.inf, math.inf, depth, 0.0)
    return out


def test_trees_equal_brute_force(spark):
    df = data(spark, 200)
    signs = {"a": 1, "b": -1}
    model = boosting.fit_monotone(df, ["a", "b", "c"], "y", signs, rounds=3, depth=3, rate=0.5, least_rows=8, bins=16)
    rows = sorted(df.withColumn("bins", boosting.binned(model.features, model.edges)).collect())
    bins, y = np.array([r.bins for r in rows]), np.array([r.y for r in rows], float)
    score = np.full(len(y), model.intercept)
    assert model.intercept == pytest.approx(math.log(y.mean() / (1 - y.mean())))
    for tree in model.trees:
        want = tree_by_force(bins, y, score, [1, -1, 0], 3, 1.0, 8)
        assert tree.values(bins) == pytest.approx(want)
        score = score + 0.5 * want
    got = [r.p for r in model.transform(df).orderBy("id").collect()]
    assert len(model.trees) == 3 and got == pytest.approx((1 / (1 + np.exp(-score))).tolist())
    assert all(r.bins[1] == 0 for r in rows if r.b is None) and any(r.b is None for r in rows)


def test_probabilities_never_go_against_their_signs(spark):
    df = data(spark, 1500)
    free = boosting.fit_monotone(df, ["a", "b", "c"], "y", rounds=5, rate=0.5, bins=16)
    held = boosting.fit_monotone(df, ["a", "b", "c"], "y", {"a": 1, "c": 1}, rounds=5, rate=0.5, bins=16)
    some = df.limit(40)
    assert boosting.falls(free, some, "c", 1) > 0
    assert boosting.falls(held, some, "c", 1) == boosting.falls(held, some, "a", 1) == 0


def test_trees_rank_as_well_as_other_boosting(spark):
    train, test = data(spark, 3000), data(spark, 3000, seed=2)
    own = boosting.fit_monotone(train, ["a", "b", "c"], "y", {"a": 1}, rounds=12, rate=0.3, key="id", subsample=0.8, colsample=0.7)
    filled = lambda x: models.to_vector(x.na.fill(2.5), ["a", "b", "c"])
    other = GBTClassifier(labelCol="y", maxIter=12, maxDepth=3, seed=1).fit(filled(train)).transform(filled(test)).withColumn("p", vector_to_array("probability")[1])
    ours, theirs = (auc(x, "p", "y").first().auc for x in (own.transform(test), other))
    assert ours > theirs - 0.01 and ours > 0.7


def test_trees_of_odd_tables(spark):
    df = spark.createDataFrame([(1.0, None, 1), (1.0, None, 0), (1.0, None, None)] * 20, "a double, b double, y int")
    model = boosting.fit_monotone(df, ["a", "b"], "y")
    assert not model.trees and {round(r.p, 9) for r in model.transform(df).collect()} == {0.5}
    assert all(0.9 < r.p < 1 for r in boosting.fit_monotone(df.filter("y = 1"), ["a"], "y").transform(df).collect())
    with pytest.raises(ValueError):
        boosting.fit_monotone(df.filter("false"), ["a"], "y")
    with pytest.raises(ValueError):
        boosting.fit_monotone(df, ["a"], "y", subsample=0.5)


# ---- additive models


def additive_by_force(bins, y, sizes, start, rounds, sweeps, rate, leaves, penalty, least_rows):
    """The same cycles with the residual of every row, in place of sums."""
    intercept, shapes = start, [np.zeros(n) for n in sizes]
    for _ in range(rounds):
        score = intercept + sum(s[bins[:, i]] for i, s in enumerate(shapes))
        p = 1 / (1 + np.exp(-score))
        residual, weight = rounded(y - p), rounded(p * (1 - p))
        by = lambda i, x: np.bincount(bins[:, i], x, sizes[i])
        for _ in range(sweeps):
            shift = rate * residual.sum() / (weight.sum() + penalty)
            intercept, residual = intercept + shift, residual - weight * shift
            for i in range(len(sizes)):
                step = rate * boosting.stairs(by(i, residual), by(i, weight), by(i, np.ones(len(y))), leaves, penalty, least_rows)
                shapes[i] = shapes[i] + step
                residual = residual - weight * step[bins[:, i]]
    return intercept + sum(s[bins[:, i]] for i, s in enumerate(shapes))


def test_additive_model_equals_brute_force(spark):
    df = data(spark, 300)
    model = boosting.fit_additive(df, ["a", "b", "c"], "y", rounds=3, sweeps=4, bins=8, least_rows=10)
    rows = df.withColumn("bins", boosting.binned(model.features, model.edges)).orderBy("id").collect()
    bins, y = np.array([r.bins for r in rows]), np.array([r.y for r in rows], float)
    want = additive_by_force(bins, y, [len(e) + 1 for e in model.edges], math.log(y.mean() / (1 - y.mean())), 3, 4, 0.2, 3, 1e-3, 10)
    got = model.transform(df).orderBy("id").collect()
    assert [math.log(r.p / (1 - r.p)) for r in got] == pytest.approx(want.tolist(), abs=1e-9)
    assert [model.intercept + sum(r.p_terms) for r in got] == pytest.approx(want.tolist(), abs=1e-9)
    table = {(r.term, r.bin): r.value for r in model.table(spark).collect()}
    assert all(table["intercept", None] + sum(table[f, b] for f, b in zip("abc", r.bins)) == pytest.approx(w, abs=1e-9) for r, w in zip(rows, want))
    assert all(abs(sum(s[b] for b in bins[:, i])) < 1e-9 * len(y) for i, s in enumerate(model.shapes))


def test_one_feature_comes_to_the_odds_of_its_values(spark):
    df = spark.createDataFrame([(float(k), int(i < 10 * k + 10)) for k in range(4) for i in range(50)], "x double, y int")
    model = boosting.fit_additive(df, ["x"], "y", rounds=10, sweeps=40, leaves=4, penalty=0.0)
    for r in model.transform(df).groupBy("x").agg(F.avg("p").alias("p"), F.avg("y").alias("y")).collect():
        assert r.p == pytest.approx(r.y, abs=1e-4)


def test_a_pair_that_only_counts_together(spark):
    rng = random.Random(5)
    rows = [(a := rng.random(), b := rng.random(), rng.random(), int(((a > 0.5) != (b > 0.5)) ^ (rng.random() < 0.1))) for _ in range(1500)]
    df = spark.createDataFrame(rows, "a double, b double, c double, y int")
    plain, paired = (boosting.fit_additive(df, ["a", "b", "c"], "y", rounds=1, bins=10, pairs=k, pair_rounds=3) for k in (0, 1))
    assert list(paired.pairs) == [(0, 1)]
    found = [auc(m.transform(df), "p", "y").first().auc for m in (plain, paired)]
    assert found[0] < 0.65 and found[1] > 0.88
    r = paired.transform(df).first()
    assert math.log(r.p / (1 - r.p)) == pytest.approx(paired.intercept + sum(r.p_terms)) and len(r.p_terms) == 4


def test_stairs_and_quadrants():
    rng = np.random.default_rng(1)
    r, w, n = rng.normal(size=9), rng.random(9) + 0.1, rng.integers(1, 9, 9)
    best = max(((a, b) for a in range(1, 9) for b in range(a, 9)), key=lambda x: sum(r[i:j].sum() ** 2 / (w[i:j].sum() + 0.1) for i, j in ((0, x[0]), (x[0], x[1]), (x[1], 9)) if j > i))
    two = boosting.stairs(r, w, n, 2, 0.1, 1)
    assert len(set(two.tolist())) == 2 and best
    assert boosting.stairs(r, w, n, 3, 0.1, 10**6) == pytest.approx(np.full(9, r.sum() / (w.sum() + 0.1)))
    t = np.zeros((4, 4))
    t[2:, :3] = 1
    gain, values = boosting.quadrants(t, np.ones((4, 4)), np.ones((4, 4)), 0.0, 1)
    assert gain > 0 and (values == t).all()
