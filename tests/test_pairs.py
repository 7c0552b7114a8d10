"""Kendall's correlation and nearest places: equal to all pairs, and large sets without them."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from roadlark.operators import evaluation, trajectory


def tau_by_force(rows):
    rows = [r for r in rows if None not in r]
    s = a = b = 0
    for i, x in enumerate(rows):
        for y in rows[:i]:
            da, db = np.sign(x[0] - y[0]), np.sign(x[1] - y[1])
            s, a, b = s + da * db, a + (da != 0), b + (db != 0)
    return float(s / math.sqrt(a * b)) if a and b else None


def test_weighted_inversions():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 7, 64, 200):
        order, weight = rng.permutation(n), rng.integers(1, 5, n)
        want = sum(int(weight[i] * weight[j]) for i in range(n) for j in range(i + 1, n) if order[i] > order[j])
        assert evaluation.weighted_inversions(order, weight) == want


@pytest.mark.parametrize("size", [1 << 20, 30])
def test_tau_equals_all_pairs(spark, monkeypatch, size):
    monkeypatch.setattr(evaluation, "RANGE_ROWS", size)
    rng = random.Random(2)
    for rows in (
        [(rng.choice([1.0, 1.0, 1.0, rng.random()]), rng.choice([0.5, 0.5, rng.random()])) for _ in range(300)] + [(None, 1.0), (0.1, None)],
        [(float(i), float(-i)) for i in range(100)],
        [(1.0, float(i)) for i in range(5)],
        [],
    ):
        got = evaluation.kendall_tau_b(spark.createDataFrame(rows, "a double, b double"), "a", "b").first()[0]
        want = tau_by_force(rows)
        assert got is None if want is None else got == pytest.approx(want, abs=1e-12)


def test_tau_of_many_rows(spark):
    n = 1_000_000
    df = spark.range(n).selectExpr("cast(id as double) a", f"cast((id * 7919) % {n} as double) b")
    b = (np.arange(n) * 7919) % n
    opposed = evaluation.weighted_inversions(b, np.ones(n, np.int64))
    assert evaluation.kendall_tau_b(df, "a", "b").first()[0] == pytest.approx(1 - 4 * opposed / (n * (n - 1)), abs=1e-12)


def test_large_far_sets_and_gates(spark):
    rng = np.random.default_rng(5)
    sets = {0: (30.0, 114.0, 20_000), 1: (45.0, 10.0, 15_000), 2: (45.002, 10.001, 6_000), 3: (0.0, 0.0, 50)}
    rows = [("u", d, float(la + x), float(lo + y)) for d, (la, lo, n) in sets.items() for x, y in rng.uniform(0, 0.01, (n, 2))] + [("v", d, 1.0, 1.0) for d in (0, 1) for _ in range(60)]
    df = spark.createDataFrame(rows, "k string, d int, la double, lo double")
    held = {d: np.array([(a, b) for k, e, a, b in rows if k == "u" and e == d]) for d in sets}

    def mean(days):
        total = 0.0, 0
        for d in days:
            for e in (d - 1, d + 1):
                if e in days:
                    there = np.radians(held[e])
                    m = 0.0
                    for s in range(0, len(held[d]), 500):
                        p = np.radians(held[d][s : s + 500])
                        h = np.sin((there[None, :, 0] - p[:, None, 0]) / 2) ** 2 + np.cos(p[:, None, 0]) * np.cos(there[None, :, 0]) * np.sin((there[None, :, 1] - p[:, None, 1]) / 2) ** 2
                        m += (2 * 6_371_000 * np.arcsin(np.sqrt(h.min(1)))).sum()
                    total = total[0] + m, total[1] + len(held[d])
        return total[0] / total[1]

    got = {r.k: r.repeat_m for r in trajectory.route_repeat(df, "k", "d", "id", "la", "lo", least_day=100, least_total=500).collect()}
    assert got == {"u": pytest.approx(mean({0, 1, 2}), rel=1e-9)}
