"""The paired bootstrap against draws made row by row."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from roadlark.operators import bootstrap

DRAWS, SEED = 40, 42


def by_force(rows, place, parts, quota):
    """Weights of each draw from the parts' generators; AUCs and recalls from the rows with their weights."""
    rows = [r for r in rows if None not in r[:4] and r[3] in (0, 1) and not math.isnan(r[1])]
    held = [sorted((r for r in rows if place[r[0]] == p)) for p in range(parts)]
    counts = np.array([[sum(r[3] == k for r in h) for h in held] for k in (0, 1)])
    ones, zeros, pooled = {}, {}, {}
    for p, h in enumerate(held):
        for kind, own, out in ((1, [r for r in h if r[3] == 1], ones), (0, [r for r in h if r[3] == 0], zeros), (2, h, pooled)):
            w = bootstrap._weights(SEED, range(DRAWS), kind, counts[kind] if kind < 2 else counts.sum(0), p)
            out.update({r: w[i] for i, r in enumerate(own)})
    d, rec = [], []
    for t in range(DRAWS):
        assert sum(w[t] for w in ones.values()) == counts[1].sum() and sum(w[t] for w in zeros.values()) == counts[0].sum() and sum(w[t] for w in pooled.values()) == len(rows)
        auc = [sum(int(w[t]) * int(v[t]) * ((x[k] > y[k]) + (x[k] == y[k]) / 2) for x, w in ones.items() for y, v in zeros.items()) / (counts[0].sum() * counts[1].sum()) for k in (1, 2)]
        d.append(auc[0] - auc[1])
        found = []
        for k in (1, 2):
            room, got = max(1, math.ceil(quota * len(rows))), 0
            for r in sorted(rows, key=lambda r: (-r[k], r[0])):
                take = min(room, int(pooled[r][t]))
                room, got = room - take, got + take * r[3]
            found.append(got / sum(int(pooled[r][t]) for r in rows if r[3] == 1))
        rec.append(found[0] - found[1])
    return np.array(d), np.array(rec)


@pytest.mark.parametrize("size,held", [(1 << 18, 1 << 31), (9, 60 * 12 * 15)])
def test_draws_equal_row_by_row(spark, monkeypatch, size, held):
    monkeypatch.setattr(bootstrap, "PART_ROWS", size)
    monkeypatch.setattr(bootstrap, "WEIGHT_BYTES", held)
    rng = random.Random(1)
    rows = [(i, rng.choice([0.5, 0.5, rng.random()]), rng.choice([0.2, rng.random()]), int(rng.random() < 0.4)) for i in range(60)] + [(100, None, 0.1, 1), (101, 0.1, 0.2, None), (102, 0.3, 0.3, 2), (103, float("nan"), 0.3, 1)]
    df = spark.createDataFrame(rows, "id long, a double, b double, y int").repartition(3)
    parts = max(1, math.ceil(60 / size))
    place = dict.fromkeys(range(60), 0)
    if parts > 1:
        place = {r.id: r.p for r in df.selectExpr("id", f"pmod(xxhash64(id, a, b, y), {parts}) p").collect()}
    d, rec = by_force(rows, place, parts, 0.2)
    got = bootstrap.paired_bootstrap(df, "a", "b", "y", "id", draws=DRAWS).first()
    assert got.draws == DRAWS and got.mean == pytest.approx(d.mean(), abs=1e-12)
    assert [got.low, got.high, got.improved] == pytest.approx([np.quantile(d, 0.025), np.quantile(d, 0.975), (d > 0).mean()], abs=1e-12)
    assert [got.recall_median, got.recall_low, got.recall_high] == pytest.approx(np.quantile(rec, [0.5, 0.025, 0.975]).tolist(), abs=1e-12)


def test_a_task_holds_a_part_for_a_few_draws(monkeypatch):
    import pyarrow as pa

    n, most = 3000, []
    made = bootstrap._each
    monkeypatch.setattr(bootstrap, "_each", lambda seed, draws, *rest: (most.append(len(draws)), made(seed, draws, *rest))[1])
    columns = [pa.array(range(n)), pa.array([i % 7 / 7 for i in range(n)]), pa.array([i % 5 / 5 for i in range(n)]), pa.array([i % 2 for i in range(n)], pa.int32())]
    rows = [pa.RecordBatch.from_arrays([pa.array([k] * n), pa.array([0] * n), *columns], names=["step", "part", "id", "a", "b", "y"]) for k in range(2)]
    out = list(bootstrap._drawn(iter(rows), SEED, range(100), np.array([[n // 2], [n // 2]]), bootstrap.STEP, True))
    assert sorted(set(most)) == [36, 64] and {len(x) for b in out for x in b.column(4).to_pylist()} <= {36, 64, 144, 256}


def test_without_recall(spark):
    df = spark.createDataFrame([(i, i % 7 / 7, i % 5 / 5, i % 2) for i in range(90)], "id long, a double, b double, y int")
    whole, part = (bootstrap.paired_bootstrap(df, "a", "b", "y", "id", draws=70, recall=r).first() for r in (True, False))
    assert part[:6] == whole[:6] and part[6:] == (None, None, None) and None not in whole


def test_one_class(spark):
    df = spark.createDataFrame([(i, i / 9, 0.5, 1) for i in range(9)], "id long, a double, b double, y int")
    got = bootstrap.paired_bootstrap(df, "a", "b", "y", "id", draws=5).first()
    assert got.draws == 0 and got.point is None and got.mean is None and got.recall_median is not None
