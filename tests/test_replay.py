"""The replayed rule against a plain version over dictionaries."""

from __future__ import annotations

import math
import random
import statistics
from datetime import date, timedelta

import pytest

from roadlark.operators import replay

START, MAIN, DAYS, BACK = date(2024, 1, 1), date(2024, 1, 11), 16, 6
GROUPS = {"a": "g1", "b": "g1", "c": "g2", "d": "G6", "e": "g2"}


def case(seed):
    rng = random.Random(seed)
    days = [START + timedelta(d) for d in range(DAYS)]
    roster = [(f"k{i:02}", i % 3, round(rng.random(), 2), 60 + rng.random() * 40, rng.random() < 0.5) for i in range(30)]
    counts = [(k, c, rng.choice(days), rng.randrange(1, 5)) for k, *_ in roster for c in GROUPS for _ in range(rng.randrange(5))]
    exposure = [(k, d, round(rng.random() * 300, 1)) for k, *_ in roster if k != "k07" for d in days if rng.random() < 0.6]
    return days, roster, counts, exposure


def plain(days, roster, counts, exposure, whole, top=8, cap=4.0):
    def window(k, at):
        return lambda kk, d: kk == k and at - timedelta(BACK) <= d < at

    def rates(k, at, equipped):
        use = window(k, at)
        km = sum(x for kk, d, x in exposure if use(kk, d))
        n = {c: sum(x for kk, cc, d, x in counts if cc == c and use(kk, d)) for c in GROUPS}
        return ({c: v / km * 1000 for c, v in n.items() if v and (c != "e" or equipped)} if km > 0 else {}), km

    seen = {(k, at): rates(k, at, eq) for k, _, _, _, eq in roster for at in days}
    below = lambda values, x: sum(v < x for v in values) / len(values) if values else 0.5
    out = {}
    for fold in {r[1] for r in roster}:
        train = [r for r in roster if r[1] != fold]
        by_code = {c: sorted((seen[r[0], MAIN][0][c], r[0]) for r in train if c in seen[r[0], MAIN][0]) for c in GROUPS}
        cuts = {c: [v[min(len(v) - 1, round(q * len(v)))][0] for q in (0.5, 0.75, 0.95)] for c, v in by_code.items() if len(v) >= 5}
        best = {r[0] for r in sorted(train, key=lambda r: (-r[2], r[0]))[:top]}
        w = {}
        for c, v in by_code.items():
            up, rest = ([math.log1p(x) for x, k in v if (k in best) == side] for side in (True, False))
            if len(up) >= 3 and len(rest) >= 5 and statistics.fmean(up) > statistics.fmean(rest):
                w[c] = statistics.fmean(up) - statistics.fmean(rest)
        w = {c: x / sum(w.values()) for c, x in w.items()}

        def part(c, x):
            xs, ys = [0, *cuts[c]], [0, 0.5, 0.75, 1]
            if x >= xs[3]:
                return 1.0
            j = next(j for j in (1, 2, 3) if x <= xs[j])
            return ys[j - 1] + (ys[j] - ys[j - 1]) * (x - xs[j - 1]) / (xs[j] - xs[j - 1])

        def lost(rate):
            total = 0.0
            for g in {"g1", "g2"}:
                v = sorted((part(c, x) for c, x in rate.items() if GROUPS[c] == g and c in cuts), reverse=True)
                if v:
                    total += 10 / len(v) * (v[0] + (0.25 * statistics.fmean(v[1:]) if v[1:] else 0))
            return total

        more = lambda rate: min(cap, sum(below([v for v, _ in by_code[c]], x) * w[c] for c, x in rate.items() if c in w))
        losses, teachers = [lost(seen[r[0], MAIN][0]) for r in train], [r[2] for r in train]
        values = []
        for r, loss in zip(train, losses):
            zone = below(teachers, r[2]) > 0.6 and below(losses, loss) > 0.5
            values.append(max(0.0, 100 - loss - (more(seen[r[0], MAIN][0]) if zone else 0)))
        anchor = statistics.median(values)
        for k, _, teacher, final, _ in (r for r in roster if r[1] == fold):
            gate, state, raw = below(teachers, teacher) > 0.6, None, {}
            for at in days:
                rate, km = seen[k, at]
                share = below(losses, lost(rate))
                if at < MAIN:
                    zone = gate and share >= 0.5
                else:
                    state = state or ("in" if gate and share >= 0.5 else "off")
                    if state == "in" and share < 0.45:
                        state = "out"
                    elif state == "out" and share > 0.55 and gate:
                        state = "in"
                    zone = state == "in"
                s = km / (km + 100)
                raw[at] = (zone, anchor if km <= 0 else s * max(0.0, 100 - lost(rate) - (more(rate) if zone else 0)) + (whole - s) * anchor)
            for at in days:
                out[k, at] = (raw[at][0], raw[at][1], min(100.0, max(0.0, final + raw[at][1] - raw[MAIN][1])))
    return out


@pytest.mark.parametrize("seed,whole", [(1, 1.0), (2, 100.0)])
def test_replay_equals_plain(spark, seed, whole):
    days, roster, counts, exposure = case(seed)
    frames = [spark.createDataFrame(counts, "key string, code string, day date, n int"), spark.createDataFrame(exposure, "key string, day date, km double"), spark.createDataFrame(roster, "key string, fold int, teacher double, final double, equipped boolean"), spark.createDataFrame(list(GROUPS.items()), "code string, grp string")]
    got = replay.replay_rules(*frames, str(START), str(days[-1]), str(MAIN), BACK, ("e",), ("G6",), top=8, whole=whole).collect()
    want = plain(days, roster, counts, exposure, whole)
    assert len(got) == len(want) == 30 * DAYS
    assert any(z for z, _, _ in want.values())
    for r in got:
        zone, raw, score = want[r.key, r.day]
        assert (r.zone, r.raw, r.score) == (zone, pytest.approx(raw, abs=1e-9), pytest.approx(score, abs=6e-4))


def test_share_below_of_empty_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 2.0), ("b", 1.0), ("b", None)], "g string, v double")
    got = sorted((r.g, r.v or 0.0, r.s) for r in replay.share_below(df, df.filter("g = 'a'"), ["g"], "v", "s").collect())
    assert got == [("a", 1.0, 0.0), ("a", 2.0, 1 / 3), ("a", 2.0, 1 / 3), ("b", 0.0, None), ("b", 1.0, 0.5)]


def test_replay_keeps_a_row_for_each_key_not_for_each_day(spark, monkeypatch):
    days, roster, counts, exposure = case(3)
    frames = [spark.createDataFrame(counts, "key string, code string, day date, n int"), spark.createDataFrame(exposure, "key string, day date, km double"), spark.createDataFrame(roster, "key string, fold int, teacher double, final double, equipped boolean"), spark.createDataFrame(list(GROUPS.items()), "code string, grp string")]
    kept, write = [], replay.checkpoint

    def count(df):
        out = write(df)
        kept.append(out.count())
        return out

    monkeypatch.setattr(replay, "checkpoint", count)
    got = replay.replay_rules(*frames, str(START), str(days[-1]), str(MAIN), BACK, ("e",), ("G6",), top=8)
    seats = 30 * 3  # a key before its own machine and the two that it helps to fit
    assert max(kept) <= seats < 30 * DAYS == got.count()
