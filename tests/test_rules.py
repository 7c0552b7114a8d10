"""Cleaning rules, checks between streams, axes, contracts and sources on small cases and against brute force."""

from __future__ import annotations

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadlark.operators import cleaning, contract, cross_checks, models, sensing
from roadlark.sources import files


def test_around_equals_brute_force(spark):
    rng = random.Random(5)
    left = [(rng.choice(["a", "b", None]), rng.choice([None, rng.randrange(9000)]), i) for i in range(120)] + [("a", 3600, 500), ("a", 3600, 500)]
    right = [(rng.choice(["a", "b", None]), rng.choice([None, rng.randrange(9000)]), rng.random()) for _ in range(300)]
    a, b = spark.createDataFrame(left, "key string, s long, id int"), spark.createDataFrame(right, "key string, s long, v double")
    got = sorted((r.key or "", -1 if r.s is None else r.s, r.id, r.n or 0, r.top) for r in cross_checks.around(a, b, "key", "s", "s", 60, {"n": (F.count, "v"), "top": (F.max, "v")}, cell_s=100).collect())
    want = []
    for k, s, i in left:
        near = [v for kk, ss, v in right if k is not None and s is not None and kk == k and ss is not None and abs(ss - s) <= 60]
        want.append((k or "", -1 if s is None else s, i, len(near), max(near, default=None)))
    assert [g[:4] for g in got] == sorted(w[:4] for w in want)
    assert {(g[:3], g[4]) for g in got} == {(w[:3], w[4]) for w in want}


def test_persistent_conflict_needs_a_point_and_all_slow(spark):
    t = spark.createDataFrame([("a", 0, 1.0), ("a", 50, 4.0), ("b", 0, 1.0), ("b", 50, 30.0)], "key string, s long, speed double")
    i = spark.createDataFrame([("a", 20, 60.0), ("b", 20, 60.0), ("c", 20, 60.0), ("a", 500, 60.0), ("a", 21, 19.0)], "key string, s long, ems double")
    assert [(r.key, r.s) for r in cross_checks.persistent_conflicts(i, t, "key", "s", "ems", "speed").collect()] == [("a", 20)]


def test_lasting_differences_end_where_no_point_is_near(spark):
    t = spark.createDataFrame([("a", s, 0.0) for s in (0, 10, 20, 30, 1000)], "key string, s long, speed double")
    i = spark.createDataFrame([("a", s, 50.0, s) for s in (0, 10, 20, 30, 500, 1000)], "key string, s long, ems double, id int")
    got = cross_checks.lasting_differences(i, t, "key", "s", "ems", "speed", "id").collect()
    assert [(r.start_s, r.end_s, r.rows) for r in got] == [(0, 30, 4)]


EVENTS = "key string, ts timestamp_ntz, lat double, lon double, speed double, reason_text string"


def test_clean_events_fates_and_fill(spark):
    from datetime import datetime

    day, late = datetime(2024, 1, 2), datetime(2024, 3, 1)
    rows = [("a", day, 30.0, 110.0, 50.0, None)] * 3 + [("a", day, 0.0, 0.0, -1.0, "x"), ("a", day, None, 110.0, 170.0, "x"), ("a", day, 95.0, 110.0, 201.0, "x"), ("a", late, 30.0, 110.0, 50.0, "x"), ("a", late, 30.0, 110.0, 50.0, "x"), (None, day, math.nan, 1.0, math.nan, "x"), ("b", None, 1.0, 1.0, 1.0, "x")]
    kept, out = cleaning.clean_events(spark.createDataFrame(rows, EVENTS), "ts", "2024-01-01", "2024-02-01", "lat", "lon", "speed", "key")
    got = sorted((r.key or "", r.coord_flag or "", r.speed_flag or "", r.lat, r.speed) for r in kept.collect())
    assert got == [("", "missing", "missing", None, None), ("a", "", "", 30.0, 50.0), ("a", "missing", "suspicious_gt160", None, 170.0), ("a", "out_of_range", "impossible_gt200", 30.0, None), ("a", "zero_placeholder", "negative_invalid", 30.0, None)]
    assert sorted(r.reason for r in out.collect()) == ["exact_duplicate"] * 2 + ["out_of_window"] * 3
    kept, out = cleaning.clean_events(spark.createDataFrame([], EVENTS), "ts", "2024-01-01", "2024-02-01", "lat", "lon", "speed")
    assert kept.count() == out.count() == 0


def test_alignment_finds_a_mounting(spark):
    rng = np.random.default_rng(3)
    basis, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    basis[:, 2] = np.cross(basis[:, 0], basis[:, 1])
    own = np.column_stack([rng.normal(0, 0.3, 900), rng.normal(0, 0.05, 900), np.ones(900)]) @ basis.T
    rows = [("a", i // 300, *map(float, x), 30.0) for i, x in enumerate(own)] + [("few", 0, 0.0, 0.0, 1.0, 30.0)] * 5 + [("few", 0, None, 0.0, 1.0, 30.0), ("still", 0, 0.0, 0.0, 1.0, None)]
    df = spark.createDataFrame(rows, "key string, day int, x double, y double, z double, v double")
    a = {r.key: r for r in sensing.alignment(df, "key", "day", ("x", "y", "z"), F.col("v") >= 5, day_rows=200).collect()}
    r = a["a"]
    assert r.align_pass and r.daily_cosine > 0.99 and r.var_ratio > 20
    assert abs(abs(np.dot(r.forward, basis[:, 0])) - 1) < 1e-2 and abs(np.dot(r.vertical, basis[:, 2]) - 1) < 1e-2
    m = np.array([r.forward, r.lateral, r.vertical])
    assert np.allclose(m @ m.T, np.eye(3), atol=1e-9)
    assert a["few"].reason == a["still"].reason == "insufficient_rows" and a["few"].n == 5 and a["still"].n_drive == 0 and not a["still"].align_pass
    back = sensing.rotated(df, sensing.alignment(df, "key", "day", ("x", "y", "z"), F.col("v") >= 5), "key", {"a": ("x", "y", "z")})
    stats = {r.key: r for r in back.groupBy("key").agg(F.avg("a_vert").alias("m"), F.count("a_fwd").alias("n")).collect()}
    assert abs(stats["a"].m - 1) < 1e-2 and stats["few"].n == 0


def test_contract_from_json(spark):
    text = {"event_mappings": [{"code": 11401, "semantic_group": "speed", "scoring_role": "behaviour", "exposure_denominator": "km"}, {"code": "30002", "semantic_group": "lane", "scoring_role": "behaviour", "exposure_denominator": "km"}], "risk_chains": [{"id": "lane", "merge_window_seconds": 120, "codes": [30002]}]}
    assert sorted((r.code, r.chain, r.merge_s) for r in contract.load_contract(spark, json.dumps(text)).collect()) == [("11401", "speed:11401", 60), ("30002", "lane", 120)]
    for change in ({"event_mappings": text["event_mappings"] * 2}, {"risk_chains": [{"id": "x", "merge_window_seconds": 1, "codes": [9]}]}):
        with pytest.raises(files.ContractError):
            contract.load_contract(spark, json.dumps(text | change))
    with pytest.raises(files.ContractError):
        contract.load_contract(spark, "{}")


def test_review_matrix_that_is_good(spark):
    rows = [(r, c, "long" if c < 4 else "short", 4.0, 5.0) for r in range(5) for c in range(10)]
    check = lambda rows: {r.rule: r.violations for r in contract.review_errors(spark.createDataFrame(rows, "r int, c int, k string, q1 double, q2 double"), "r", "c", "k", ["q1", "q2"], 5, 10, {"long": 4, "short": 6}).collect()}
    assert set(check(rows).values()) == {0}
    bad = check([(*rows[0][:3], None, 2.0), (None, 1, "long", 4.0, 4.0), *rows[1:], rows[1]])
    assert {k for k, v in bad.items() if v} == {"empty_id", "repeated_pair", "reviewers", "incomplete", "rating", "least"}
    assert check([])["incomplete"] == 1


def test_gates_take_null_as_no_gain(spark):
    g = lambda *x: spark.range(1).select(contract.adopted(*(F.lit(v).cast("double") for v in x)).alias("a")).first().a
    assert g(0.006, 0.0, 0.0) and g(0.001, 0.006, -0.02) and not g(0.001, 0.0, 0.0) and not g(0.01, 0.0, -0.03) and not g(0.01, -0.01, 0.0) and not g(None, 0.1, 0.1)


def test_fused_views_keep_the_best(spark):
    rows = [(i, i % 2, 0.9 if i % 2 else 0.1, 0.6 if i % 4 else 0.4, 0.5) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, y int, good double, fair double, flat double")
    best, out = models.fused_views(df, {"good": "v1", "flat": "v1", "fair": "v2"}, "y", keep=2)
    assert [b[:2] for b in best] == [("v1", "good"), ("v2", "fair")] and "fuse_good__fair" in out.columns and len(out.columns) == 6
    assert models.fused_views(df, {"good": "v1", "fair": "v2"}, "y", keep=1)[1].columns == df.columns


def test_clusters_with_ineligible_rows(spark):
    rows = [(i, float(i % 2) * 10 + i / 100, float(i % 2), i != 3) for i in range(30)] + [(99, None, 1.0, True), (98, 5.0, 1.0, None)]
    df = spark.createDataFrame(rows, "id int, x double, idx double, ok boolean")
    out, k = models.clusters_with_rank(df, range(2, 4), ["x"], "idx", F.col("ok"))
    got = {r.id: (r.cluster, r.risk_rank, r.risk_group) for r in models.risk_group(out).collect()}
    assert len(got) == 32 and {got[i] for i in (3, 98, 99)} == {(-1, -1, "insufficient")}
    assert k == 2 and got[1][1:] == (2, "high") and got[2][1:] == (1, "low")
    assert models.clusters_with_rank(df.limit(0), range(2, 4), ["x"], "idx", F.col("ok"))[0].count() == 0


def test_shards_by_window(spark, tmp_path):
    lines = ["1\t2024-01-05 10:00:00\tok\t5", "2\t2024-01-05 09:00:00\tok\t\\N", "3\t2024-01-07 00:00:00\tok\t5", "4\tbad 2024-01-05\tok\t5", "5\t2024-01-06 23:59:59\tNULL\tx", "", "6"]
    (tmp_path / "a.tsv").write_text("\n".join(lines))
    order, types = ["id", "t", "flag", "v"], {"id": "long", "t": "timestamp_ntz", "flag": "string", "v": "double"}
    got = files.scan_window(spark, str(tmp_path / "a.tsv"), order, types, "t", "2024-01-05 09:30:00", "2024-01-07", {"flag": ["ok"]}).orderBy("id").collect()
    assert [(r.id, r.flag, r.v) for r in got] == [(1, "ok", 5.0), (5, None, None)]
    with pytest.raises(Exception, match="flag can't be ok"):
        files.scan_window(spark, str(tmp_path / "a.tsv"), order, types, "t", "2024-01-05", "2024-01-07", {"flag": ["no"]}).count()
    (tmp_path / "b.tsv").write_text("\n".join(f"k\t2024-01-0{d} 00:00:00" for d in (1, 3, 2, 5, 4)))
    assert [(r.key, r.n) for r in files.disorder(spark, str(tmp_path / "b.tsv"), ["k", "t"], "k", "t").collect()] == [("k", 2)]


def test_embedded_json(spark):
    pages = [("x\nwindow.D = {\"a\": 1};\ny",), ("window.D = {broken;\n",), ("window.E = {\"a\": 1};",), (None,), ("",), ("window.D = {\"a\": \"no\"};",)]
    got = [r.a for r in spark.createDataFrame(pages, "h string").select(files.embedded_json(F.col("h"), "D", "a int")["a"].alias("a")).collect()]
    assert got == [1, None, None, None, None, None]
    with pytest.raises(files.ContractError):
        files.embedded_json(F.col("h"), "a b", "a int")


def test_ledger_bytes_and_atomic_write(tmp_path):
    make = lambda rules: files.drop_ledger(["a"], [("b", "variance", "constant")], rules)
    assert make({"x": 1, "y": 2}) == make({"y": 2, "x": 1})
    with pytest.raises(files.ContractError):
        files.drop_ledger(["a"], [("a", "variance", "")], {})
    target = tmp_path / "ledger.json"
    files.write_atomic(make({}), str(target))
    with pytest.raises(TypeError):
        files.write_atomic(None, str(target))
    assert target.read_text() == make({}) and [p.name for p in tmp_path.iterdir()] == ["ledger.json"]


def test_route_repeat_equals_all_pairs(spark):
    from roadlark.operators import trajectory

    rng = random.Random(9)
    far = [(rng.choice("abc"), rng.choice([0, 1, 2, 5]), rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(60)]
    near = [("d", d, 70 + rng.uniform(0, 0.01), 179.995 + rng.uniform(0, 0.01)) for d in (0, 1) for _ in range(25)]
    near = [(k, d, a, o if o <= 180 else o - 360) for k, d, a, o in near]
    rows = far + near + near[:3] + [("a", 1, None, 1.0), ("e", 1, 1.0, 1.0), (None, 1, 1.0, 1.0)]

    def metres(p, q):
        a, b, c, d = map(math.radians, (p[2], p[3], q[2], q[3]))
        return 2 * 6_371_000 * math.asin(math.sqrt(min(1, math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2)))

    want = {}
    full = [r for r in rows if r[0] and r[2] is not None]
    for p in full:
        for side in (1, -1):
            if other := [metres(p, q) for q in full if q[0] == p[0] and q[1] == p[1] + side]:
                want.setdefault(p[0], []).append(min(other))
    df = spark.createDataFrame([(k, d, i, a, o) for i, (k, d, a, o) in enumerate(rows)], "key string, day int, id int, lat double, lon double")
    dated = df.withColumn("day", F.date_add(F.lit("2024-01-01").cast("date"), F.col("day")))
    for src, pairs in ((df, 0), (df, 100), (dated, 1 << 16)):
        got = {r.key: r.repeat_m for r in trajectory.route_repeat(src, "key", "day", "id", "lat", "lon", pairs=pairs).collect()}
        assert got == {k: pytest.approx(sum(v) / len(v), rel=1e-9) for k, v in want.items()}
    assert trajectory.route_repeat(df.limit(0), "key", "day", "id", "lat", "lon").count() == 0


def test_thresholds_fall_back(spark):
    kinds = spark.createDataFrame([("x",), ("b",), (None,)], "kind string")
    fitted = spark.createDataFrame([("b", 3.0, None), ("a", 1.0, 2.0)], "kind string, hi double, lo double")
    take = lambda f, u=None: {r.kind: (r.hi, r.lo) for r in sensing.thresholds_for(kinds, f, "kind", ["hi", "lo"], {"hi": 9.0, "lo": 8.0}, u).collect()}
    assert take(fitted) == {"b": (3.0, None), "x": (1.0, 2.0), None: (1.0, 2.0)}
    assert take(fitted.limit(0)) == dict.fromkeys(("b", "x", None), (9.0, 8.0))
    assert take(fitted, {"lo": 5})["b"] == (3.0, 5.0)


def test_members_in_the_order_of_the_roster(spark, tmp_path):
    (tmp_path / "roster.csv").write_text("id\nc\na\nb\n")
    (tmp_path / "member.csv").write_text("id,sample,x,note\na ,s1,1.5,q\nb,s2,,q\nc,s3,3,q\n")
    roster = files.read_ordered(spark, str(tmp_path / "roster.csv"), "id")
    table = spark.read.csv(str(tmp_path / "member.csv"), header=True)
    got = files.read_member(table, roster, "id", ["sample"], ["note"], ["y", "fold"]).orderBy("ordinal").collect()
    assert [(r.id, r.ordinal, r.x) for r in got] == [("c", 0, 3.0), ("a", 1, 1.5), ("b", 2, None)]
    for bad, blocked in ((table, []), (table.withColumn("y", F.lit(1)), ["note"]), (table.filter("id <> 'c'"), ["note"]), (table.unionAll(table), ["note"]), (table.select("id", "sample"), ["note"])):
        with pytest.raises(files.ContractError):
            files.read_member(bad, roster, "id", ["sample"], blocked, ["y", "fold"])


def test_finalize_columns_in_three_stages(spark):
    rng = random.Random(2)
    x = [rng.random() for _ in range(50)]
    rows = [(v, v ** 3, -v, 1.0, rng.random(), v, None if i == 3 else float("nan") if i == 4 else v * 2 + 1) for i, v in enumerate(x)]
    names = ["a_per_1000km", "cube", "down", "flat", "free", "a_per_100h", "b_per_100h"]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names))
    kept, dropped = cleaning.finalize_columns(df, [*names, "free"])
    assert kept == ["a_per_1000km", "free"]
    assert [d[:2] for d in dropped] == [("a_per_100h", "dual_track"), ("flat", "near_zero_variance"), ("cube", "spearman_rho"), ("down", "spearman_rho"), ("b_per_100h", "spearman_rho")]
    assert dropped[3][2] == "a_per_1000km -1.000000"
    assert cleaning.finalize_columns(df, [])[0] == []


def test_platt_by_group(spark):
    rng = random.Random(8)
    rows = []
    for i in range(600):
        g = ("low", "high", "none")[i % 3]
        p = rng.uniform(0.05, 0.95)
        z = math.log(p / (1 - p)) + {"low": -1.5, "high": 1.5, "none": 0.0}[g]
        rows.append((i, g, i % 5, p, int(rng.random() < 1 / (1 + math.exp(-z)))))
    df = spark.createDataFrame([*rows, (999, None, 0, 0.5, 1)], "id int, g string, fold int, p double, y int")
    at = models.platt_by_group(df, "p", "y", "g", ["low"], ["high", "absent"])
    got = {r.g: r for r in df.withColumns({"few": at(1e9), "much": at(0.0), "some": at(50.0)}).groupBy("g").agg(*(F.avg(c).alias(c) for c in ("few", "much", "some", "y"))).collect()}
    assert abs(got["low"].much - got["low"].y) < 0.01 and abs(got["high"].much - got["high"].y) < 0.01  # a fit with an intercept meets its mean
    assert got["high"].few < got["high"].some < got["high"].much and got["none"].few == got["none"].much and got["low"].few == got["low"].much
    assert models.best_n0(df, "p", "y", "g", ["low"], ["high"], "fold", [0.0, 1e9]) == 0.0
    assert models.best_n0(df.filter("y = 1"), "p", "y", "g", ["low"], ["high"], "fold", [20.0, 80.0]) == 80.0


def test_volatility_means_are_the_same_in_any_order(spark):
    tenths = [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.07 * 10, 0.8] * 28 + [0.3] * 4  # 102.0 in 256 rows: a tie at six places
    rng = random.Random(7)
    rows = [(k, v) for k in range(12) for v in rng.sample(tenths, len(tenths))] + [(99, float("nan")), (99, 1.0)]
    df = spark.createDataFrame(rows, "k int, az double").coalesce(1)
    got = {(r.k, r.part): (r.n, r.mean) for r in sensing.volatility_parts(df, "k", ["az"], F.lit(True), {"none": F.col("az") < 0}).collect()}
    assert math.isnan(got.pop((99, "all"))[1]) and got.pop((99, "none")) == (0, None)
    assert {v for (_, p), v in got.items() if p == "none"} == {(0, None)}
    assert {v for (_, p), v in got.items() if p == "all"} == {(256, 0.3984375)}
