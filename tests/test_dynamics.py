"""Dynamic scores, protocol checks, order over whole tables, bootstraps and streams on literal rows."""

from __future__ import annotations

import datetime
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadlark.operators import bootstrap, cleaning, dynamics, evaluation, joins, models, protocol, trajectory
from roadlark.operators.windows import exact_quantiles, running, with_average_rank, with_position
from roadlark.sources import files
from roadlark.streaming import events as streams

POLICY = dynamics.Policy(half_life=7.0, pending_days=3, window_days=7, step=0.1, cap=1.5, prior=80.0, prior_strength=10.0, least_exposure=5.0, recovery=2.0, coefficients={"night": 1.0, "morning": 1.0, "day": 1.0, "dusk": 1.0})


def history(spark, days, events, initial=90.0, valid=True, as_of="2024-01-10", **kw):
    d = spark.createDataFrame([("a", datetime.date(2024, 1, k), float(e)) for k, e in days], "k string, day date, exposure double")
    e = spark.createDataFrame([(i, "a", f"2024-01-{k:02d} 12:00:00", float(p), s) for i, (k, p, s) in enumerate(events)], "event_id int, k string, t string, points double, status string").select("event_id", "k", F.col("t").cast("timestamp_ntz").alias("ts"), "points", "status")
    s = spark.createDataFrame([("a", initial, valid), ("b", initial, valid)], "k string, initial double, previous_valid boolean")
    return s, dynamics.score_history(s, d, e, "k", as_of, POLICY, **kw)


def test_days_without_exposure_freeze_and_the_first_restarts(spark):
    for valid, first, status in ((True, 90.0, "stopped_frozen"), (False, 80.0, "no_exposure_conservative")):
        s, h = history(spark, [(1, 0), (2, 0), (3, 4)], [], valid=valid)
        rows = h.orderBy("day").collect()
        assert [r.score for r in rows[:2]] == [first, first] and rows[0].status == status and rows[1].status == "stopped_frozen" and rows[2].status == "low_exposure"
        final = {r.k: (r.score, r.status) for r in dynamics.final_scores(s, h, "k", POLICY).collect()}
        assert final["b"] == (90.0 if valid else 80.0, "no_observation") and final["a"][1] == "low_exposure"


def test_risk_never_raises_and_recovery_is_capped(spark):
    _, h = history(spark, [(k, 20) for k in range(1, 8)], [(2, 30, "valid"), (3, 30, "valid")])
    r = h.orderBy("day").collect()
    assert r[1].change <= 0 and r[2].change <= 0 and r[1].multiplier == 1.0 and r[2].multiplier == 1.1
    assert all(x.change <= 2.0 + 1e-9 for x in r) and r[4].change == pytest.approx(2.0) and r[2].risk == pytest.approx(33.0)


def test_pending_counts_after_its_deadline(spark):
    _, h = history(spark, [(k, 5) for k in range(1, 11)], [(7, 10, "pending"), (8, 10, "pending"), (6, 10, "exempt")])
    assert {r.day.day: r.base for r in h.filter("base > 0").collect()} == {7: 10.0}


@pytest.mark.parametrize("days,events,rule", [([(1, 1), (1, 1)], [], "repeated_day"), ([(1, 1)], [(2, 1, "valid")], "event_without_day"), ([(1, 0)], [(1, 1, "valid")], "risk_without_exposure"), ([(1, 1), (12, 1)], [], "day_after_as_of"), ([(1, 1)], [(1, 1, "what")], "unknown_status")])
def test_impossible_histories_are_refused(spark, days, events, rule):
    with pytest.raises(files.ContractError, match=rule):
        history(spark, days, events)


def test_door(spark):
    rows = [(0.7, [0.6, 0.5, 0.44, 0.5, 0.56], "in"), (0.7, [0.6, 0.44, 0.5], "out"), (0.5, [0.9, 0.9], "off"), (0.7, [0.4, 0.9], "off")]
    got = spark.createDataFrame(rows, "t double, xs array<double>, want string").select("want", dynamics.door(F.col("xs"), F.col("t")).alias("got")).collect()
    assert all(r.want == r.got for r in got)


# ---- order over whole tables


@pytest.fixture(scope="module")
def numbers(spark):
    rng = random.Random(3)
    return spark.createDataFrame([(i, round(rng.gauss(0, 3), 1), rng.randrange(2)) for i in range(1500)], "i long, x double, y int").repartition(7).cache()


def test_running_positions_ranks_and_quantiles(spark, numbers):
    rows = sorted((r.x, r.i) for r in numbers.collect())
    got = {r.i: r.position for r in with_position(numbers, ["x", "i"]).collect()}
    assert [got[i] for _, i in rows] == list(range(len(rows)))
    x = np.array([v for v, _ in rows])
    rank = {r.x: r.rank for r in with_average_rank(numbers, {"rank": "x"}).collect()}
    assert all(rank[v] == (np.searchsorted(x, v) + np.searchsorted(x, v, "right") + 1) / 2 for v in set(x.tolist()))
    q = exact_quantiles(numbers, "x", {"a": 0.1, "b": 0.5, "c": 0.999}).first()
    assert np.allclose([q.a, q.b, q.c], np.quantile(x, [0.1, 0.5, 0.999]))
    down = running(numbers.groupBy("x").count(), ["x"], {"s": "count"}, descending=True).orderBy(F.desc("x")).collect()
    assert [r.s for r in down] == [sum(r2["count"] for r2 in down[:k]) for k in range(len(down))]
    assert running(numbers.limit(0), ["x"], {"s": "y"}).count() == 0 and exact_quantiles(numbers.limit(0), "x", {"a": 0.5}).first().a is None


def test_auc_has_no_window_over_the_whole_table(numbers):
    for df in (evaluation.auc(numbers, "x", "y"), evaluation.average_precision(numbers, "x", "y")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "__s" in plan and not any("windowspecdefinition(__s" in line and "SinglePartition" in line for line in plan.splitlines())


def test_bootstrap(spark):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 400)
    rows = [(i, float(a), float(b), int(t)) for i, (a, b, t) in enumerate(zip(y + rng.normal(0, 1, 400), rng.normal(0, 1, 400), y))]
    df = spark.createDataFrame(rows, "i long, a double, b double, y int")
    one, again = (bootstrap.paired_bootstrap(df.repartition(n), "a", "b", "y", "i", draws=200).first() for n in (1, 5))
    auc = lambda k: np.mean([(p[k] > n[k]) + (p[k] == n[k]) / 2 for p in rows if p[3] for n in rows if not n[3]])
    assert one.point == pytest.approx(auc(1) - auc(2)) and one.low < one.point < one.high and one.improved == 1.0 and one.draws == 200
    assert 0 < one.recall_low <= one.recall_median <= one.recall_high
    assert again.draws == 200 and abs(again.mean - one.mean) < 0.02
    none = bootstrap.paired_bootstrap(df.limit(0), "a", "b", "y", "i", draws=5).first()
    assert none.draws == 0 and none.point is None


# ---- joins and places


def test_nearest_keeps_repeated_rows(spark):
    left = spark.createDataFrame([("a", 10), ("a", 10), ("a", 500), ("b", 10)], "k string, s long")
    right = spark.createDataFrame([("a", 12, 1), ("a", 8, 2)], "k string, t long, v int")
    got = joins.nearest_in_time(left, right, "k", "s", "t", 60, ["v"], ["v"]).collect()
    assert sorted((r.k, r.s, r.nearest_s, r.v) for r in got if r.v) == [("a", 10, 8, 2)] * 2 and len(got) == 4


@pytest.mark.parametrize("lat", [0.0, 59.0, 70.0, -85.0, 89.9])
def test_hotspots_at_any_latitude(spark, lat):
    """Pairs 190 m apart along a parallel, at places far from each other, one of them across 180 degrees."""
    step = math.degrees(2 * math.asin(math.sin(190 / 2 / 6_371_000) / math.cos(math.radians(lat))))
    starts = [-180.0 - step / 2, *(-170.0 + 40 * k + 0.001 * k for k in range(9))] if abs(lat) < 89 else [-180.0 - step / 2]
    rows = [("a", 2 * k + d, lat, (lon + d * step + 180) % 360 - 180) for k, lon in enumerate(starts) for d in (0, 1)]
    got = trajectory.hotspots(spark.createDataFrame(rows, "k string, i long, lat double, lon double"), "k", "i", "lat", "lon").collect()
    assert {(r.i, r.cluster) for r in got} == {(i, i - i % 2) for _, i, _, _ in rows}


def test_hotspots_at_one_place(spark):
    rows = [("a", i, 10.0, 20.0) for i in range(300)] + [("a", 999, 11.0, 20.0), ("b", 1000, 10.0, 20.0)]
    got = trajectory.hotspots(spark.createDataFrame(rows, "k string, i long, lat double, lon double"), "k", "i", "lat", "lon").collect()
    assert {(r.k, r.cluster) for r in got} == {("a", 0)} and len(got) == 300


def test_align_and_locked_inputs(spark, tmp_path):
    a = spark.createDataFrame([(2, 0), (1, 1)], "k int, y int")
    b = spark.createDataFrame([(1, 1, 5.0), (2, 0, 6.0)], "k int, y int, x double")
    assert [(r.k, r.x) for r in protocol.align(a, [b], "k", "y").orderBy("position").collect()] == [(1, 5.0), (2, 6.0)]
    for bad in (b.filter("k = 1"), b.unionAll(b), b.withColumn("y", F.lit(0))):
        with pytest.raises(files.ContractError):
            protocol.align(a, [bad], "k", "y")
    b.write.parquet(str(tmp_path / "b"))
    hashes = {r.name: r.sha256 for r in protocol.file_hashes(spark, str(tmp_path / "b")).collect()}
    assert protocol.read_locked(spark, str(tmp_path / "b"), hashes, ["k", "y", "x"]).count() == 2
    with pytest.raises(files.ContractError, match="columns"):
        protocol.read_locked(spark, str(tmp_path / "b"), hashes, ["k"])
    with pytest.raises(files.ContractError, match="hashes"):
        protocol.read_locked(spark, str(tmp_path / "b"), {k: "0" * 64 for k in hashes})
    protocol.append_ledger(a, str(tmp_path / "l"), "1")
    with pytest.raises(files.ContractError):
        protocol.append_ledger(a, str(tmp_path / "l"), "1")
    with pytest.raises(files.ContractError, match="big: 1"):
        protocol.require(b, {"big": F.col("x") > 5.5})


def test_views_are_a_partition():
    cols = ["a_5d", "a_20d", "b_rate", "c"]
    v = protocol.views(cols, {"windows": r"_\d+d$", "rates": "rate"})
    assert v == {"windows": ["a_5d", "a_20d"], "rates": ["b_rate"], "slim": ["c"]} and sorted(sum(v.values(), [])) == sorted(cols)


def test_functions_that_no_query_uses(spark, tmp_path):
    df = spark.createDataFrame([(1, None, 2.0, None, None), (2, float("nan"), 3.0, 30.0, 114.0), (1, 5.0, None, 31.0, 115.0)], "k int, a double, b double, lat double, lon double")
    assert [r.x for r in df.select(cleaning.coalesce_sources("a", "b").alias("x")).collect()] == [2.0, 3.0, 5.0]
    filled = cleaning.fill_median_in_box(df, "k", "lat", "lon", (20, 40, 110, 120)).filter("b = 2.0").first()
    assert (filled.lat, filled.lon) == (31.0, 115.0)
    assert cleaning.feature_columns(df.withColumn("label_x", F.lit(1)), ["k"]) == ["a", "b", "lat", "lon"] and cleaning.numeric(df, ["k", "a"]) == ["k", "a"]
    assert cleaning.without_constant(df.withColumn("c", F.lit(1)), ["k", "c"]) == ["k"]
    df.select("k", "b").write.csv(str(tmp_path / "c"), header=True)
    assert files.read_csv(spark, str(tmp_path / "c"), "k int, b double").count() == 3
    df.write.parquet(str(tmp_path / "p"))
    assert files.schema_of(spark, str(tmp_path / "p")) == df.columns
    at = F.to_timestamp(F.concat(F.lit("2024-01-0"), "k")).cast("timestamp_ntz")
    cover = files.shard_coverage(spark.read.parquet(str(tmp_path / "p")), at, "2024-01-02", "2024-01-03").agg(F.sum("before"), F.sum("inside"), F.sum("after")).first()
    assert tuple(cover) == (2, 1, 0)
    assert [(r.k, r["rank"]) for r in joins.top_rows(df, ["k"], [F.col("b").desc_nulls_last()], 1).orderBy("k").collect()] == [(1, 1), (2, 1)]


def test_model_choices(spark):
    rng = random.Random(1)
    rows = []
    for i in range(240):
        y = rng.randrange(2)
        rows.append((i, rng.gauss(y, 0.7), rng.random(), y, i % 3, "ab"[i % 2], min(max(0.5 + (y - 0.5) * 0.6 + rng.gauss(0, 0.2), 0.02), 0.98)))
    d = spark.createDataFrame(rows, "i int, a double, b double, y int, fold int, g string, p double").cache()
    assert [f for f, _ in models.nested_selection(d, ["a", "b"], "y", "fold", [0, 1, 2], ["logistic"])] == [0, 1, 2]
    alpha, auc = models.best_alpha(d, "p", "b", "y", [0.0, 0.5, 1.0])
    assert alpha == 1.0 and auc > 0.9 and models.best_alpha(d, "p", "b", "y", [0.5], least_auc=0.999) == (None, None)
    c = models.group_calibration(d, "p", "y", "g").groupBy("g").agg(F.avg("calibrated").alias("c"), F.avg("y").alias("y"), F.avg("p").alias("p")).collect()
    assert all(abs(r.c - r.y) <= abs(r.p - r.y) + 0.05 for r in c)
    slope, _ = models.platt(d, "p", "y")
    assert slope > 1


# ---- streams


def write_batches(spark, folder, schema, batches):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/b={k}")


def test_evidence_by_deadline_over_several_files(spark, tmp_path):
    t = lambda d, h=0: datetime.datetime(2024, 1, d, h)
    schema = "event_id long, ts timestamp, status string"
    write_batches(spark, str(tmp_path / "e"), schema, [[(1, t(1), "pending"), (2, t(1), "pending"), (3, t(1), "valid"), (4, t(1), "pending")], [(2, t(2), "exempt"), (9, t(5), "valid")], [(1, t(6), "exempt"), (8, t(20), "pending")]])
    s = spark.readStream.schema(schema + ", b int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "e"))
    got = {(r.event_id, r.resolved, r.included) for r in streams.run(streams.evidence(s), "update").collect()}
    assert got == {(3, "valid", True), (2, "exempt", False), (9, "valid", True), (1, "auto_valid_after_deadline", True), (4, "auto_valid_after_deadline", True)}


def test_doors_over_several_files(spark, tmp_path):
    t = lambda d: datetime.datetime(2024, 1, d)
    schema = "user_id long, ts timestamp, x double, teacher double"
    write_batches(spark, str(tmp_path / "d"), schema, [[(1, t(1), 0.6, 0.7), (2, t(1), 0.4, 0.7)], [(1, t(2), 0.4, 0.7), (2, t(2), 0.9, 0.7)], [(1, t(3), 0.5, 0.7)]])
    s = spark.readStream.schema(schema + ", b int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "d"))
    assert {(r.user_id, r.state) for r in streams.run(streams.doors(s), "update", ["user_id"]).collect()} == {(1, "out"), (2, "off")}
