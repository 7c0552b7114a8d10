"""Boundaries of single operators on literal rows."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from roadlark.functions import scalars as S
from roadlark.operators import aggregates, cleaning, evaluation, joins, rules, sessions, trajectory
from roadlark.operators.windows import average_rank, in_history, in_label_window, islands
from roadlark.sources import files


def one(spark, c, **cols):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in cols.items())) if cols else spark.range(1)
    return df.select(c.alias("x")).first().x


def test_history_is_half_open(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:00",), ("2023-12-31 23:59:59",), ("2024-01-20 23:59:59",), ("2024-01-21 00:00:00",)], "t string").select(F.col("t").cast("timestamp_ntz").alias("t"))
    assert [r.h for r in df.select(in_history(F.col("t"), "2024-01-21", 20).alias("h")).collect()] == [True, False, True, False]
    assert [r.h for r in df.select(in_label_window(F.col("t"), "2024-01-21", 10).alias("h")).collect()] == [False, False, False, True]


@pytest.mark.parametrize("gaps,segments", [([0, 60, 119], 1), ([0, 120], 1), ([0, 121], 2)])
def test_gap_is_inclusive(spark, gaps, segments):
    df = spark.createDataFrame([("a", s) for s in gaps], "k string, s long")
    assert islands(df, ["k"], ["s"], F.col("s"), 120, "i").agg(F.max("i")).first()[0] == segments


@pytest.mark.parametrize("values,expected", [([1.2] * 20, 1.25), ([80.0, 90.0], 49.75), ([0.6, 1.2, 1.2, 40.0], 40.25)])
def test_histogram_midpoint(spark, values, expected):
    h = aggregates.histogram(spark.createDataFrame([("a", v) for v in values], "k string, x double"), ["k"], F.col("x"), 0.0, 0.5, 100)
    assert aggregates.histogram_quantiles(h, ["k"], {"p95": 0.95}, 0.0, 0.5, "midpoint_ceil").first().p95 == expected


def test_numbers_and_categories(spark):
    assert one(spark, S.number(F.lit(float("nan")))) is None
    assert one(spark, S.number(F.lit(float("inf")))) is None
    assert one(spark, S.parse_number(F.lit("x1"))) is None
    assert one(spark, S.ratio(F.lit(1), F.lit(0))) is None
    assert one(spark, S.category(F.lit(None))) == "__na__"
    assert abs(one(spark, cleaning.inverse_normal(F.lit(0.975))) - 1.959963985) < 1e-6
    assert one(spark, cleaning.inverse_normal(F.lit(0.0))) is None


def test_haversine_and_night(spark):
    assert abs(one(spark, S.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))) - 2 * math.pi * S.EARTH_M / 360) < 1e-6
    day = 86400
    assert one(spark, S.night_seconds(F.lit(22 * 3600), F.lit(day + 6 * 3600))) == 6 * 3600
    assert one(spark, S.night_seconds(F.lit(10 * 3600), F.lit(12 * 3600))) == 0
    assert one(spark, S.night_seconds(F.lit(0), F.lit(2 * day))) == 2 * 6 * 3600


def test_knots_and_bins(spark):
    k = [F.lit(x) for x in (1.0, 2.0, 4.0)]
    assert [one(spark, S.knots(F.lit(x), *k)) for x in (0.0, 0.5, 1.0, 1.5, 3.0, 9.0)] == [0.0, 0.25, 0.5, 0.625, 0.875, 1.0]
    assert one(spark, S.bin_index(F.lit(2.0), F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)))) == 2


def test_pool_adjacent():
    assert rules.pool_adjacent([1, 3, 2, 4], [1, 1, 1, 1]) == [1, 2.5, 2.5, 4]
    assert rules.pool_adjacent([3, 2, 1], [1, 1, 1]) == [2, 2, 2]


def test_cool_down_moves_with_the_kept_event(spark):
    df = spark.createDataFrame([("a", 0.0, 1.0), ("a", 20.0, 2.0), ("a", 45.0, 1.0), ("a", 80.0, 1.0)], "k string, s double, v double")
    assert [(r.s, r.v) for r in sessions.cool_down(df, ["k"], "s", "v", 30).orderBy("s").collect()] == [(20.0, 2.0), (80.0, 1.0)]


def test_auc_ties_and_single_class(spark):
    df = spark.createDataFrame([(0.5, 1), (0.5, 0), (0.9, 1), (0.1, 0)], "p double, y int")
    assert evaluation.auc(df, "p", "y").first().auc == (0.5 + 1 + 1 + 1) / 4
    assert evaluation.auc(df.filter("y = 1"), "p", "y").first().auc is None
    assert abs(evaluation.average_precision(df, "p", "y").first().average_precision - (0.5 * 1 + 0.5 * 2 / 3)) < 1e-12
    assert [r.r for r in df.select(average_rank("p").alias("r"), "p").orderBy("p").collect()] == [1.0, 2.5, 2.5, 4.0]


def test_left_one_refuses_repeats(spark):
    a = spark.createDataFrame([(1, "x")], "k int, v string")
    b = spark.createDataFrame([(1, "y"), (1, "z")], "k int, v string")
    with pytest.raises(joins.CardinalityError):
        joins.left_one(a, b, ["k"])
    assert joins.left_one(a, b.limit(1), ["k"]).columns == ["k", "v", "v_right"]


def test_nearest_in_time_without_match(spark):
    a = spark.createDataFrame([(1, 100), (1, 10_000)], "k int, s long")
    b = spark.createDataFrame([(1, 130, "later"), (1, 80, "before")], "k int, t long, v string")
    got = {r.s: r.v for r in joins.nearest_in_time(a, b, "k", "s", "t", 300, ["v"], ["v"]).collect()}
    assert got == {100: "before", 10_000: None}


def test_pairs_within_counts_without_pairs_of_rows(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate("aab")], "c int, i int, v string")
    assert {(r.a, r.b): r.pairs for r in joins.pairs_within(df, ["c"], "i", "v").collect()} == {("a", "a"): 1, ("a", "b"): 2}


def test_column_pruning(spark):
    df = spark.createDataFrame([(float(i), 1.0, float(i), float(i**3), float(-(i % 3))) for i in range(20)], "a double, c double, same double, cube double, other double")
    assert cleaning.informative(df, df.columns) == ["a", "same", "cube", "other"]
    assert cleaning.without_equal(df, ["a", "same", "cube"]) == ["a", "cube"]
    assert cleaning.prune_correlated(df, ["a", "cube", "other"]) == ["a", "other"]
    assert cleaning.select_by_quota({"score": list("ab"), "x": list("cd"), "y": list("e")}, "score", total=4) == ["a", "b", "c", "e"]


def test_hotspots_join_chains(spark):
    step = 150 / 111_000
    df = spark.createDataFrame([("v", i, 30 + i * step, 114.0) for i in range(5)] + [("v", 9, 31.0, 114.0), ("w", 10, 30.0, 114.0)], "k string, id long, la double, lo double")
    got = {r.id: r.cluster for r in trajectory.hotspots(df, "k", "id", "la", "lo").collect()}
    assert got == {i: 0 for i in range(5)}


def test_jump_and_valid_steps(spark):
    df = spark.createDataFrame([("v", 0, 30.0, 114.0, 5.0, 1), ("v", 60, 30.001, 114.0, 5.0, 2), ("v", 61, 31.0, 114.0, 5.0, 3), ("v", 61 + 10_801, 31.0, 114.0, 0.0, 4)], "k string, s long, la double, lo double, sp double, i int")
    s = trajectory.steps(df, "k", "s", "la", "lo", "sp", "i")
    assert [(r.jump, r.ok) for r in s.withColumn("ok", trajectory.valid_step()).orderBy("s").collect()] == [(False, False), (False, True), (True, False), (False, False)]


def test_sources(spark, tmp_path):
    assert files.column_list("a # first\n\nb\n") == ["a", "b"]
    with pytest.raises(files.ContractError):
        files.column_list('["a", "a"]')
    (tmp_path / "c.json").write_text('{"as_of": "2024-01-21", "lookback_days": 20, "paths": {}}')
    with pytest.raises(files.ContractError):
        files.load_config(str(tmp_path / "c.json"))
    df = spark.createDataFrame([("2", 0.5), ("1", 1.0)], "id string, p double")
    files.write_submission(df, str(tmp_path / "out"), "id", ["p"])
    part = next((tmp_path / "out").glob("part-*.csv"))
    assert part.read_bytes() == b"id,p\n1,1.000000\n2,0.500000\n"
    with pytest.raises(files.ContractError):
        files.require_unique(df.union(df), ["id"])
    assert '"rows": 2' in files.manifest(df, "id")


def test_bootstrap_draws_two_thousand(spark):
    rows = [(i, i % 2, (i * 7 % 20) / 20, (i * 3 % 20) / 20) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, y int, p double, p2 double")
    r = evaluation.paired_bootstrap_auc(df, "p", "p2", "y", "id").first()
    assert r.draws == 2000 and r.low < r.mean < r.high


def test_steady_sum_is_the_same_in_any_order(spark):
    values = [0.1, 0.7, 0.2, 1e6, 0.07 * 10, 0.3, -1e6, 0.6]
    orders = [values, values[::-1], sorted(values)]
    rows = [(i, v) for i, o in enumerate(orders) for v in o]
    got = {r.s for r in spark.createDataFrame(rows, "k int, v double").coalesce(1).groupBy("k").agg(aggregates.steady_sum(F.col("v")).alias("s")).collect()}
    assert got == {2.6000000000000001}
    odd = {"nan": [float("nan"), 1.0], "inf": [float("inf"), 1.0], "huge": [1e300, 1.0], "tiny": [1e-30, 1e-30], "null": [None], "mixed": [None, 0.1, 0.2], "zero": [0.0], "beyond": [1e15] * 8}
    df = spark.createDataFrame([(k, v) for k, vs in odd.items() for v in vs], "k string, v double")
    s = {r.k: r.s for r in df.groupBy("k").agg(aggregates.steady_sum(F.col("v")).alias("s")).collect()}
    assert math.isnan(s.pop("nan"))
    assert s == {"inf": float("inf"), "huge": 1e300, "tiny": 2e-30, "null": None, "mixed": 0.3, "zero": 0.0, "beyond": 8e15}
