"""Protocol checks over tables: nulls, empty tables and faults of every kind."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from roadlark.operators import cleaning, protocol, windows

D = datetime.date


def test_visibility_and_evidence_of_real_rows(spark):
    ev = spark.createDataFrame([("a", "2024-01-05 10:00:00"), ("a", "2024-01-10 00:00:00"), ("b", None), ("c", "2024-01-09 23:59:59")], "k string, t string").withColumn("ts", F.col("t").cast("timestamp_ntz"))
    got = {r.column: (r.until, r.visible) for r in protocol.data_visibility({"all": (ev, "ts", ["x"]), "c": (ev.filter("k = 'c'"), "ts", ["y", "z"]), "null": (ev.filter("k = 'b'"), "ts", ["w"]), "none": (ev.limit(0), "ts", ["v"])}, "2024-01-10").collect()}
    assert got == {"x": (D(2024, 1, 10), False), "y": (D(2024, 1, 9), True), "z": (D(2024, 1, 9), True), "w": (None, False), "v": (None, False)}
    k = F.col("k")
    rows = {r.column: (r.rows, r.error) for r in protocol.window_evidence(ev, "ts", {"good": k == "c", "late": k == "a", "bare": k == "b", "Label_x": k == "c", "gone": k == "q", "odd": F.lit(None).cast("boolean")}, "2024-01-10").collect()}
    assert rows == {"good": (1, None), "late": (2, "a row from the label's time"), "bare": (1, "a row without a time"), "Label_x": (1, "named like a label"), "gone": (0, "made of nothing"), "odd": (0, "made of nothing")}


def test_faults_of_manifests(spark):
    good = {"feature_from": D(2024, 1, 1), "feature_to": D(2024, 1, 21), "as_of": D(2024, 1, 21), "label_from": D(2024, 1, 21), "label_to": D(2024, 1, 31), "label_version": "l", "split_version": "s", "target_count": 5, "label_used_in_features": False, "test_used_in_fit": None}
    changes = [{}, {"feature_to": D(2024, 1, 22)}, {"feature_from": None}, {"label_from": D(2024, 1, 20)}, {"label_version": " "}, {"split_version": None}, {"target_count": 0}, {"label_used_in_features": True}, {"test_used_in_fit": True}]
    schema = "feature_from date, feature_to date, as_of date, label_from date, label_to date, label_version string, split_version string, target_count long, label_used_in_features boolean, test_used_in_fit boolean"
    df = spark.createDataFrame([tuple((good | c).values()) for c in changes], schema)
    assert {r.rule: r.violations for r in protocol.manifest_faults(df).collect()} == {"feature window before as_of": 2, "label window after as_of": 1, "label version": 1, "split version": 1, "target count": 1, "no label in features": 1, "no test in the fit": 1}
    assert {r.violations for r in protocol.manifest_faults(df.limit(0)).collect()} == {0}


def test_synthetic_rows_keep_the_distribution(spark):
    df = spark.range(2000).selectExpr("id", "cast(id % 97 as double) x", "cast(null as double) none")
    made = protocol.synthetic_like(df.repartition(5), "id", ["x", "none"])
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, protocol.synthetic_like(df, "id", ["x", "none"]).collect()))
    mean, low, high, n, none = made.agg(F.avg("x"), F.min("x"), F.max("x"), F.count("*"), F.count("none")).first()
    assert n == 2000 and none == 0 and mean == pytest.approx(48, abs=2) and low >= 0 and high <= 96


def test_counts_below_and_shares(spark):
    rows = [("a", 1.0), ("a", 1.0), ("a", 3.0), ("b", 5.0), ("a", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {(r.k, r.v): (r["__n"], r["__below"], r["__all"]) for r in windows.counts_below(df, ["k"], "v").collect()}
    assert got == {("a", None): (1, 0, 4), ("a", 1.0): (2, 1, 4), ("a", 3.0): (1, 3, 4), ("b", 5.0): (1, 0, 1)}
    assert sorted((r.k, r.v, round(r.s, 9)) for r in windows.with_share_below(df.dropna(), ["k"], "v", "s").collect()) == [("a", 1.0, 0.0), ("a", 1.0, 0.0), ("a", 3.0, 1.0), ("b", 5.0, 0.0)]


def test_medians_fill_missing_values(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("a", None, 2.0), (None, 5.0, 6.0), (None, None, None), ("b", None, None)], "k string, x double, y double")
    got = sorted(map(tuple, cleaning.fill_median_in_box(df, "k", "x", "y", (0, 10, 0, 10)).select("k", "x", "y").collect()), key=repr)
    assert got == sorted([("a", 1.0, 2.0), ("a", 1.0, 2.0), (None, 5.0, 6.0), (None, None, None), ("b", None, None)], key=repr)
    out = cleaning.impute(df, df, ["x"], ["k"]).select("k", "x").collect()
    assert sorted(map(tuple, out)) == [("a", 1.0), ("a", 3.0), ("a", 3.0), ("a", 5.0), ("b", 3.0)]
