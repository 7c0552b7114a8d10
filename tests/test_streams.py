"""The streaming score against the score of a table."""

from __future__ import annotations

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from roadlark.operators import dynamics
from roadlark.streaming import events as streams
from roadlark.streaming import history


@pytest.fixture
def store(spark):
    held = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    yield history.with_state_store(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", held)


def scores(spark, files, starts, path, lateness, **more):
    for k, rows in enumerate(files):
        df = spark.createDataFrame(rows, "user_id long, ts string, exposure double, event_id long, points double, status string")
        df.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(f"{path}/{k:03d}")
    s = spark.readStream.schema(history.SCHEMA).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(path)
    return streams.run(history.score_stream(s, starts, dynamics.Policy(), lateness, **more), "append")


def test_files_in_any_order_give_the_scores_of_the_table(store, tmp_path):
    spark, rng = store, random.Random(4)
    users, big = [1, 2, 9007199254740993], 9007199254740993
    days = [(u, f"2024-01-{d:02d}", 0.0 if rng.random() < 0.3 else float(rng.randint(1, 20))) for u in users for d in range(1, 21)]
    open_ = [x for x in days if x[2]]
    evidence = [(u, f"{day} {rng.randint(0, 23):02d}:30:00", i + (big if i == 3 else 0), float(rng.randint(1, 9)), rng.choice(["valid", "valid", "pending", "exempt"])) for i, (u, day, _) in enumerate(open_) if rng.random() < 0.6]
    rows = [(u, f"{d} 00:00:00", x, None, None, None) for u, d, x in days] + [(u, t, None, i, p, s) for u, t, i, p, s in evidence]
    rng.shuffle(rows)
    rows += [(None, "2024-01-02 00:00:00", 1.0, None, None, None), (1, "2024-01-05 00:00:00", 0.0, None, None, None)]
    files = [rows[k::4] for k in range(4)] + [[(77, f"2024-05-0{k} 00:00:00", 1.0, None, None, None)] for k in (1, 2)] + [[(1, "2024-01-04 00:00:00", 500.0, None, None, None)]]
    starts = spark.createDataFrame([(1, 90.0, True), (2, 70.0, False), (big, 85.0, True)], "user_id long, initial double, previous_valid boolean")
    got = {(r.user_id, str(r.day)): (round(r.score, 9), round(r.ewma, 9), round(r.multiplier, 9), r.status) for r in scores(spark, files, starts, str(tmp_path), "40 days").collect()}
    d = spark.createDataFrame(days, "user_id long, day string, exposure double").withColumn("day", F.to_date("day"))
    e = spark.createDataFrame(evidence, "user_id long, ts string, event_id long, points double, status string").withColumn("ts", F.col("ts").cast("timestamp"))
    want = dynamics.score_history(starts, d, e, "user_id", "2024-02-10")
    assert got == {(r.user_id, str(r.day)): (round(r.score, 9), round(r.ewma, 9), round(r.multiplier, 9), r.status) for r in want.collect()}
    assert len(got) == 60


def test_first_decisions_late_rows_and_forgotten_keys(store, tmp_path):
    spark = store
    day = lambda u, t, x: (u, f"{t} 00:00:00", x, None, None, None)
    files = [
        [day(1, "2024-01-01", 10.0), (1, "2024-01-01 12:00:00", None, 5, 4.0, "pending"), (1, "2024-01-01 12:00:00", None, 6, 4.0, "valid")],
        [(1, "2024-01-01 12:00:00", None, 5, 4.0, "exempt"), (1, "2024-01-01 12:00:00", None, 6, 4.0, "exempt")],
        [day(8, "2024-01-20", 1.0)],
        [day(8, "2024-01-21", 1.0)],
        [(1, "2024-01-01 13:00:00", None, 7, 50.0, "valid"), day(8, "2024-06-01", 1.0)],
        [day(1, "2024-06-02", 5.0), day(8, "2024-07-01", 1.0)],
        [day(8, "2024-08-01", 1.0)],
    ]
    starts = spark.createDataFrame([(1, 90.0, True)], "user_id long, initial double, previous_valid boolean")
    got = [r for r in scores(spark, files, starts, str(tmp_path), "1 day", idle_days=30).orderBy("day").collect() if r.user_id == 1]
    assert [(str(r.day), r.base) for r in got] == [("2024-01-01", 4.0), ("2024-06-02", 0.0)]
    trust = 10 / 20
    assert got[0].score == pytest.approx(min(trust * (90 - 4) + (1 - trust) * 80, 90))
    assert got[1].score == pytest.approx(80.0) and got[1].status == "observed"  # begun anew, at the prior


def test_evidence_of_one_bucket_and_of_many(spark, tmp_path):
    at = lambda d, h=0: f"2024-01-{d:02d} {h:02d}:00:00"
    files = [
        [(1, at(1), "valid"), (2, at(1), "pending"), (3, at(1), "pending"), (4, at(1), "exempt"), (None, at(1, 1), "pending"), (9007199254740993, at(1), "pending")],
        [(2, at(1, 2), "exempt"), (1, at(1, 2), "exempt"), (9007199254740993, at(2), "valid")],
        [(7, at(9), "pending"), (None, at(9), "pending")],
        [(3, at(9), "exempt"), (7, at(9), "pending")],
        [(8, at(20), "valid"), (3, at(10), "valid")],
        [(8, at(21), "exempt")],
    ]
    for k, rows in enumerate(files):
        df = spark.createDataFrame(rows, "event_id long, ts string, status string")
        df.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(f"{tmp_path}/{k:03d}")
    late, found = "auto_valid_after_deadline", []
    for buckets in (1, 4096):
        s = spark.readStream.schema("event_id long, ts timestamp, status string").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
        got = [(r.event_id or 0, r.resolved, r.included) for r in streams.run(streams.evidence(s, buckets=buckets), "update").collect()]
        want = [(0, late, True), (1, "valid", True), (2, "exempt", False), (3, late, True), (4, "exempt", False), (7, late, True), (8, "valid", True), (9007199254740993, "valid", True)]
        assert sorted(set(got)) == want
        found.append(sorted(got))
    assert found[0] == found[1]


def test_one_timer_for_the_open_days_of_a_key():
    class Held:
        value = None

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

    class Handle:
        def __init__(self):
            self.timers, self.state = [], Held()

        def getValueState(self, *_):  # noqa: N802
            return self.state

        def registerTimer(self, at):  # noqa: N802
            self.timers.append(at // history.DAY_MS)

    class At:
        def __init__(self, day):
            self.day = day

        def getExpiryTimeInMs(self):  # noqa: N802
            return self.day * history.DAY_MS

        getCurrentWatermarkInMs = getExpiryTimeInMs

    p, handle = history.DailyScore(dynamics.Policy(), 365), Handle()
    wait = p.policy.pending_days
    p.init(handle)
    rows = lambda days: iter([pd.DataFrame({"day": days, "exposure": 1.0, "event_id": "", "adjusted": 0.0, "status": "valid"})])
    p.handleInputRows((1,), rows(list(range(10, 40))), None)
    assert handle.timers == [10 + wait]
    p.handleInputRows((1,), rows([8, 41]), None)
    assert handle.timers == [10 + wait, 8 + wait]
    out = list(p.handleExpiredTimer((1,), At(20 + wait), At(8 + wait)))
    assert len(out[0]) == 12 and handle.timers[2:] == [21 + wait]
    assert list(p.handleExpiredTimer((1,), At(20 + wait), At(10 + wait))) == [] and len(handle.timers) == 3
    assert len(list(p.handleExpiredTimer((1,), At(90), At(21 + wait)))[0]) == 20 and handle.timers[3:] == [41 + 365]
