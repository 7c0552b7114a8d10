"""Event extraction, chains and risk segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scans import scan_by_key
from .windows import islands


def chains(df: DataFrame, by: list[str], order: list[str], seconds: Column, gap_s: int, least: int = 2) -> DataFrame:
    """One row for each chain of at least ``least`` events: start, end, events."""
    return (islands(df, by, order, seconds, gap_s, "chain").groupBy(*by, "chain")
            .agg(F.count("*").alias("events"), F.min(seconds).alias("start_s"), F.max(seconds).alias("end_s")).filter(F.col("events") >= least))


def peak_events(df: DataFrame, by: list[str], seconds: str, value: str, gap_s: float = 2) -> DataFrame:
    """Runs whose rows are at most ``gap_s`` apart, with duration and the row of the largest |value| (the first of equals)."""
    w = islands(df, by, [seconds, value], F.col(seconds), F.lit(gap_s), "event")
    peak = F.max_by(F.struct(seconds, value), F.struct(F.abs(value), -F.col(seconds)))
    return w.groupBy(*by, "event").agg(F.min(seconds).alias("start_s"), (F.max(seconds) - F.min(seconds)).alias("duration_s"), F.count("*").alias("rows"), peak.alias("__p")).select(
        *by, "event", "start_s", "duration_s", "rows", F.col(f"__p.{seconds}").alias("peak_s"), F.col(f"__p.{value}").alias("peak"))


def cool_down(df: DataFrame, by: list[str], seconds: str, value: str, wait_s: float = 30) -> DataFrame:
    """Of events within ``wait_s`` of the last kept one only the larger |value| stays.

    A larger event replaces the kept one and moves the clock, so the scan is sequential within a
    key: sorted partitions are read once with one kept row of state, never a whole group. A null key is a
    key, a null value counts as 0, and rows without a time stay as they are.
    """
    src = df.select(*by, seconds, value)

    def step(state: list, row: tuple) -> list[tuple]:
        at, v = row[-2], row[-1]
        kept = state[0]
        if kept is None or at - kept[-2] > wait_s:
            state[0] = row
            return [kept] if kept is not None else []
        if abs(v or 0) > abs(kept[-1] or 0):
            state[0] = row
        return []

    schema = ", ".join(f"`{c}` {kind}" for c, kind in src.dtypes)
    timed = src.filter(F.col(seconds).isNotNull())
    kept = scan_by_key(timed, by, [seconds, value], lambda row: [None], step, schema, lambda state: [state[0]])
    return kept.unionByName(src.filter(F.col(seconds).isNull()))


def risk_segments(df: DataFrame, contract: DataFrame, by: str, code: str, ts: Column, severity: str, order: str) -> DataFrame:
    """Events joined with their code's chain and merge window; per (key, chain) a gap over the window
    starts a segment. Representative: the largest severity, the earliest of equals."""
    # The contract has one row for each event code: a fixed vocabulary.
    src = df.join(F.broadcast(contract), code).filter("role <> 'outcome'").withColumn("__s", F.unix_seconds(ts.cast("timestamp")))
    seg = islands(src, [by, "chain"], ["__s", order], F.col("__s"), F.col("merge_s"), "segment")
    return seg.groupBy(by, "chain", "segment").agg(
        F.min("__s").alias("start_s"), F.max("__s").alias("end_s"), F.count("*").alias("events"),
        F.max_by(code, F.struct(F.col(severity), -F.col("__s"), -F.col(order))).alias("representative"),
        F.array_sort(F.collect_set(code)).alias("merged_codes"))


def transitions(df: DataFrame, by: str, order: list[str], kind: str) -> DataFrame:
    prev = F.lag(kind).over(Window.partitionBy(by).orderBy(*order))
    return df.withColumn("previous", prev).filter("previous is not null").groupBy(by, "previous", F.col(kind).alias("next")).agg(F.count("*").alias("n"))


def driving_scenarios(df: DataFrame, forward: Column, lateral: Column, vertical: Column, gyro: Column, speed: Column, thresholds: dict[str, float], keep: list[str]) -> DataFrame:
    """Long form of the six scenarios of an aligned sensor row; a row may show several."""
    t = thresholds
    moving = speed >= 10
    turning = (F.abs(gyro) > t["gyro"]) & (F.abs(lateral) > t["lateral"])
    found = [
        ("accel", moving & (forward > t["accel"]), forward),
        ("brake", moving & (forward < t["brake"]), forward),
        ("turn", moving & turning & (lateral * gyro > 0), lateral),
        ("sway", moving & turning & (lateral * gyro < 0), lateral),
        ("collision", F.sqrt(forward * forward + lateral * lateral) > t["collision"], F.sqrt(forward * forward + lateral * lateral)),
        ("rollover", F.abs(vertical) < t["rollover"], vertical),
    ]
    each = F.array(*(F.when(c, F.struct(F.lit(n).alias("scenario"), v.alias("value"))) for n, c, v in found))
    return df.select(*keep, F.inline(F.filter(each, lambda x: x.isNotNull())))
