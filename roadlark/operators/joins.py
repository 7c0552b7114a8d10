"""Joins with checks: cardinality, intervals, nearest in time, lookups, key sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class CardinalityError(ValueError):
    """A key that must be unique repeats."""


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).count().filter("count > 1")


def left_one(left: DataFrame, right: DataFrame, on: list[str], suffix: str = "_right") -> DataFrame:
    """Left join whose right keys must be unique; clashing columns get a suffix."""
    if not repeated_keys(right, on).isEmpty():
        raise CardinalityError(f"{on} repeat on the right")
    clash = [c for c in right.columns if c in left.columns and c not in on]
    return left.join(right.withColumnsRenamed({c: c + suffix for c in clash}), on, "left")


def interval_join(rows: DataFrame, spans: DataFrame, key: str, at: Column, start: Column, end: Column) -> DataFrame:
    """Rows with the spans [start, end) of their key: an equi-join with the range as a residual."""
    return rows.join(spans, (rows[key] == spans[key]) & (at >= start) & (at < end)).drop(spans[key])


def nearest_in_time(left: DataFrame, right: DataFrame, key: str, left_s: str, right_s: str, within_s: int, values: list[str], tie: list[str]) -> DataFrame:
    """Each left row with the right row of its key nearest in time, within ``within_s`` seconds.

    Times meet by cell: each left row looks into its own cell and both neighbours, so the join is on
    equality whatever the length of a key's history. Equal left rows meet once and stay as many as they were.
    """
    rows = left.groupBy(*left.columns).agg(F.count("*").alias("__times"))
    src = rows.withColumn("__cell", F.explode(F.array(*(F.floor(F.col(left_s) / within_s) + d for d in (-1, 0, 1)))))
    other = right.select(F.col(key).alias("__key"), F.floor(F.col(right_s) / within_s).alias("__rcell"), F.col(right_s).alias("__at"), *(F.col(c).alias(f"__v_{c}") for c in dict.fromkeys([*values, *tie])))
    apart = F.abs(F.col(left_s) - F.col("__at"))
    met = src.join(other, (F.col(key) == F.col("__key")) & (F.col("__cell") == F.col("__rcell")) & (apart <= within_s), "left")
    best = F.min_by(F.when(F.col("__at").isNotNull(), F.struct(F.col("__at").alias("at"), *(F.col(f"__v_{c}").alias(c) for c in values))), F.struct(F.col("__at").isNull(), apart, "__at", *(F.col(f"__v_{c}") for c in tie)))
    out = met.groupBy(*left.columns, "__times").agg(best.alias("__best")).withColumn("__time", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__times"))))
    return out.select(*left.columns, F.col("__best.at").alias("nearest_s"), *(F.col(f"__best.{c}").alias(c) for c in values))


def lookup(df: DataFrame, table: DataFrame, key: str, value: str, missing) -> DataFrame:
    return df.join(table.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(missing)))


def on_roster(roster: DataFrame, facts: DataFrame, key: str, zero: list[str], eligible: Column | None = None) -> DataFrame:
    """One row for each of the roster; missing counts are 0, or null where not eligible."""
    out = roster.join(facts, key, "left")
    fill = lambda c: F.coalesce(F.col(c), F.lit(0)) if eligible is None else F.when(eligible, F.coalesce(F.col(c), F.lit(0)))
    return out.withColumns({c: fill(c) for c in zero})


def key_differences(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has."""
    left = a.select(key).distinct().join(b.select(key), key, "left_anti").withColumn("side", F.lit("left"))
    return left.unionByName(b.select(key).distinct().join(a.select(key), key, "left_anti").withColumn("side", F.lit("right")))


def pairs_within(df: DataFrame, by: list[str], position: str, value: str) -> DataFrame:
    """Unordered pairs of different positions within a group, as counts of value pairs."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("n"))
    other = counts.select(*by, F.col(value).alias("b"), F.col("n").alias("m"))
    met = counts.withColumnRenamed(value, "a").join(other, by).filter("a <= b")
    return met.withColumn("pairs", F.when(F.col("a") == F.col("b"), F.col("n") * (F.col("n") - 1) / 2).otherwise(F.col("n") * F.col("m")).cast("long")).filter("pairs > 0").select(*by, "a", "b", "pairs")


def top_rows(df: DataFrame, by: list[str], order: list[Column], k: int | Column) -> DataFrame:
    """The first k rows of each group in an order, with ``rank`` from 1. Without groups each task keeps its own first k, and only those meet."""
    if not by and isinstance(k, int):
        df = df.orderBy(*order).limit(k)
    w = Window.partitionBy(*by).orderBy(*order) if by else Window.orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
