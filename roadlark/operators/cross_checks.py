"""Checks of one stream against another: sensors, trajectory and events of the same keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import nearest_in_time
from .windows import runs


def around(left: DataFrame, right: DataFrame, key: str, left_s: str, right_s: str, within_s: int, values: dict[str, tuple[Callable[[Column], Column], str]], cell_s: int = 3600) -> DataFrame:
    """``left`` with aggregates over its key's ``right`` rows at most ``within_s`` seconds away, before or after.

    ``values``: name -> (aggregate, column of ``right``); the aggregate passes over nulls. Both streams meet in
    one range window for each key and cell of time, to which right rows near its border are sent from both
    sides, so no task reads a key's whole history and no pairs are made. Left rows without key or time get an
    aggregate of nothing.
    """
    cell = max(cell_s, within_s)
    at = lambda s, d=0: F.floor((F.col(s) + d) / cell)
    known = F.col(key).isNotNull() & F.col(left_s).isNotNull()
    cols = list(dict.fromkeys(c for _, c in values.values()))
    kinds = {c: right.schema[c].dataType for c in cols}
    row = F.struct(*left.columns)
    a = left.filter(known).select(row.alias("__row"), F.col(key).alias("__key"), F.col(left_s).cast("long").alias("__s"), at(left_s).alias("__cell"), *(F.lit(None).cast(t).alias(f"__v_{c}") for c, t in kinds.items()))
    b = right.filter(F.col(key).isNotNull() & F.col(right_s).isNotNull()).select(F.lit(None).cast(left.select(row).schema[0].dataType).alias("__row"), F.col(key).alias("__key"), F.col(right_s).cast("long").alias("__s"), F.explode(F.sequence(at(right_s, -within_s), at(right_s, within_s))).alias("__cell"), *(F.col(c).alias(f"__v_{c}") for c in cols))
    w = Window.partitionBy("__key", "__cell").orderBy("__s").rangeBetween(-within_s, within_s)
    met = a.unionByName(b).withColumns({name: f(F.col(f"__v_{c}")).over(w) for name, (f, c) in values.items()}).filter("__row is not null")
    rest = left.filter(~known).select("*", *(F.lit(None).cast(met.schema[name].dataType).alias(name) for name in values))
    return met.select(*(F.col("__row")[c].alias(c) for c in left.columns), *values).unionByName(rest)


def persistent_conflicts(sensors: DataFrame, trajectory: DataFrame, key: str, s: str, sensor_speed: str, speed: str, moving: float = 20, still: float = 5, within_s: int = 60) -> DataFrame:
    """Sensor rows faster than ``moving`` while all trajectory points around, one at least, are slower than ``still``."""
    met = around(sensors.filter(F.col(sensor_speed) > moving), trajectory, key, s, s, within_s, {"fastest": (F.max, speed)})
    return met.filter(F.col("fastest") < still)


def lasting_differences(sensors: DataFrame, trajectory: DataFrame, key: str, s: str, sensor_speed: str, speed: str, tie: str, apart: float = 30, least_s: int = 30, within_s: int = 60) -> DataFrame:
    """(key, start_s, end_s, rows) of runs of sensor rows whose speed and that of the nearest trajectory point differ by more
    than ``apart`` for ``least_s`` or longer. A row without a point nearby ends a run."""
    other = trajectory.select(key, F.col(s).alias("__at"), F.col(speed).alias("__speed"))
    met = nearest_in_time(sensors.select(key, s, sensor_speed, tie), other, key, s, "__at", within_s, ["__speed"], ["__speed"])
    off = F.coalesce(F.abs(F.col(sensor_speed) - F.col("__speed")) > apart, F.lit(False))
    found = runs(met.withColumn("__off", off), [key], [s, tie], F.col("__off"), "__run").filter("__off")
    out = found.groupBy(key, "__run").agg(F.min(s).alias("start_s"), F.max(s).alias("end_s"), F.count("*").alias("rows"))
    return out.filter(F.col("end_s") - F.col("start_s") >= least_s).drop("__run")


def dead_windows(sensors: DataFrame, trajectory: DataFrame, key: str, s: str, total: str, turn: str, speed: str, window_s: int = 60, moving: float = 20, eps: float = 1e-6) -> DataFrame:
    """(key, window) in which all points are at ``moving`` or faster while acceleration norm and turn rate don't vary."""
    slot = F.floor(F.col(s) / window_s).alias("window")
    a = sensors.groupBy(key, slot).agg(F.count("*").alias("rows"), F.var_pop(total).alias("__a"), F.var_pop(turn).alias("__b")).filter((F.col("rows") >= 2) & (F.col("__a") <= eps) & (F.col("__b") <= eps))
    b = trajectory.groupBy(key, slot).agg(F.min(speed).alias("slowest")).filter(F.col("slowest") >= moving)
    return a.join(b, [key, "window"]).select(key, "window", "rows", "slowest")


def coordinate_conflicts(events: DataFrame, trajectory: DataFrame, key: str, s: str, lat: str, lon: str, within_s: int = 300) -> DataFrame:
    """``events`` with ``xtype_coord_flag``: outside the box of the key's points, without a point nearby in time, or null."""
    box = trajectory.groupBy(F.col(key).alias("__key")).agg(F.min(lat).alias("__a"), F.max(lat).alias("__b"), F.min(lon).alias("__c"), F.max(lon).alias("__d"))
    near = around(events, trajectory, key, s, s, within_s, {"__near": (F.count, s)})
    outside = ~(F.col(lat).between(F.col("__a"), F.col("__b")) & F.col(lon).between(F.col("__c"), F.col("__d")))
    flag = F.when(F.coalesce(F.col("__near"), F.lit(0)) == 0, "no_point").when(outside, "outside_box")
    return near.join(box, F.col(key) == F.col("__key"), "left").withColumn("xtype_coord_flag", flag).select(*events.columns, "xtype_coord_flag")


def motion_conflicts(events: DataFrame, trajectory: DataFrame, key: str, s: str, driving: Column, parked: Column, speed: str, distance: str, within_s: int = 300, still: float = 5, moving: float = 10) -> DataFrame:
    """``events`` with ``xtype_motion_flag``, by the nearest point: driving events at rest, parking events on the move."""
    other = trajectory.select(F.col(key), F.col(s).alias("__at"), F.col(speed).alias("__speed"), F.col(distance).alias("__distance"))
    met = nearest_in_time(events, other, key, s, "__at", within_s, ["__speed", "__distance"], ["__speed", "__distance"])
    flag = F.when(driving & (F.col("__speed") < still) & (F.col("__distance") == 0), "driving_event_at_rest").when(parked & (F.col("__speed") > moving), "parking_event_moving")
    return met.withColumn("xtype_motion_flag", flag).select(*events.columns, "xtype_motion_flag")


def uncovered_days(trajectory: DataFrame, sensors: DataFrame, key: str, day: Column, speed: str) -> DataFrame:
    """(key, day) with driving in the trajectory and no sensor row; coverage, not an error."""
    drove = trajectory.filter(F.col(speed) > 0).select(key, day.alias("day")).distinct()
    return drove.join(sensors.select(key, day.alias("day")).distinct(), [key, "day"], "left_anti")
