"""Trajectory steps, driving spells, spatial statistics and hotspots."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import EARTH_M, haversine, night_seconds
from .nearest import nearest_sums
from .windows import islands

JUMP_M_PER_S, NEAR_M = 70.0, 50.0


def steps(df: DataFrame, key: str, seconds: str, lat: str, lon: str, speed: str, tie: str) -> DataFrame:
    """Each point with the step that leads to it: dt, metres, jump, stationary."""
    w = Window.partitionBy(key).orderBy(seconds, tie)
    before = lambda c: F.lag(c).over(w)
    out = df.withColumns({"dt": F.col(seconds) - before(seconds), "before_s": before(seconds), "__lat": before(lat), "__lon": before(lon)})
    out = out.withColumn("metres", haversine(F.col("__lat"), F.col("__lon"), F.col(lat), F.col(lon))).drop("__lat", "__lon")
    out = out.withColumn("jump", F.coalesce(F.col("metres") > JUMP_M_PER_S * F.col("dt"), F.lit(False)))
    still = ((F.col(speed) == 0) | (F.col("metres") < NEAR_M)) & ~F.col("jump") & F.col("dt").isNotNull()
    return out.withColumn("stationary", F.coalesce(still, F.lit(False)))


def sensor_days(df: DataFrame, key: str, time: str, gap_s: int = 300) -> DataFrame:
    """(key, day, rows, observed_s, first_s, last_s): of each day its rows, the seconds between rows less than ``gap_s`` apart, and its first and last
    second of the day. Rows without a time are left out; of one second's rows the gaps are 0."""
    at = F.unix_seconds(F.col(time).cast("timestamp"))
    t = df.filter(F.col(time).isNotNull()).select(key, F.to_date(time).alias("day"), at.alias("__s"))
    gap = F.col("__s") - F.lag("__s").over(Window.partitionBy(key, "day").orderBy("__s"))
    second = lambda c: F.pmod(c, F.lit(86_400))
    return t.withColumn("__g", gap).groupBy(key, "day").agg(
        F.count("*").alias("rows"), F.coalesce(F.sum(F.when(F.col("__g") < gap_s, F.col("__g"))), F.lit(0)).alias("observed_s"), second(F.min("__s")).alias("first_s"), second(F.max("__s")).alias("last_s"))


def valid_step(longest_s: int = 180 * 60) -> Column:
    return F.col("dt").isNotNull() & (F.col("dt") > 0) & (F.col("dt") <= longest_s) & F.col("metres").isNotNull() & ~F.col("jump")


def spells(stepped: DataFrame, key: str, seconds: str, tie: str, gap_s: int = 180 * 60, stop_s: int = 30 * 60) -> DataFrame:
    """Driving spells: cut at long gaps, jumps, and stationary runs that last ``stop_s`` or longer.

    Two passes of islands over one partitioning: runs of the stationary flag give the stops, and
    their ends, gaps and jumps give the spells.
    """
    w = Window.partitionBy(key).orderBy(seconds, tie)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    broken = F.col("dt").isNull() | (F.col("dt") > gap_s) | F.col("jump")
    a = stepped.withColumn("__run", F.sum(F.when((F.col("stationary") != F.lag("stationary").over(w)) | broken, 1).otherwise(0)).over(upto))
    r = Window.partitionBy(key, "__run")
    span = F.max(seconds).over(r) - F.min(F.when(F.col("stationary"), F.col("before_s"))).over(r)
    b = a.withColumn("__stop", F.col("stationary") & (span >= stop_s))
    c = b.withColumn("__cut", F.when(broken | F.col("__stop") | F.lag("__stop").over(w), 1).otherwise(0))
    d = c.withColumn("spell", F.sum("__cut").over(upto)).filter(~F.col("__stop"))
    return d.groupBy(key, "spell").agg(F.min(seconds).alias("start_s"), F.max(seconds).alias("end_s"), F.count("*").alias("points"))


def spell_features(s: DataFrame, key: str) -> DataFrame:
    hours = (F.col("end_s") - F.col("start_s")) / 3600
    return s.groupBy(key).agg(F.count("*").alias("spells"), F.max(hours).alias("longest_h"), F.avg((hours > 4).cast("double")).alias("share_over_4h"), (F.sum(night_seconds(F.col("start_s"), F.col("end_s"))) / 3600).alias("night_h"))


def activity_radius(df: DataFrame, key: str, lat: str, lon: str, least: int = 1) -> DataFrame:
    """Root mean square distance to the mean point."""
    mid = df.groupBy(key).agg(F.avg(lat).alias("__la"), F.avg(lon).alias("__lo"), F.count("*").alias("points"))
    d = haversine(F.col(lat), F.col(lon), F.col("__la"), F.col("__lo"))
    out = df.join(mid, key).groupBy(key).agg(F.first("points").alias("points"), F.sqrt(F.avg(d * d)).alias("radius_m"))
    return out.withColumn("radius_m", F.when(F.col("points") >= least, F.col("radius_m")))


def centroid_shift(df: DataFrame, key: str, lat: str, lon: str, night: Column) -> DataFrame:
    m = lambda c, cond: F.avg(F.when(cond, F.col(c)))
    g = df.groupBy(key).agg(m(lat, ~night).alias("a"), m(lon, ~night).alias("b"), m(lat, night).alias("c"), m(lon, night).alias("d"))
    return g.select(key, haversine(*map(F.col, "abcd")).alias("shift_m"))


def _row_cells(row: Column, metres: float) -> Column:
    """How many cells a grid row (a band of latitudes) has around the globe, each at least ``metres`` wide for
    points of this row and of those beside it; 1 near the poles."""
    size = metres / 111_000.0
    edge = F.least(F.greatest(F.abs((row - 1) * size), F.abs((row + 2) * size)), F.lit(90.0))
    # Points d apart at latitudes a, b differ in longitude by at most 2 asin(sin(d / 2R) / sqrt(cos a cos b)).
    x = math.sin(metres / (2 * EARTH_M)) / F.greatest(F.cos(F.radians(edge)), F.lit(1e-12))
    return F.when(x >= 1, 1).otherwise(F.greatest(F.floor(360.0 / F.degrees(2 * F.asin(F.least(x, F.lit(1.0)))) * (1 - 1e-9)), F.lit(1))).cast("long")


def _column(lon: Column, cells: Column) -> Column:
    return F.pmod(F.floor((lon + 180.0) / 360.0 * cells), cells).cast("long")


def hotspots(df: DataFrame, key: str, id_col: str, lat: str, lon: str, metres: float = 200.0) -> DataFrame:
    """Density clusters with min_samples 2, which are the connected parts of the graph of points within
    ``metres``: (key, id, cluster), the cluster by its least id; lone points are noise and left out.

    Points of a key at one place are one node. Neighbours meet by grid cell, whose width follows the latitude and
    which wraps at 180 degrees. Components come from repeated passing of the least label over the links, cut
    by a checkpoint each round, with pointer jumping.
    """
    raw = df.select(F.col(key).alias("pk"), F.col(id_col).alias("pid"), F.col(lat).cast("double").alias("la"), F.col(lon).cast("double").alias("lo"))
    place = raw.groupBy("pk", "la", "lo").agg(F.min("pid").alias("id"), F.count("*").alias("times"))
    size = metres / 111_000.0
    pts = place.withColumn("ci", F.floor(F.col("la") / size).cast("long")).withColumn("cj", _column(F.col("lo"), _row_cells(F.col("ci"), metres)))
    rows = pts.withColumn("ui", F.explode(F.array(*(F.col("ci") + i for i in (-1, 0, 1)))))
    width = _row_cells(F.col("ui"), metres)
    near = F.array_distinct(F.array(*(F.pmod(_column(F.col("lo"), width) + j, width) for j in (-1, 0, 1))))
    probe = rows.withColumn("uj", F.explode(near)).select(F.col("pk").alias("k"), F.col("id").alias("u"), F.col("la").alias("ua"), F.col("lo").alias("uo"), "ui", "uj")
    met = probe.join(pts, (F.col("k") == F.col("pk")) & (F.col("ui") == F.col("ci")) & (F.col("uj") == F.col("cj")) & (F.col("u") != F.col("id")))
    edges = met.filter(haversine(F.col("ua"), F.col("uo"), F.col("la"), F.col("lo")) <= metres).select("k", "u", F.col("id").alias("v")).distinct()
    # A place with several points is a cluster even if nothing is near it.
    edges = edges.unionByName(place.filter("times > 1").select(F.col("pk").alias("k"), F.col("id").alias("u"), F.col("id").alias("v")))
    edges = _checkpoint(edges)
    labels = _checkpoint(edges.groupBy("k", "u").agg(F.least(F.min("v"), F.col("u")).alias("label")))
    while True:
        other = labels.select(F.col("k"), F.col("u").alias("v"), F.col("label").alias("seen"))
        heard = edges.join(other, ["k", "v"]).groupBy("k", "u").agg(F.min("seen").alias("seen"))
        moved = labels.join(heard, ["k", "u"]).select("k", "u", "label", F.least("label", "seen").alias("new"))
        jump = labels.select(F.col("k"), F.col("u").alias("new"), F.col("label").alias("further"))
        nxt = _checkpoint(moved.join(jump, ["k", "new"], "left").select("k", "u", "label", F.least("new", F.coalesce("further", "new")).alias("new")))
        done = nxt.filter("label <> new").isEmpty()
        labels = nxt.select("k", "u", F.col("new").alias("label"))
        if done:
            ids = raw.join(place, ["pk", "la", "lo"]).select("pk", "pid", "id")
            return ids.join(labels, (F.col("pk") == F.col("k")) & (F.col("id") == F.col("u"))).select(F.col("pk").alias(key), F.col("pid").alias(id_col), F.col("label").alias("cluster"))


def _checkpoint(df: DataFrame) -> DataFrame:
    from ..sources.shared import checkpoint

    return checkpoint(df)


def route_repeat(df: DataFrame, key: str, day: str, id_col: str, lat: str, lon: str, pairs: int = 1 << 16, least_day: int = 1, least_total: int = 1) -> DataFrame:
    """Mean nearest-point distance between each day and the next with points, both ways.

    Days of fewer than ``least_day`` points don't count, nor do keys with fewer than ``least_total`` points on the days that do. Points of one
    place and day meet once. Two days of at most ``pairs`` pairs of places are compared whole, larger ones by blocks and boxes
    (``nearest.nearest_sums``), so that places far from all others are compared with few. Rows with a missing value are left out.
    """
    number = F.unix_date(day) if df.schema[day].dataType.typeName() == "date" else F.col(day)
    raw = df.select(F.col(key).alias("k"), number.cast("long").alias("d"), F.col(lat).cast("double").alias("la"), F.col(lon).cast("double").alias("lo")).dropna()
    place = _checkpoint(raw.groupBy("k", "d", "la", "lo").agg(F.count("*").alias("times")))
    days = place.groupBy("k", "d").agg(F.count("*").alias("__n"), F.sum("times").alias("__points")).filter(F.col("__points") >= least_day)
    keys = days.groupBy("k").agg(F.sum("__points").alias("__all")).filter(F.col("__all") >= least_total)
    days = days.join(keys.select("k"), "k").select("k", "d", "__n")
    sides = days.withColumn("other", F.explode(F.array(F.col("d") + 1, F.col("d") - 1))).join(days.select("k", F.col("d").alias("other"), F.col("__n").alias("__m")), ["k", "other"])
    sides = _checkpoint(sides)
    small = F.col("__n") * F.col("__m") <= pairs
    there = place.select("k", F.col("d").alias("other"), F.col("la").alias("la2"), F.col("lo").alias("lo2"))
    met = place.join(sides.filter(small).select("k", "d", "other"), ["k", "d"]).join(there, ["k", "other"])
    near = met.groupBy("k", "d", "other", "la", "lo", "times").agg(F.min(haversine(F.col("la"), F.col("lo"), F.col("la2"), F.col("lo2"))).alias("m"))
    every = near.groupBy("k").agg(F.sum(F.col("m") * F.col("times")).alias("metres"), F.sum("times").cast("double").alias("times"))
    if not (large := sides.filter(~small).select("k", "d", "other")).isEmpty():
        asked = large.select("k", "d").unionByName(large.select("k", F.col("other").alias("d"))).distinct()
        every = every.unionByName(nearest_sums(place.join(asked, ["k", "d"], "left_semi"), large))
    return every.groupBy(F.col("k").alias(key)).agg((F.sum("metres") / F.sum("times")).alias("repeat_m"))
