"""Column functions: time, geometry, probability, text keys. All built-in expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
#: Day parts as (name, first hour, hour after the last); three definitions are in use.
BANDS = {
    "official": [("morning", 6, 9), ("day", 9, 18), ("dusk", 18, 21)],
    "research": [("am_peak", 7, 9), ("day", 9, 17)],
    "wide": [("am_peak", 7, 10)],
}
#: The band of all other hours, and the night of each definition.
NIGHT = {"official": (21, 6), "research": (23, 5), "wide": (22, 5)}


def number(c: Column) -> Column:
    """NaN and infinities as null: missing is null everywhere in the library."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < float("inf")), d)


def parse_number(text: Column) -> Column:
    return number(text.try_cast("double"))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or either is null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def clip(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def epoch_seconds(ts: Column) -> Column:
    return F.unix_seconds(ts.cast("timestamp"))


def hour_of_day(ts: Column, offset_s: int = 0) -> Column:
    """Hour of the day after a shift by ``offset_s``; -1 where there is no time."""
    return F.coalesce(F.pmod(F.floor((epoch_seconds(ts) + offset_s) / 3600), F.lit(24)).cast("int"), F.lit(-1))


def day_index(ts: Column, offset_s: int = 0) -> Column:
    return F.floor((epoch_seconds(ts) + offset_s) / 86400)


def date_int(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd").cast("int")


def is_night(hour: Column, scheme: str) -> Column:
    start, end = NIGHT[scheme]
    return (hour >= start) | ((hour < end) & (hour >= 0))


def time_band(ts: Column, scheme: str = "official", offset_s: int = 0) -> Column:
    hour = hour_of_day(ts, offset_s)
    out = F.when(hour < 0, F.lit(None)).when(is_night(hour, scheme), "night")
    for name, a, b in BANDS[scheme]:
        out = out.when((hour >= a) & (hour < b), name)
    return out.otherwise("other")


def night_seconds(start: Column, end: Column, first: int = 23, last: int = 5) -> Column:
    """Seconds of [start, end) (epoch seconds) between hour ``first`` and hour ``last`` of the next day."""
    days = F.sequence(F.floor(start / 86400) - 1, F.greatest(F.floor(start / 86400) - 1, F.floor(end / 86400)))
    part = F.transform(days, lambda d: F.greatest(F.lit(0), F.least(end, (d + 1) * 86400 + last * 3600) - F.greatest(start, d * 86400 + first * 3600)))
    return F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a + x)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def norm(*xs: Column) -> Column:
    return F.sqrt(reduce(lambda a, b: a + b, [x * x for x in xs]))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def tilt_degrees(axis: Column, total: Column) -> Column:
    return F.degrees(F.acos(clip(ratio(axis, total), -1.0, 1.0)))


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = clip(p, eps, 1 - eps)
    return F.log(q / (1 - q))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def knots(r: Column, k50: Column, k75: Column, k95: Column) -> Column:
    """Piecewise linear through (0, 0), (k50, .5), (k75, .75), (k95, 1); 1 above, 0 at or below 0."""
    between = lambda lo, hi, a, b: a + (b - a) * F.coalesce(ratio(r - lo, hi - lo), F.lit(1.0))
    zero = F.lit(0.0)
    return (F.when(r <= 0, 0.0).when(r <= k50, between(zero, k50, 0.0, 0.5)).when(r <= k75, between(k50, k75, 0.5, 0.75))
            .when(r <= k95, between(k75, k95, 0.75, 1.0)).when(r.isNotNull(), 1.0))


def bin_index(x: Column, edges: Column) -> Column:
    """How many edges are at most x."""
    return F.size(F.filter(edges, lambda e: e <= x))


def sorted_pair(prefix: str, a: Column, b: Column) -> Column:
    return F.concat(F.lit(prefix), F.least(a, b), F.lit("__"), F.greatest(a, b))


def sha_key(id_col: Column, seed: int = 42) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), id_col.cast("string")).cast("binary"), 256)


def sha_bucket(id_col: Column, n: int, seed: int = 42) -> Column:
    """The first 8 bytes of the key's SHA-256, big endian, modulo n."""
    return (F.conv(F.substring(sha_key(id_col, seed), 1, 16), 16, 10).cast("decimal(20,0)") % n).cast("int")


def smoothed_lift(recent: Column, all_: Column, share: float, k: float = 0.5) -> Column:
    """(recent + k) over (all scaled to the recent part + k)."""
    return (recent + k) / (all_ * share + k)


def safety_score(p: Column) -> Column:
    return 100 * (1 - p)


def blend(a: Column, b: Column, alpha: float) -> Column:
    return alpha * a + (1 - alpha) * b


def category(c: Column, missing: str = "__na__") -> Column:
    return F.coalesce(c.cast("string"), F.lit(missing))
