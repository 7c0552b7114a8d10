"""Cleaning rules, flags, quarantine, imputation and column selection."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import number


def coalesce_sources(*cols: str) -> Column:
    """The first source with a finite value."""
    return F.coalesce(*(number(F.col(c)) for c in cols))


def speed_rules(speed: Column) -> tuple[Column, Column]:
    """(cleaned speed, flag): below 0 or over 200 is null and 'invalid', 160 to 200 'high'."""
    bad = (speed < 0) | (speed > 200)
    return F.when(~bad, speed), F.when(speed.isNull(), "missing").when(bad, "invalid").when(speed >= 160, "high").otherwise("ok")


def coordinate_rules(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    """(lat, lon, flag): missing, 0/0 and out of range are null."""
    flag = (F.when(lat.isNull() | lon.isNull(), "missing").when((lat == 0) & (lon == 0), "zero")
            .when((F.abs(lat) > 90) | (F.abs(lon) > 180), "range").otherwise("ok"))
    return F.when(flag == "ok", lat), F.when(flag == "ok", lon), flag


def motion_rules(heading: Column, speed: Column, run_seconds: Column) -> Column:
    """Trajectory flags, joined by ';': heading outside [0, 360), moving with no run time."""
    return F.concat_ws(";", F.when((heading < 0) | (heading >= 360), "heading"), F.when((speed > 5) & (run_seconds == 0), "run_contradiction"))


def sensor_rules(total: Column, stamp: Column, date: Column) -> Column:
    """Inertial flags: acceleration norm under 0.1 or over 5 g, row date unlike the time's date."""
    return F.concat_ws(";", F.when((total < 0.1) | (total > 5), "norm"), F.when(F.to_date(stamp) != date, "date"))


#: Flags of the cleaning rules.
SPEED_FLAGS = ("missing", "negative_invalid", "impossible_gt200", "suspicious_gt160")
COORD_FLAGS = ("missing", "zero_placeholder", "out_of_range")


def speed_flag(speed: Column) -> Column:
    """Null for a good speed; NaN is missing, 160 to 200 suspicious (and kept)."""
    missing, negative, impossible, suspicious = SPEED_FLAGS
    v = number(speed)
    return F.when(v.isNull(), missing).when(v < 0, negative).when(v > 200, impossible).when(v >= 160, suspicious)


def coord_flag(lat: Column, lon: Column) -> Column:
    """Null for a good point."""
    missing, zero, outside = COORD_FLAGS
    a, o = number(lat), number(lon)
    return F.when(a.isNull() | o.isNull(), missing).when((a == 0) & (o == 0), zero).when((F.abs(a) > 90) | (F.abs(o) > 180), outside)


def _cleaned(df: DataFrame, lat: str, lon: str, speeds: dict[str, str]) -> DataFrame:
    """Coordinates and speeds that the flags refuse become null; ``speeds`` maps a speed to its flag's name."""
    keep = (*SPEED_FLAGS[:1], SPEED_FLAGS[3])
    out = df.withColumn("coord_flag", coord_flag(F.col(lat), F.col(lon)))
    out = out.withColumns({flag: speed_flag(F.col(c)) for c, flag in speeds.items()})
    good = F.col("coord_flag").isNull()
    valid = {c: F.when(F.col(flag).isNull() | F.col(flag).isin(*keep), number(F.col(c))) for c, flag in speeds.items()}
    return out.withColumns({lat: F.when(good, F.col(lat)), lon: F.when(good, F.col(lon)), **valid})


def clean_events(df: DataFrame, time: str, start: str, end: str, lat: str, lon: str, speed: str, key: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(table, quarantine) by the event rules. Rows outside [start, end) or without a time, and all but one of equal rows, are
    quarantined with a ``reason``. Speeds and coordinates are cleaned and flagged. With ``key``, placeholders and
    points out of range become the medians of the key's good points, missing ones stay null.

    Equal rows are counted, not gathered, so one row that makes up much of a table costs one task nothing.
    """
    inside = F.coalesce((F.col(time) >= F.lit(start).cast("timestamp_ntz")) & (F.col(time) < F.lit(end).cast("timestamp_ntz")), F.lit(False))
    counted = df.groupBy(*df.columns).agg(F.count("*").alias("__n"))
    late = counted.filter(~inside).withColumn("reason", F.lit("out_of_window"))
    again = counted.filter(inside & (F.col("__n") > 1)).withColumn("reason", F.lit("exact_duplicate")).withColumn("__n", F.col("__n") - 1)
    out = late.unionByName(again).withColumn("__n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n")))).drop("__n")
    table = _cleaned(counted.filter(inside).drop("__n"), lat, lon, {speed: "speed_flag"})
    if key:
        mid = key_medians(table, key, lat, lon)
        fill = F.col("coord_flag").isin(*COORD_FLAGS[1:])
        table = table.join(mid, F.col(key).eqNullSafe(F.col("__key")), "left").withColumns({lat: F.when(fill, F.col("__lat")).otherwise(F.col(lat)), lon: F.when(fill, F.col("__lon")).otherwise(F.col(lon))}).drop("__key", "__lat", "__lon")
    return table, out


def key_medians(df: DataFrame, key: str, lat: str, lon: str) -> DataFrame:
    """(__key, __lat, __lon): medians of each key's coordinates, null a key of its own, from counts by value."""
    from .windows import exact_quantiles

    named = df.withColumn("__tag", F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("")))
    one = lambda c: exact_quantiles(named, c, {f"__m{c}": 0.5}, "__tag").select("__tag", f"__m{c}")
    keys = named.groupBy("__tag").agg(F.first(key, ignorenulls=True).alias("__key"))
    return keys.join(one(lat), "__tag", "left").join(one(lon), "__tag", "left").select("__key", F.col(f"__m{lat}").alias("__lat"), F.col(f"__m{lon}").alias("__lon"))


def clean_trajectory(df: DataFrame, date: str, start: str, end: str, lat: str, lon: str, speed: str, course: str, run_time: str) -> DataFrame:
    """Trajectory rows, all kept, cleaned and flagged: speed, course in [0, 360), coordinates (never filled), moving with no run
    time, and ``window_flag`` 0 outside [start, end)."""
    c = number(F.col(course))
    out = _cleaned(df.withColumn("course_flag", F.when(c.isNull(), "missing").when((c < 0) | (c >= 360), "out_of_range")), lat, lon, {speed: "speed_flag"})
    return out.withColumns({course: F.when(F.col("course_flag").isNull(), c), "runtime_flag": F.when((F.col(speed) > 5) & (F.col(run_time) == 0), "runtime_inconsistent_moving"), "window_flag": window_flag(F.col(date), start, end)})


def clean_sensors(df: DataFrame, stamp: str, date: str, start: str, end: str, ems: str, gps: str, total: Column) -> DataFrame:
    """Sensor rows, all kept and flagged: missing speeds, acceleration norm (g) under 0.1 or over 5, a time of another date."""
    return df.withColumns({
        ems: number(F.col(ems)), gps: number(F.col(gps)), "ems_flag": F.when(number(F.col(ems)).isNull(), "missing"), "gps_flag": F.when(number(F.col(gps)).isNull(), "missing"),
        "accel_flag": F.when((total < 0.1) | (total > 5), "accel_extreme"), "date_flag": F.when(F.to_date(stamp) != F.col(date), "date_mismatch"), "window_flag": window_flag(F.col(date), start, end)})


def window_flag(date: Column, start: str, end: str) -> Column:
    return F.coalesce(((date >= F.lit(start).cast("date")) & (date < F.lit(end).cast("date"))).cast("int"), F.lit(0))


def split_window(df: DataFrame, inside: Column) -> tuple[DataFrame, DataFrame]:
    """Rows inside, and the quarantine of all others."""
    good = F.coalesce(inside, F.lit(False))
    return df.filter(good), df.filter(~good)


def drop_exact_duplicates(df: DataFrame, signature: list[str]) -> DataFrame:
    return df.dropDuplicates(signature)


def fill_median_in_box(df: DataFrame, key: str, lat: str, lon: str, box: tuple[float, float, float, float]) -> DataFrame:
    """Missing coordinates become their key's medians where these lie in (lat0, lat1, lon0, lon1)."""
    mid = key_medians(df, key, lat, lon).filter(F.col("__key").isNotNull()).withColumnRenamed("__key", key)
    inside = F.col("__lat").between(box[0], box[1]) & F.col("__lon").between(box[2], box[3])
    out = df.join(mid, key, "left")
    return out.withColumns({lat: F.coalesce(lat, F.when(inside, F.col("__lat"))), lon: F.coalesce(lon, F.when(inside, F.col("__lon")))}).drop("__lat", "__lon")


def low_exposure(km: Column, hours: Column) -> Column:
    return ((F.coalesce(km, F.lit(0.0)) < 50) | (F.coalesce(hours, F.lit(0.0)) < 1)).cast("int")


# ---- columns


def feature_columns(df: DataFrame, metadata: Iterable[str], forbidden: str = r"(_version$|^label_)") -> list[str]:
    return [c for c in df.columns if c not in set(metadata) and not re.search(forbidden, c)]


def numeric(df: DataFrame, names: Iterable[str]) -> list[str]:
    return [c for c in names if isinstance(df.schema[c].dataType, T.NumericType)]


def informative(df: DataFrame, names: list[str], least_variance: float = 1e-12) -> list[str]:
    """Columns with two finite values or more and a population variance above the least; one pass."""
    if not names:
        return []
    row = df.agg(*(F.count(number(F.col(c))).alias(f"n{i}") for i, c in enumerate(names)), *(F.var_pop(number(F.col(c))).alias(f"v{i}") for i, c in enumerate(names))).first()
    return [c for i, c in enumerate(names) if row[f"n{i}"] >= 2 and row[f"v{i}"] > least_variance]


def without_constant(df: DataFrame, names: list[str]) -> list[str]:
    row = df.agg(*(F.count_distinct(F.col(c)).alias(c) for c in names)).first()
    return [c for c in names if row[c] > 1]


def without_equal(df: DataFrame, names: list[str], atol: float = 1e-12) -> list[str]:
    """Drop columns equal to an earlier one (nulls equal); one pass over all pairs."""
    pairs = [(a, b) for i, b in enumerate(names) for a in names[:i]]
    if not pairs:
        return names
    differs = lambda a, b: F.col(a).isNull() != F.col(b).isNull()
    far = lambda a, b: F.coalesce(F.abs(F.col(a) - F.col(b)) > atol, F.lit(False))
    row = df.agg(*(F.bool_or(differs(a, b) | far(a, b)).alias(f"p{i}") for i, (a, b) in enumerate(pairs))).first()
    kept: list[str] = []
    for b in names:
        if not any(a in kept and not row[f"p{i}"] for i, (a, y) in enumerate(pairs) if y == b):
            kept.append(b)
    return kept


def prune_correlated(df: DataFrame, names: list[str], limit: float = 0.95, ranks: bool = True) -> list[str]:
    """Keep a column if it correlates by at most ``limit`` with all kept before it (Spearman, or Pearson)."""
    pairs = [(a, b) for i, b in enumerate(names) for a in names[:i]]
    if ranks:
        found = correlations(df, names)
        row = {f"p{i}": found[p] for i, p in enumerate(pairs)}
    else:
        row = df.agg(*(F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"p{i}") for i, (a, b) in enumerate(pairs))).first() if pairs else {}
    kept: list[str] = []
    for b in names:
        if not any(a in kept and row[f"p{i}"] is not None and abs(row[f"p{i}"]) > limit for i, (a, y) in enumerate(pairs) if y == b):
            kept.append(b)
    return kept


def finalize_columns(df: DataFrame, declared: list[str], limit: float = 0.95, least_variance: float = 1e-12, twins: tuple[str, str] = ("_per_1000km", "_per_100h")) -> tuple[list[str], list[tuple[str, str, str]]]:
    """(kept, dropped) of the declared columns in their order. First those with the second of ``twins`` whose twin with
    the first is declared, then those (almost) constant, then those whose Spearman correlation with a kept one before is
    over ``limit`` in size. ``dropped``: (column, stage, reason). A pair's ranks are those among the rows where both are present."""
    names, (stays, goes) = list(dict.fromkeys(declared)), twins
    twin = {c: c[: -len(goes)] + stays for c in names if c.endswith(goes) and c[: -len(goes)] + stays in names}
    rest = [c for c in names if c not in twin]
    varied = informative(df, rest, least_variance)
    dropped = [(c, "dual_track", t) for c, t in twin.items()] + [(c, "near_zero_variance", f"variance at most {least_variance:g}") for c in rest if c not in varied]
    found = correlations(df, varied)
    kept: list[str] = []
    for b in varied:
        near = next((a for a in kept if found[a, b] is not None and abs(found[a, b]) > limit), None)
        if near is None:
            kept.append(b)
        else:
            dropped.append((b, "spearman_rho", f"{near} {found[near, b]:.6f}"))
    return kept, dropped


def correlations(df: DataFrame, names: list[str]) -> dict[tuple[str, str], float | None]:
    """Spearman correlation of every column with each after it, over the rows where both are present: a pair's ranks are
    those among its own common rows. None with fewer than two different values on either side."""
    from ..sources.shared import checkpoint
    from .windows import running

    pairs = [(a, b) for i, b in enumerate(names) for a in names[:i]]
    if not pairs:
        return {}
    src = df.select(*(number(F.col(c)).alias(c) for c in names))
    both = [F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.struct(F.lit(i).alias("pair"), F.col(a).alias("x"), F.col(b).alias("y"))) for i, (a, b) in enumerate(pairs)]
    cells = checkpoint(src.select(F.inline(F.filter(F.array(*both), lambda c: c.isNotNull()))).groupBy("pair", "x", "y").agg(F.count("*").alias("n")))
    values = cells.select("pair", "n", F.inline(F.array(F.struct(F.lit("x").alias("side"), F.col("x").alias("v")), F.struct(F.lit("y").alias("side"), F.col("y").alias("v")))))
    before = running(values.groupBy("pair", "side", "v").agg(F.sum("n").alias("n")), ["pair", "side", "v"], {"before": "n"})
    sizes = before.groupBy("pair", "side").agg(F.min("before").alias("start"), F.sum("n").alias("all"))
    # the mean rank of a value less that of all rows: sums of these lose nothing to their size
    ranks = before.join(sizes, ["pair", "side"]).select("pair", "side", "v", (F.col("before") - F.col("start") + F.col("n") / 2 - F.col("all") / 2).alias("r"))
    of = lambda side: ranks.filter(F.col("side") == side).select("pair", F.col("v").alias(side), F.col("r").alias(f"r{side}"))
    met = cells.join(of("x"), ["pair", "x"]).join(of("y"), ["pair", "y"])
    sums = {r.pair: r for r in met.groupBy("pair").agg(*(F.sum(F.col("n") * F.col(f"r{a}") * F.col(f"r{b}")).alias(a + b) for a, b in ("xy", "xx", "yy"))).collect()}  # a row for each pair of columns
    return {p: sums[i].xy / (sums[i].xx * sums[i].yy) ** 0.5 if i in sums and sums[i].xx * sums[i].yy > 0 else None for i, p in enumerate(pairs)}


def select_by_quota(families: dict[str, list[str]], first: str, first_most: int = 6, each: int = 6, total: int = 40) -> list[str]:
    """The first family's columns, then one of each family in turn, up to the quotas."""
    out = families.get(first, [])[:first_most]
    rest = {k: v for k, v in families.items() if k != first}
    for turn in range(each):
        for cols in rest.values():
            if turn < len(cols) and len(out) < total:
                out.append(cols[turn])
    return out


def impute(train: DataFrame, df: DataFrame, numbers: list[str], texts: list[str]) -> DataFrame:
    """Medians (numbers) and modes (texts, the first of equals) of the training rows for missing values."""
    long = train.select(F.inline(F.array(*(F.struct(F.lit(i).alias("c"), F.col(c).cast("double").alias("v")) for i, c in enumerate(numbers))))) if numbers else None
    held = {numbers[i]: q[0] for i, q in _quantiles(long, [0.5]).items()} if numbers else {}
    for c in texts:
        top = train.filter(F.col(c).isNotNull()).groupBy(c).count().orderBy(F.desc("count"), c).first()
        held[c] = top[c] if top else None
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(held[c])) if held.get(c) is not None else F.col(c) for c in [*numbers, *texts]})


def one_hot(df: DataFrame, col: str, values: list[str], drop_first: bool = False) -> DataFrame:
    """0/1 columns for known values; unknown and missing are 0 in all."""
    return df.withColumns({f"{col}_{v}": F.coalesce((F.col(col) == v).cast("int"), F.lit(0)) for v in values[drop_first:]})


def normal_cdf(z: Column) -> Column:
    """The standard normal distribution function: 1/2 and the density times z + z^3/3 + z^5/15 + ..., exact to 1e-15 for |z| up to 6."""
    return _once(z, _cdf)


def _cdf(z: Column) -> Column:
    start = F.struct(z.alias("term"), z.alias("total"))
    step = lambda s, k: F.struct((s["term"] * z * z / (2 * k + 1)).alias("term"), (s["total"] + s["term"] * z * z / (2 * k + 1)).alias("total"))
    return 0.5 + F.exp(-z * z / 2) / (2 * math.pi) ** 0.5 * F.aggregate(F.sequence(F.lit(1), F.lit(90)), start, step, lambda s: s["total"])


def _once(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)`` with the value evaluated once, however often ``of`` names it."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def normal_quantile(p: Column) -> Column:
    """Standard normal quantile: ``inverse_normal`` with a step of Newton's method."""
    step = lambda q: _once(inverse_normal(q), lambda z: z - (normal_cdf(z) - q) * (2 * math.pi) ** 0.5 * F.exp(z * z / 2))
    return _once(p, step)


def _quantiles(long: DataFrame, shares: list[float]) -> dict[int, list[float]]:
    """Linearly interpolated quantiles of the values v of each c, from counts by value; only the values next to a quantile reach
    the driver, two for each share and c at most."""
    from .windows import running

    counts = running(long.filter("v is not null").groupBy("c", "v").agg(F.count("*").alias("n")), ["c", "v"], {"before": "n"})
    sizes = counts.groupBy("c").agg(F.min("before").alias("start"), F.sum("n").alias("all"))
    at = counts.join(sizes, "c").select("c", "v", "n", "all", (F.col("before") - F.col("start")).alias("at"))
    holds = lambda k: (k >= F.col("at")) & (k < F.col("at") + F.col("n"))
    near = F.exists(F.array(*map(F.lit, shares)), lambda q: holds(F.floor((F.col("all") - 1) * q)) | holds(F.ceil((F.col("all") - 1) * q)))
    out: dict[int, list] = {}
    for r in at.filter(near).orderBy("c", "at").collect():
        out.setdefault(r.c, []).append(r)
    value = lambda rows, k: next(r.v for r in rows if r.at <= k < r.at + r.n)

    def one(rows: list, q: float) -> float:
        k = (rows[0]["all"] - 1) * q
        low, high = value(rows, math.floor(k)), value(rows, math.ceil(k))
        return low + (high - low) * (k - math.floor(k))

    return {c: [one(rows, q) for q in shares] for c, rows in out.items()}


@dataclass(frozen=True)
class QuantileNormal:
    """Columns brought to a normal shape by the quantiles of the rows that it was fitted on, group by group of weight 1 / sqrt(d)."""

    medians: dict[str, float]
    quantiles: dict[str, list[float]]
    weights: dict[str, float]

    #: Nothing is further out than the quantile of this share.
    EDGE = 1e-7

    @classmethod
    def fit(cls, train: DataFrame, groups: dict[str, list[str]], most: int = 200) -> QuantileNormal:
        """Medians and up to ``most`` reference quantiles of the columns of each group, from counts by value of all rows of
        ``train`` in one pass. A column without values has none and becomes 0 everywhere."""
        columns = [c for cs in groups.values() for c in cs]
        rows = train.select(*(number(F.col(c)).alias(c) for c in columns))
        n = max(2, min(most, train.count()))
        long = lambda src: src.select(F.inline(F.array(*(F.struct(F.lit(i).alias("c"), F.col(c).alias("v")) for i, c in enumerate(columns)))))
        middle = {columns[i]: q[0] for i, q in _quantiles(long(rows), [0.5]).items()}
        found = {columns[i]: q for i, q in _quantiles(long(rows.na.fill(middle) if middle else rows), [i / (n - 1) for i in range(n)]).items()}
        return cls({c: middle.get(c) for c in columns}, {c: found.get(c, []) for c in columns}, {c: len(cs) ** -0.5 for cs in groups.values() for c in cs})

    def share(self, name: str) -> Column:
        """Where a value stands among the references, 0 to 1: the mean of the interpolations from below and from above, so that a run of
        equal references has its middle. A missing value counts as the median."""
        q = self.quantiles[name]
        if not q:
            return F.lit(0.5)
        n, held = len(q), F.array(*map(F.lit, q))
        ref = lambda i: i / F.lit(float(n - 1))

        def between(x: Column, i: Column) -> Column:
            low, high = F.get(held, i), F.get(held, i + 1)
            return ref(i) + (x - low) / (high - low) / (n - 1)

        def placed(s: Column) -> Column:
            x, upto, under = s["x"], s["upto"], s["under"]
            low = F.when(upto == 0, 0.0).when(upto == n, 1.0).otherwise(between(x, upto - 1))
            high = F.when(under == 0, 0.0).when(under == n, 1.0).when(x == F.get(held, under), ref(under)).otherwise(between(x, under - 1))
            return F.when(x <= q[0], 0.0).when(x >= q[-1], 1.0).otherwise((low + high) / 2)

        counted = lambda x: F.struct(x.alias("x"), F.size(F.filter(held, lambda e: e <= x)).alias("upto"), F.size(F.filter(held, lambda e: e < x)).alias("under"))
        value = F.coalesce(number(F.col(name)), F.lit(self.medians[name]))
        return _once(_once(value, counted), placed)

    def normal(self, name: str) -> Column:
        return normal_quantile(F.greatest(F.lit(self.EDGE), F.least(F.lit(1 - self.EDGE), self.share(name)))) if self.quantiles[name] else F.lit(0.0)

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with each column's normal value times its group's weight."""
        return df.withColumns({c: self.normal(c) * self.weights[c] for c in self.quantiles})

    def inverse(self, df: DataFrame) -> DataFrame:
        """Back from ``transform``: values inside the references as they were, those outside at their ends."""
        return df.withColumns({c: self.value(c, normal_cdf(F.col(c) / self.weights[c])) for c in self.quantiles})

    def value(self, name: str, share: Column) -> Column:
        q, n = self.quantiles[name], len(self.quantiles[name])
        if not q:
            return F.lit(None).cast("double")
        held, edge = F.array(*map(F.lit, q)), self.EDGE * 1.0000001

        def at(p: Column) -> Column:
            i = F.least(F.floor(p), F.lit(n - 2)).cast("int")
            return F.get(held, i) + (p - i) * (F.get(held, i + 1) - F.get(held, i))

        return _once(_once(share, lambda u: F.when(u <= edge, 0.0).when(u >= 1 - edge, 1.0).otherwise(u) * (n - 1)), at)


def inverse_normal(p: Column) -> Column:
    """Standard normal quantile by a rational approximation (error under 1.2e-9)."""
    # Acklam's coefficients.
    a = [-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239]
    b = [-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572]
    c = [-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783]
    d = [0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416]

    def horner(x: Column, cs: list[float]) -> Column:
        out = F.lit(cs[0])
        for k in cs[1:]:
            out = out * x + k
        return out

    tail = lambda q: horner(q, c) / (horner(q, d) * q + 1)
    x = p - 0.5
    r = x * x
    return (F.when((p <= 0) | (p >= 1), F.lit(None)).when(p < 0.02425, tail(F.sqrt(-2 * F.log(p))))
            .when(p > 1 - 0.02425, -tail(F.sqrt(-2 * F.log(1 - p)))).otherwise(horner(r, a) * x / (horner(r, b) * r + 1)))
