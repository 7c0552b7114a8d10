"""Axes of a mounted sensor and the volatility of what it reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import norm, ratio
from .aggregates import places, steady_mean
from .windows import exact_quantiles

Vector = tuple[Column, Column, Column]


def _dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _cross(a: Vector, b: Vector) -> Vector:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def _turn(sums: str, n: Column, one: Vector, two: Vector) -> tuple[Column, Column, Column]:
    """(xx, yy, xy) of the covariance in the plane of two unit vectors, from sums of products."""
    axes = "xyz"
    mean = [F.col(f"{sums}{i}") / n for i in axes]
    pair = lambda i, j: f"{sums}{min(i, j)}{max(i, j)}"
    cov = {(i, j): F.col(pair(i, j)) / n - mean[axes.index(i)] * mean[axes.index(j)] for i in axes for j in axes}
    form = lambda a, b: sum((a[axes.index(i)] * cov[i, j] * b[axes.index(j)] for i in axes for j in axes), F.lit(0.0))
    return form(one, one), form(two, two), form(one, two)


def alignment(df: DataFrame, key: str, day: str, acceleration: tuple[str, str, str], driving: Column, least_rows: int = 500, day_rows: int = 1000, gravity: tuple[float, float] = (0.85, 1.15), least_ratio: float = 1.3, least_cosine: float = 0.8) -> DataFrame:
    """One row for each key: gravity from all rows, the forward axis as the principal axis of the horizontal plane
    while driving, the rotation ``forward``, ``lateral``, ``vertical`` (arrays) and whether it can be trusted.

    It can if gravity is in its range (g), the variances along and across differ enough, and the forward axes of
    single days (of ``day_rows`` driving rows or more) agree. Keys with few driving rows are 'insufficient_rows'. Rows are read once, into sums
    by key and day; the rest is arithmetic on those, the 2 x 2 matrix in closed form.
    """
    ax, names = [F.col(c).cast("double") for c in acceleration], "xyz"
    whole = F.greatest(*(a.isNull() | F.isnan(a) for a in (*ax,)))
    src = df.filter(~whole).select(F.col(key).alias("__key"), F.col(day).alias("__day"), F.coalesce(driving, F.lit(False)).alias("__drive"), *(a.alias(f"__{i}") for a, i in zip(ax, names)))
    drive = lambda c: F.coalesce(F.sum(F.when(F.col("__drive"), c)), F.lit(0.0))
    pairs = [(i, j) for k, i in enumerate(names) for j in names[k:]]
    parts = {"n": F.count("*"), "n_drive": F.count_if("__drive"), **{f"a{i}": F.sum(f"__{i}") for i in names}, **{f"d{i}": drive(F.col(f"__{i}")) for i in names}, **{f"d{i}{j}": drive(F.col(f"__{i}") * F.col(f"__{j}")) for i, j in pairs}}
    days = src.groupBy("__key", "__day").agg(*(c.alias(n) for n, c in parts.items()))
    total = days.groupBy("__key").agg(*(F.sum(n).alias(n) for n in parts))
    size = norm(*(F.col(f"a{i}") for i in names))
    total = total.withColumns({"gravity_norm": size / F.col("n"), **{f"g{i}": ratio(F.col(f"a{i}"), size) for i in names}})
    g = tuple(F.col(f"g{i}") for i in names)
    steep = F.abs(g[0]) >= 0.9
    ref = F.when(steep, 0.0).otherwise(1.0), F.when(steep, 1.0).otherwise(0.0), F.lit(0.0)
    c = _cross(ref, g)
    total = total.withColumns({f"e{i}": ratio(c[k], norm(*c)) for k, i in enumerate(names)})
    one = tuple(F.col(f"e{i}") for i in names)
    total = total.withColumns({f"f{i}": v for i, v in zip(names, _cross(g, one))})
    two = tuple(F.col(f"f{i}") for i in names)
    angle = lambda m: 0.5 * F.atan2(2 * m[2], m[0] - m[1])
    xx, yy, xy = _turn("d", F.nullif(F.col("n_drive"), F.lit(0)), one, two)
    total = total.withColumns({"__xx": xx, "__yy": yy, "__xy": xy})
    m = F.col("__xx"), F.col("__yy"), F.col("__xy")
    root = F.sqrt((m[0] - m[1]) * (m[0] - m[1]) / 4 + m[2] * m[2])
    total = total.withColumns({"var_ratio": ratio((m[0] + m[1]) / 2 + root, F.greatest((m[0] + m[1]) / 2 - root, F.lit(1e-12))), "__angle": angle(m)})
    axes = total.select("__key", "__angle", *(f"{e}{i}" for e in "ef" for i in names))
    apart = F.abs(F.cos(angle(_turn("d", F.col("n_drive"), one, two)) - F.col("__angle")))
    daily = days.filter(F.col("n_drive") >= day_rows).join(axes, "__key").groupBy("__key").agg(F.avg(apart).alias("daily_cosine"))
    out = total.join(daily, "__key", "left")
    forward = tuple(a * F.cos("__angle") + b * F.sin("__angle") for a, b in zip(one, two))
    enough = F.col("n_drive") >= least_rows
    ok = enough & F.col("gravity_norm").between(*gravity) & (F.col("var_ratio") >= least_ratio) & (F.coalesce("daily_cosine", F.lit(1.0)) >= least_cosine)
    found = lambda c: F.when(enough, c)
    return out.select(F.col("__key").alias(key), "n", "n_drive", F.coalesce(ok, F.lit(False)).alias("align_pass"), F.when(~enough, "insufficient_rows").alias("reason"), *(found(F.col(c)).alias(c) for c in ("gravity_norm", "var_ratio", "daily_cosine")),
                      found(F.array(*forward)).alias("forward"), found(F.array(*_cross(g, forward))).alias("lateral"), found(F.array(*g)).alias("vertical"))


def rotated(df: DataFrame, axes: DataFrame, key: str, vectors: dict[str, tuple[str, str, str]], passed: bool = True) -> DataFrame:
    """``df`` with <name>_fwd, <name>_lat, <name>_vert of each vector; null for keys without (trusted) axes."""
    held = (axes.filter("align_pass") if passed else axes).select(F.col(key).alias("__key"), *(F.col(c).alias(f"__{c}") for c in ("forward", "lateral", "vertical")))
    along = lambda v, c: _dot(tuple(F.col(x) for x in v), tuple(F.col(c)[i] for i in range(3)))
    out = df.join(held, F.col(key) == F.col("__key"), "left")
    return out.withColumns({f"{name}_{short}": along(v, f"__{axis}") for name, v in vectors.items() for short, axis in (("fwd", "forward"), ("lat", "lateral"), ("vert", "vertical"))}).drop("__key", "__forward", "__lateral", "__vertical")


def residuals(df: DataFrame, key: str, total: str, driving: Column, name: str = "residual") -> DataFrame:
    """``df`` with the distance of ``total`` from the key's median while driving, over all its rows (not shard by shard)."""
    mid = exact_quantiles(df.filter(driving), total, {"__mid": 0.5}, key).select(F.col(key).alias("__key"), "__mid")
    return df.join(mid, F.col(key) == F.col("__key"), "left").withColumn(name, F.abs(F.col(total) - F.col("__mid"))).drop("__key", "__mid")


def volatility_parts(df: DataFrame, key: str, signals: list[str], driving: Column, parts: dict[str, Column]) -> DataFrame:
    """(key, signal, part, n, mean, sd) while driving, for 'all' rows and those of each part (first half, night, not
    saturated, ...); one pass of conditional sums, the mean the same in any order of rows. A part without rows has n 0 and nulls."""
    parts = {"all": F.lit(True), **parts}
    src = df.filter(driving).withColumns({f"__{s}": places(F.col(s)) for s in signals})
    cell = lambda s, c: F.when(c, F.col(s).cast("double"))
    mean = lambda s, c: steady_mean(cell(s, c), F.when(c, F.col(f"__{s}")))
    cols = [F.struct(F.lit(s).alias("signal"), F.lit(p).alias("part"), F.count(cell(s, c)).alias("n"), mean(s, c).alias("mean"), F.stddev_pop(cell(s, c)).alias("sd")) for s in signals for p, c in parts.items()]
    return src.groupBy(key).agg(F.array(*cols).alias("__parts")).select(key, F.inline("__parts"))


def thresholds_for(kinds: DataFrame, fitted: DataFrame, kind: str, names: list[str], defaults: dict[str, float], unified: dict[str, float] | None = None) -> DataFrame:
    """``kinds`` with a threshold for each name: the kind's own row of ``fitted``, without one the row of the first kind by name,
    without any the defaults; what is ``unified`` overrides all three. The row is taken whole, so a null in it stays null."""
    own = fitted.select(F.col(kind).alias("__kind"), F.struct(*names).alias("__own"))
    first = fitted.agg(F.min_by(F.struct(*names), F.col(kind)).alias("__first"))  # one row
    base = F.struct(*(F.lit(defaults[n]).cast("double").alias(n) for n in names))
    out = kinds.join(own, F.col(kind) == F.col("__kind"), "left").join(F.broadcast(first))
    row = F.coalesce(*(x.cast(f"struct<{','.join(f'{n}:double' for n in names)}>") for x in (F.col("__own"), F.col("__first"), base)))
    return out.select(*kinds.columns, *((F.lit(float(unified[n])) if unified and n in unified else row[n].cast("double")).alias(n) for n in names))
