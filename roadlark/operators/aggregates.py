"""Keyed aggregates: moments, histograms, quantiles, rates, cohort statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ratio


#: Decimals for sums that must not depend on the order of rows, and the largest absolute values of a group that they keep as well as doubles do.
PLACES, HELD = "decimal(38,18)", (1e-2, 1e15)


def places(c: Column) -> Column:
    """A double as ``PLACES``: as it is written, null where it isn't finite or too large."""
    return c.cast("double").try_cast(PLACES)


def _in_any_order(c: Column, exact: Column, plain: Column) -> Column:
    return F.coalesce(F.when(F.max(F.abs(c.cast("double"))).between(*HELD), exact.cast("double")), plain)


def steady_sum(c: Column) -> Column:
    """Sum of doubles as they are written, the same in any order of rows, so equal sums are equal; of doubles as usual
    for groups whose largest absolute value isn't in ``HELD`` or whose sum is beyond ``PLACES``."""
    return _in_any_order(c, F.try_sum(places(c)), F.sum(c.cast("double")))


def steady_mean(c: Column, written: Column | None = None) -> Column:
    """Mean by the rules of ``steady_sum``; ``written`` is ``places(c)`` where it is there already."""
    return _in_any_order(c, F.try_avg(places(c) if written is None else written), F.avg(c.cast("double")))


def count_if(c: Column) -> Column:
    return F.count_if(c)


def per_10k(n: Column, of: Column) -> Column:
    return F.coalesce(ratio(n * 10000, of), F.lit(0.0))


def exposure_rate(count: Column, exposure: Column, per: float, least: float) -> Column:
    """count per ``per`` of exposure, null under the least exposure."""
    return F.when(exposure >= least, ratio(count * per, exposure))


def sum_of_present(*cols: str) -> Column:
    """Row sum that is null only if all are."""
    total = sum((F.coalesce(F.col(c), F.lit(0)) for c in cols[1:]), F.coalesce(F.col(cols[0]), F.lit(0)))
    return F.when(F.coalesce(*map(F.col, cols)).isNotNull(), total)


def mean_of_present(*cols: Column) -> Column:
    n = sum((c.isNotNull().cast("int") for c in cols[1:]), cols[0].isNotNull().cast("int"))
    return F.try_divide(sum((F.coalesce(c, F.lit(0.0)) for c in cols[1:]), F.coalesce(cols[0], F.lit(0.0))), n)


def histogram(df: DataFrame, by: list[str], x: Column, low: float, width: float, bins: int) -> DataFrame:
    """(by, bin, n) with values outside in the end bins: a partial aggregate, so mergeable anywhere."""
    b = F.least(F.greatest(F.floor((x - low) / width), F.lit(0)), F.lit(bins - 1)).cast("int")
    return df.filter(x.isNotNull()).groupBy(*by, b.alias("bin")).agg(F.count("*").alias("n"))


def histogram_quantiles(h: DataFrame, by: list[str], quantiles: dict[str, float], low: float, width: float, rule: str = "upper") -> DataFrame:
    """Quantiles of ``histogram``'s rows: 'upper' takes the right edge of the first bin that reaches
    max(1, ceil(n q)), 'midpoint' the middle of the first that reaches n q, 'midpoint_ceil' of ceil(n q)."""
    w = Window.partitionBy(*by)
    cum = F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    src = h.withColumns({"__cum": cum, "__all": F.sum("n").over(w)})
    out = []
    for name, q in quantiles.items():
        need = F.col("__all") * q
        need = F.greatest(F.ceil(need), F.lit(1)) if rule == "upper" else F.ceil(need) if rule == "midpoint_ceil" else need
        shift = 1.0 if rule == "upper" else 0.5
        out.append((low + (F.min(F.when(F.col("__cum") >= need, F.col("bin"))) + shift) * width).alias(name))
    return src.groupBy(*by).agg(F.first("__all").alias("n"), *out)


def edge_quantile(df: DataFrame, by: list[str], x: Column, edges: list[float], q: float) -> DataFrame:
    """For uneven edges: the lower edge of the bin that holds quantile q of the values at or over the
    first edge, and the share of all values at or over it."""
    e = F.array(*map(F.lit, edges))
    h = df.withColumn("__bin", F.size(F.filter(e, lambda v: v <= x))).groupBy(*by, "__bin").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*by)
    over = F.when(F.col("__bin") > 0, F.col("n")).otherwise(0)
    src = h.withColumns({"__cum": F.sum(over).over(w.orderBy("__bin")), "__over": F.sum(over).over(w), "__all": F.sum("n").over(w)})
    first = F.min(F.when((F.col("__bin") > 0) & (F.col("__cum") >= F.col("__over") * q), F.col("__bin")))
    return src.groupBy(*by).agg(F.get(e, first - 1).alias("q"), ratio(F.first("__over"), F.first("__all")).alias("share_over"))


def fold_out(df: DataFrame, fold: str, by: list[str], aggregates: list[Column], n_folds: int) -> DataFrame:
    """For each target fold the aggregates of all rows of other folds."""
    targets = df.sparkSession.range(n_folds).select(F.col("id").cast("int").alias("target_fold"))
    # n_folds rows, a parameter.
    return df.join(F.broadcast(targets), F.col(fold) != F.col("target_fold")).groupBy("target_fold", *by).agg(*aggregates)


def smooth_rate(count: Column, exposure: Column, prior: Column, k: float) -> Column:
    return (count + k * prior) / (exposure + k)


def diminishing(points: str, factor: float = 0.25) -> Column:
    """The largest of a group and ``factor`` times the mean of the rest."""
    rest = ratio(F.sum(points) - F.max(points), F.count(points) - 1)
    return F.max(points) + factor * F.coalesce(rest, F.lit(0.0))


def cohort_relative(df: DataFrame, cohort: str, x: str, train: str, least: int = 30, eps: float = 1e-9) -> DataFrame:
    """``df`` with ``z`` and ``pct`` (share of training values at most x) within the cohort, and ``fallback``.

    Statistics are those of rows with ``train``; a cohort with fewer than ``least`` of them takes those of all. ``z`` is null
    where the deviation is 0, both where x is missing. Shares come from counts by value, so ties meet once.
    """
    from .windows import running

    fit = F.when(F.col(train), F.col(x).cast("double"))
    counts = df.filter(F.col(x).isNotNull()).groupBy(cohort, F.col(x).cast("double").alias("__x")).agg(F.sum(F.col(train).cast("long")).alias("__k"))
    by = Window.partitionBy(cohort)
    own = counts.withColumns({"__own": F.sum("__k").over(by.orderBy("__x")), "__n_own": F.sum("__k").over(by)}).drop("__k")
    fleet = running(counts.groupBy("__x").agg(F.sum("__k").alias("__k")), ["__x"], {"__below": "__k"}).select("__x", (F.col("__below") + F.col("__k")).alias("__all"))
    stats = lambda by: [F.avg(fit).alias(f"__m{by}"), F.stddev_pop(fit).alias(f"__d{by}"), F.count(fit).alias(f"__n{by}")]
    size = F.count_if(F.col(train)).alias("__size")
    out = df.join(df.groupBy(F.col(cohort).alias("__c")).agg(size, *stats("c")), F.col(cohort).eqNullSafe(F.col("__c"))).join(F.broadcast(df.agg(*stats("a"))))  # one row
    out = out.withColumn("fallback", (F.col("__size") < least).cast("int")).withColumn("__x", F.col(x).cast("double"))
    own = own.select(F.col(cohort).alias("__c2"), F.col("__x").alias("__x2"), "__own")
    out = out.join(own, F.col(cohort).eqNullSafe(F.col("__c2")) & (F.col("__x") == F.col("__x2")), "left").join(fleet.withColumnRenamed("__x", "__x3"), F.col("__x") == F.col("__x3"), "left")
    pick = lambda a, b: F.when(F.col("fallback") == 1, F.col(b)).otherwise(F.col(a))
    z = F.when(pick("__dc", "__da") > eps, (F.col("__x") - pick("__mc", "__ma")) / pick("__dc", "__da"))
    return out.select(*df.columns, z.alias("z"), ratio(pick("__own", "__all"), pick("__nc", "__na")).alias("pct"), "fallback")
