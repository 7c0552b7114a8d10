"""Half-open history windows, ranks, islands and rolling frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_history(ts: Column, as_of: str, days: float) -> Column:
    """ts in [as_of - days, as_of)."""
    end = F.lit(as_of).cast("timestamp_ntz")
    return (ts >= end - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(days * 86400))) & (ts < end)


def in_label_window(ts: Column, as_of: str, days: float) -> Column:
    """ts in [as_of, as_of + days)."""
    start = F.lit(as_of).cast("timestamp_ntz")
    return (ts >= start) & (ts < start + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(days * 86400)))


def average_rank(value: str | Column, *by: str) -> Column:
    """Rank from 1 with ties at their mean rank."""
    v = F.col(value) if isinstance(value, str) else value
    keys = [F.col(b) for b in by]
    return F.rank().over(Window.partitionBy(*keys).orderBy(v)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, v)) - 1) / 2


def percent_rank_average(value: str | Column, *by: str) -> Column:
    return average_rank(value, *by) / F.count(F.lit(1)).over(Window.partitionBy(*[F.col(b) for b in by]))


def islands(df: DataFrame, by: list[str], order: list[str], seconds: Column, gap_s: Column | int, name: str = "island") -> DataFrame:
    """Number runs whose neighbours are at most ``gap_s`` apart, from 1 within ``by``.

    One shuffle on ``by`` serves both the lag and the running sum.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    gap = gap_s if isinstance(gap_s, Column) else F.lit(gap_s)
    step = seconds - F.lag(seconds).over(w)
    out = df.withColumn("__new", F.when(step.isNull() | (step > gap), 1).otherwise(0))
    return out.withColumn(name, F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def runs(df: DataFrame, by: list[str], order: list[str], flag: Column, name: str = "run") -> DataFrame:
    """Number runs of equal ``flag`` within ``by``."""
    w = Window.partitionBy(*by).orderBy(*order)
    out = df.withColumn("__f", flag).withColumn("__b", F.lag("__f").over(w))
    out = out.withColumn("__new", F.when(F.col("__b").isNull() | (F.col("__b") != F.col("__f")), 1).otherwise(0))
    return out.withColumn(name, F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__f", "__b", "__new")


def dense_days(keys: DataFrame, first: str, last: str, name: str = "day") -> DataFrame:
    """Each key with each date from first to last."""
    return keys.withColumn(name, F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))))


def trailing(value: Column, by: str, day_number: Column, first: int, last: int) -> Column:
    """Sum over calendar days [day + first, day + last]."""
    return F.sum(value).over(Window.partitionBy(by).orderBy(day_number).rangeBetween(first, last))


def ewma(values: Column, decay: float) -> Column:
    """s <- decay * s + x over an array, oldest first."""
    return F.aggregate(values, F.lit(0.0), lambda s, x: decay * s + x)


def half(row_number: Column, count: Column) -> Column:
    """'early' for the first n // 2 rows, else 'late'."""
    return F.when(row_number <= F.floor(count / 2), "early").otherwise("late")


# ---- order over a whole table, without a window that one task would have to read


def running(df: DataFrame, order: list[str], sums: dict[str, str], descending: bool = False) -> DataFrame:
    """``df`` with, for each (name, column) of ``sums``, the sum of the column over all rows before in ``order``.

    Rows are dealt by range and summed within their range; what the ranges before hold is one row for each range.
    ``order`` should tell all rows apart, as that of counts by value does.
    """
    from ..sources.shared import checkpoint

    by = [F.desc(c) if descending else F.asc(c) for c in order]
    src = checkpoint(df.repartitionByRange(*by).withColumn("__part", F.spark_partition_id()))
    here = Window.partitionBy("__part").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    totals = src.groupBy("__part").agg(*(F.sum(c).alias(f"__t_{name}") for name, c in sums.items()))
    upto = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range: as many as partitions
    starts = totals.select("__part", *(F.coalesce(F.sum(f"__t_{name}").over(upto), F.lit(0)).alias(f"__s_{name}") for name in sums))
    out = src.withColumns({name: F.coalesce(F.sum(c).over(here), F.lit(0)) for name, c in sums.items()}).join(F.broadcast(starts), "__part")
    return out.withColumns({name: F.col(name) + F.col(f"__s_{name}") for name in sums}).drop("__part", *(f"__s_{name}" for name in sums))


def with_average_rank(df: DataFrame, ranks: dict[str, str]) -> DataFrame:
    """``df`` with, for each (name, column), the column's rank over the whole table, ties at their mean rank; null last."""
    for name, c in ranks.items():
        counts = running(df.groupBy(F.col(c).alias("__v")).agg(F.count("*").alias("__n")).withColumn("__null", F.col("__v").isNull()), ["__null", "__v"], {"__before": "__n"})
        rank = counts.select("__v", (F.col("__before") + (F.col("__n") + 1) / 2).alias(name))
        df = df.join(rank, F.col(c).eqNullSafe(F.col("__v")), "left").drop("__v")
    return df


def with_position(df: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """``df`` with its row number, from 0, over the whole table in an order that tells all rows apart."""
    return running(df.withColumn("__one", F.lit(1)), order, {name: "__one"}).drop("__one")


def counts_below(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, value, __n, __below, __all): of each value of a group its rows, those of lesser values, and all of the group; null least. A group
    of any size is counted over ranges, by no single task."""
    counts = running(df.groupBy(*by, value).agg(F.count("*").alias("__n")), [*by, value], {"__before": "__n"})
    sizes = counts.groupBy(*by).agg(F.min("__before").alias("__start"), F.sum("__n").alias("__all"))
    return counts.join(sizes, by).select(*by, value, "__n", (F.col("__before") - F.col("__start")).alias("__below"), "__all")


def with_share_below(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """``df`` with (rank - 1) / (rows - 1) of a value in its group, as PERCENT_RANK has it, 0 in a group of one row."""
    below = counts_below(df, by, value).select(*by, value, F.when(F.col("__all") > 1, F.col("__below") / (F.col("__all") - 1)).otherwise(0.0).alias(name))
    return df.join(below, [*by, value])


def exact_quantiles(df: DataFrame, value: str, quantiles: dict[str, float], by: str | None = None) -> DataFrame:
    """Linearly interpolated quantiles over a whole table or of each ``by`` that isn't null, and ``n``, from counts by
    value: no task holds all values."""
    group = F.col(by) if by else F.lit(0)
    src = df.select(group.alias("__by"), F.col(value).cast("double").alias("__v")).filter("__v is not null and __by is not null")
    counts = running(src.groupBy("__by", "__v").agg(F.count("*").alias("__n")), ["__by", "__v"], {"__before": "__n"})
    sizes = counts.groupBy("__by").agg(F.min("__before").alias("__start"), F.sum("__n").alias("__all"))
    c = counts.join(sizes, "__by").withColumn("__at", F.col("__before") - F.col("__start"))
    at = lambda k: F.max(F.when((F.col("__at") <= k) & (F.col("__at") + F.col("__n") > k), F.col("__v")))
    out = []
    for name, q in quantiles.items():
        k = (F.col("__all") - 1) * q
        low, high = at(F.floor(k)), at(F.ceil(k))
        out.append((low + (high - low) * F.max(k - F.floor(k))).alias(name))
    found = c.groupBy("__by").agg(*out, F.max("__all").alias("n"))
    if by:
        return found.withColumnRenamed("__by", by)
    empty = [F.coalesce(F.max(name), F.lit(None).cast("double")).alias(name) for name in quantiles]
    return found.agg(*empty, F.coalesce(F.max("n"), F.lit(0)).alias("n"))  # one row at most
