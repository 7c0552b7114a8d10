"""Ranking and probability metrics as aggregates; no pairwise loops."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ratio
from ..sources.shared import checkpoint
from .windows import running, with_average_rank, with_position


def auc(df: DataFrame, score: str, label: str, by: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve from score counts: ties count half, null for a single class.

    Rows are first counted by score; without groups the counts are summed over ranges of scores, so no task sees them all.
    """
    by = by or []
    h = df.groupBy(*by, F.col(score).alias("__s")).agg(F.count_if(F.col(label) == 1).alias("__p"), F.count_if(F.col(label) == 0).alias("__n"))
    if by:
        h = h.withColumn("__below", F.coalesce(F.sum("__n").over(Window.partitionBy(*by).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    else:
        h = running(h, ["__s"], {"__below": "__n"})
    won = h.withColumn("__w", F.col("__p") * (F.col("__below") + F.col("__n") / 2))
    return won.groupBy(*by).agg(ratio(F.sum("__w"), F.sum("__p") * F.sum("__n")).alias("auc"), F.sum("__p").alias("positives"), F.sum("__n").alias("negatives"))


def average_precision(df: DataFrame, score: str, label: str, by: list[str] | None = None) -> DataFrame:
    """Stepwise over different scores, highest first."""
    by = by or []
    h = df.groupBy(*by, F.col(score).alias("__s")).agg(F.count_if(F.col(label) == 1).alias("__p"), F.count("*").alias("__n"))
    if by:
        w = Window.partitionBy(*by).orderBy(F.desc("__s")).rowsBetween(Window.unboundedPreceding, -1)
        h = h.withColumns({"__tp": F.coalesce(F.sum("__p").over(w), F.lit(0)), "__all": F.coalesce(F.sum("__n").over(w), F.lit(0))})
    else:
        h = running(h, ["__s"], {"__tp": "__p", "__all": "__n"}, descending=True)
    steps = h.withColumn("__part", F.col("__p") * ratio(F.col("__tp") + F.col("__p"), F.col("__all") + F.col("__n")))
    return steps.groupBy(*by).agg(ratio(F.sum("__part"), F.sum("__p")).alias("average_precision"))


def brier(p: Column, y: Column) -> Column:
    return F.avg((p - y) * (p - y))


def log_loss(p: Column, y: Column, eps: float = 1e-15) -> Column:
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return -F.avg(F.when(y == 1, F.log(q)).otherwise(F.log(1 - q)))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    return with_average_rank(df.select(F.col(a).alias("a"), F.col(b).alias("b")), {"ra": "a", "rb": "b"}).select(F.col("ra").alias("a"), F.col("rb").alias("b")).agg(F.corr("a", "b").alias("spearman"))


#: Rows of a range in which inversions are counted, and the most ranges.
RANGE_ROWS, MAX_RANGES = 1 << 20, 1024


def weighted_inversions(order: np.ndarray, weight: np.ndarray) -> int:
    """Sum of weight[i] weight[j] over i < j with order[i] > order[j], for a permutation ``order``: bit by bit, the weight
    with a set bit that stands before one without, among those whose higher bits are equal."""
    total, at = 0, np.arange(len(order))
    for bit in reversed(range(max(1, len(order)).bit_length())):
        o, w = order[at], weight[at]
        one = (o >> bit) & 1
        group = o >> (bit + 1)
        ones = np.cumsum(w * one)
        new = np.concatenate([[True], group[1:] != group[:-1]]) if len(o) else np.zeros(0, bool)
        before = (ones - w * one)[np.flatnonzero(new)][np.cumsum(new) - 1] if len(o) else ones
        total += int((w * (1 - one) * (ones - before)).sum())
        at = at[np.argsort((group << 1) | one, kind="stable")]
    return total


def _inversions(batches: Iterator[pa.RecordBatch], first: list[str]) -> Iterator[pa.RecordBatch]:
    """The weight of pairs of this partition's rows that lie one way by ``first`` and the other way by (b, a)."""
    held = list(batches)
    if not held or not sum(b.num_rows for b in held):
        return
    t = pa.Table.from_batches(held)
    a, b, n = (t.column(c).to_numpy() for c in ("a", "b", "n"))
    by = np.lexsort([*(t.column(c).to_numpy() for c in reversed(first))])
    rank = np.empty(len(a), np.int64)
    rank[np.lexsort((a, b))] = np.arange(len(a))
    yield pa.RecordBatch.from_arrays([pa.array([weighted_inversions(rank[by], n[by])], pa.int64())], names=["s"])


def kendall_tau_b(df: DataFrame, a: str, b: str) -> DataFrame:
    """Kendall's rank correlation with ties, from the number of inversions: n log n, no pairs of rows meet.

    Counts by value pair are dealt to ranges of (a, b) and to ranges of (b, a), in which equal values of one side are ordered by the
    other, so that a value of any frequency is split and ties are no inversions. Pairs in one range of either are counted in its
    task; pairs apart in both come from a table of counts by ranges, at most MAX_RANGES squared. Rows with a missing value are left
    out; without two different values on each side the result is null.
    """
    known = df.select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")).dropna()
    h = checkpoint(known.groupBy("a", "b").agg(F.count("*").alias("n")))
    ranges = max(1, min(MAX_RANGES, math.ceil(h.count() / RANGE_ROWS)))
    by_a = checkpoint(h.repartitionByRange(ranges, "a", "b").withColumn("i", F.spark_partition_id()))
    by_b = checkpoint(by_a.repartitionByRange(ranges, "b", "a").withColumn("k", F.spark_partition_id()))
    add = lambda src, first: sum(r.s for r in src.select("a", "b", "n", *(["i"] if "i" in first else [])).mapInArrow(functools.partial(_inversions, first=first), "s long").collect())  # noqa: E731  a row for each range
    opposed = add(by_a, ["a", "b"]) + add(by_b, ["i", "b", "a"])
    table = [[0] * ranges for _ in range(ranges)]
    for r in by_b.groupBy("i", "k").agg(F.sum("n").alias("n")).toLocalIterator():
        table[r.i][r.k] = r.n
    before = [0] * ranges  # rows of earlier ranges of a, by range of b
    for line in table:
        above = 0
        for k in reversed(range(ranges)):
            opposed += line[k] * above
            above += before[k]
        before = [x + y for x, y in zip(before, line)]
    pairs = lambda src: src.agg(F.coalesce(F.sum((F.col("n") * (F.col("n") - 1) / 2).cast("decimal(38,0)")), F.lit(0))).first()[0]
    tied = [int(pairs(h.groupBy(c).agg(F.sum("n").alias("n")))) for c in "ab"]
    both, n = int(pairs(h)), h.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    total = n * (n - 1) // 2
    room = (total - tied[0]) * (total - tied[1])
    tau = (total - tied[0] - tied[1] + both - 2 * opposed) / math.sqrt(room) if room > 0 else None
    return df.sparkSession.createDataFrame([(tau,)], "kendall_tau_b double")


def top_k(df: DataFrame, score: str, id_col: str, quota: float) -> DataFrame:
    """Rows in the first ceil(quota N) by (-score, id), with ``rank``; distributed top-k, no global window."""
    n = df.count()
    k = -(-int(n * round(quota * 10_000)) // 10_000)
    return df.orderBy(F.desc(score), id_col).limit(max(k, 1))


def quintiles(df: DataFrame, score: str, id_col: str, n: int = 5) -> DataFrame:
    """bucket = floor((row - 1) * n / N) in the order of (score, id)."""
    total = df.agg(F.count("*").alias("__all"))
    return with_position(df, [score, id_col], "__row").join(F.broadcast(total)).withColumn("bucket", F.floor(F.col("__row") * n / F.col("__all")).cast("int")).drop("__row", "__all")  # total: one row


def calibration(df: DataFrame, p: str, label: str, bins: int = 10) -> DataFrame:
    """Right-closed bins of equal width, 0 in the first."""
    b = F.greatest(F.ceil(F.col(p) * bins), F.lit(1)).cast("int")
    return df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(label).alias("mean_y"))


def paired_bootstrap_auc(df: DataFrame, a: str, b: str, label: str, id_col: str, draws: int = 2000, seed: int = 42) -> DataFrame:
    """Percentiles of auc(a) - auc(b) over draws, for tables of any size.

    Each row's weight in a draw is Poisson(1) by a hash of (seed, draw, id), the large-sample form of
    resampling, and each draw's AUC is over its own positives and negatives; rows are never gathered, and the
    same ids give the same draws on any cluster. Every draw shuffles its counts by score.
    """
    u = F.pmod(F.xxhash64(F.lit(seed), F.col("draw"), F.col(id_col)), F.lit(1 << 30)) / float(1 << 30)
    weight, cum, p = F.lit(0), 0.0, 0.36787944117144233
    for k in range(1, 9):
        cum += p
        weight = F.when(u >= cum, k).otherwise(weight) if k == 1 else F.when(u >= cum, k).otherwise(weight)
        p /= k
    drawn = df.join(F.broadcast(df.sparkSession.range(draws).withColumnRenamed("id", "draw"))).withColumn("w", weight).filter("w > 0")

    def weighted(score: str) -> DataFrame:
        h = drawn.groupBy("draw", F.col(score).alias("s")).agg(F.sum(F.when(F.col(label) == 1, F.col("w")).otherwise(0)).alias("p"), F.sum(F.when(F.col(label) == 0, F.col("w")).otherwise(0)).alias("n"))
        below = F.coalesce(F.sum("n").over(Window.partitionBy("draw").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return h.withColumn("x", F.col("p") * (below + F.col("n") / 2)).groupBy("draw").agg(ratio(F.sum("x"), F.sum("p") * F.sum("n")).alias(score))

    d = weighted(a).join(weighted(b), "draw").select((F.col(a) - F.col(b)).alias("d"))
    return d.agg(F.count("d").alias("draws"), F.avg("d").alias("mean"), F.percentile("d", 0.025).alias("low"), F.percentile("d", 0.975).alias("high"))
