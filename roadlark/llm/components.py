"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def dealt_again(df: DataFrame, key: str) -> DataFrame:
    """``df`` with a key that Spark doesn't know to be dealt out already. Of a join with plain shuffles on
    both sides the adaptive planner can split a hot key's rows; of one that reuses an aggregate's it can't."""
    return df.withColumn(key, F.col(key).bitwiseXOR(F.lit(0).cast("long")))


def _stars(pairs: DataFrame, large: bool) -> DataFrame:
    """Link the larger (or, else, the smaller) neighbours of each u to the least of its neighbourhood."""
    least = dealt_again(pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "u")
    joined = pairs.join(least, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.filter("v < u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v) rows -> (node, root) of every node that is not its component's least.

    Each step is a partial aggregation and an equi-join and ends in a reliable checkpoint;
    the number of steps grows with the logarithm of the longest path.
    """
    now = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    sign = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    last = sign(now)
    while last[0]:
        now = cut(_stars(_stars(_both(now), True), False))
        seen, last = last, sign(now)
        if seen == last:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
