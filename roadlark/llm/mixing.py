"""Temperature mixing of sources (native expressions only).

A source's weight is its token share to the power alpha, normalised. Alpha is the smallest
exponent at which the mixture's entropy is at most ``target_entropy`` (a share of the largest
possible, ln of the number of sources) and no source is passed more than ``max_epochs`` times. It lies
below 1 where the sources are less even than that, which evens them out, and above 1 where they are more even;
there the repetitions grow with it, and if they meet their limit first, alpha is the last exponent within it.
It is found by bisection, whose steps are aggregates over the table of source totals.
The budget is by default the least that passes every source once, so nothing is lost.

A source's part of the budget is realised by permutations of its blocks: whole passes, each in
an order of its own, and then the first blocks of one more pass as far as its tokens reach.
A block is the documents of a source with one hash prefix: at most 4096 to a source whatever
its size, so a hot source is summed in parts before any window sees it, and a document finds
out by itself, from its source's one row, whether its block is in.

Defined results: a null source is a source of its own; null and empty texts have no tokens and
go with their block; repeated rows stay repeated; an empty table gives an empty table; a source
without tokens is passed once; input columns named ``epoch`` or ``position`` are replaced.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, cut, table

TARGET_ENTROPY, MAX_EPOCHS, STEPS, AT_ONCE = 0.92, 2.0, 24, 6
#: The largest exponent that is tried.
MOST_ALPHA = 33.0
SEED = "mix"
#: Rows of the table of sources that may be sent to all workers; a longer table is joined by shuffle.
MAX_BROADCAST_SOURCES = 50_000


def n_tokens(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACES}]+"), "")).cast("long")


def _key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def _block(id_col: Column) -> Column:
    return F.substring(F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(id_col.cast("string"), F.lit("")))), 1, 3)


def _order(source: Column, epoch: Column, block: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{SEED}:"), epoch.cast("string"), F.lit(":"), source, F.lit(":"), block))


def find_exponent(sources: DataFrame, target_entropy: float = TARGET_ENTROPY, max_epochs: float = MAX_EPOCHS, budget: float | None = None) -> float:
    """The exponent for a table (source, tokens) of positive totals, to 2**-STEPS of the range in which it lies.

    Where no exponent up to MOST_ALPHA meets the target (sources of equal size have the same shares at any) and none meets the limit
    of repetitions, or the given budget alone is over it, it is 1, the sources' own shares, and a warning says so.
    """
    total, most, n = sources.agg(F.sum("tokens"), F.max("tokens"), F.count("*")).first()
    if not n or n == 1:
        return 1.0

    def at(low: float, high: float, parts: int) -> list[tuple[float, bool, bool]]:
        """(alpha, even enough, few enough passes) of evenly spaced exponents."""
        grid = sources.crossJoin(F.broadcast(sources.sparkSession.range(parts + 1).select(F.lit(low) + F.col("id") * ((high - low) / max(1, parts))).toDF("alpha")))
        p = F.col("tokens") / F.lit(float(total))
        # shares of the largest source, so that large exponents don't vanish
        sums = grid.select("alpha", p.alias("p"), F.pow(p / F.lit(most / total), F.col("alpha")).alias("x")).groupBy("alpha").agg(
            F.sum("x").alias("z"), F.sum(F.when(F.col("x") > 0, F.col("x") * F.log("x")).otherwise(0.0)).alias("xl"), F.max(F.col("x") / F.col("p")).alias("most"), F.min(F.col("x") / F.col("p")).alias("least"))
        entropy = F.log("z") - F.col("xl") / F.col("z")
        passes = F.col("most") / F.col("least") if budget is None else F.col("most") / F.col("z") * (budget / total)
        found = sums.select("alpha", (entropy <= target_entropy * F.log(F.lit(float(n)))).alias("e"), F.coalesce(passes <= max_epochs, F.lit(False)).alias("f")).orderBy("alpha").collect()  # a row for each exponent
        return [(r.alpha, r.e, r.f) for r in found]

    ((_, even, few),) = at(1.0, 1.0, 0)
    low, high = (0.0, 1.0) if even else (1.0, MOST_ALPHA)
    # under 1 the first exponent that meets both limits, over 1 the first that meets the target or breaks the limit
    meets = (lambda e, f: e and f) if even else (lambda e, f: e or not f)
    ok = True
    for _ in range(STEPS // AT_ONCE):
        parts = 1 << AT_ONCE
        found = at(low, high, parts)
        hit = next((i for i, (_, e, f) in enumerate(found) if meets(e, f)), None)
        if not few or hit is None and high in (1.0, MOST_ALPHA):
            warnings.warn(f"no exponent gives an entropy of {target_entropy} of the largest within {max_epochs} passes; the sources keep their shares", stacklevel=2)
            return 1.0
        if hit is None:
            low = high - (high - low) / parts
        else:
            high, low, ok = found[hit][0], found[max(0, hit - 1)][0], found[hit][2]
    return high if ok else low


def source_plan(docs: DataFrame, id_col: str, text_col: str, source_col: str, target_entropy: float, max_epochs: float, budget: float | None) -> DataFrame:
    """(source, tokens, weight, passes, last): whole passes, and the last block order value of the next one."""
    blocks = docs.select(_key(F.col(source_col)).alias("__rl_source"), _block(F.col(id_col)).alias("__rl_block"), n_tokens(F.col(text_col)).alias("n"))
    blocks = cut(blocks.groupBy("__rl_source", "__rl_block").agg(F.sum("n").alias("tokens")))
    sources = cut(blocks.groupBy("__rl_source").agg(F.sum("tokens").alias("tokens")))
    used = sources.filter("tokens > 0")
    alpha = find_exponent(used, target_entropy, max_epochs, budget)
    total = used.agg(F.sum("tokens")).first()[0] or 1
    p = F.col("tokens") / F.lit(float(total))
    largest = used.agg(F.max("tokens")).first()[0] or 1
    x = F.pow(F.col("tokens") / F.lit(float(largest)), F.lit(alpha))
    z, least = used.agg(F.sum(x), F.min(x / p)).first()
    epochs = F.round(x / p / F.lit(least or 1.0) if budget is None else x / p / F.lit(z or 1.0) * F.lit(budget / total), 6)
    plan = sources.select("__rl_source", "tokens", F.when(F.col("tokens") > 0, x / F.lit(z or 1.0)).otherwise(0.0).alias("__rl_weight"), F.when(F.col("tokens") > 0, epochs).otherwise(1.0).alias("__rl_epochs"))
    plan = plan.select("__rl_source", "__rl_weight", F.floor("__rl_epochs").alias("__rl_passes"), ((F.col("__rl_epochs") - F.floor("__rl_epochs")) * F.col("tokens")).alias("__rl_rest"))
    order = _order(F.col("__rl_source"), F.col("__rl_passes"), F.col("__rl_block"))
    ranked = blocks.join(plan, "__rl_source").withColumn("__rl_order", order)
    reach = F.sum("tokens").over(Window.partitionBy("__rl_source").orderBy("__rl_order").rowsBetween(Window.unboundedPreceding, 0))
    last = ranked.withColumn("__rl_reach", reach).filter("__rl_reach <= __rl_rest").groupBy("__rl_source").agg(F.max("__rl_order").alias("__rl_last"))
    return cut(plan.join(last, "__rl_source", "left").select("__rl_source", "__rl_weight", "__rl_passes", "__rl_last"))


def temperature_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", target_entropy: float = TARGET_ENTROPY, max_epochs: float = MAX_EPOCHS, budget: float | None = None, keep: list[str] | None = None) -> DataFrame:
    """The mixture: each row of ``docs`` once for each pass that its block is in, with ``epoch`` (from 0)
    and ``position``, whose order within source and epoch is that of the permuted blocks."""
    plan = source_plan(docs, id_col, text_col, source_col, target_entropy, max_epochs, budget)
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("epoch", "position")]
    src = docs.select(*keep, _key(F.col(source_col)).alias("__rl_source"), _block(F.col(id_col)).alias("__rl_block"))
    small = plan.count() <= MAX_BROADCAST_SOURCES
    out = src.join(F.broadcast(plan) if small else plan, "__rl_source")
    out = out.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__rl_passes"))))
    out = out.withColumn("position", _order(F.col("__rl_source"), F.col("epoch"), F.col("__rl_block")))
    return out.filter((F.col("epoch") < F.col("__rl_passes")) | (F.col("position") <= F.col("__rl_last"))).select(*keep, "epoch", "position")


def op10_mixing(spark, sf_dir):
    return temperature_mix(table(spark, sf_dir, "documents"), keep=["doc_id", "source"])
