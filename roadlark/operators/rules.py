"""Transparent scoring: monotone bins, rulesets with ledgers, daily replay."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .aggregates import diminishing
from .scans import scan_by_key
from .windows import exact_quantiles, running
from ..functions.scalars import ratio


def pool_adjacent(values: list[float], weights: list[float]) -> list[float]:
    """Non-decreasing weighted least-squares fit, one value for each input: at each place the largest, over
    where a stretch begins at or before it, of the least weighted means of stretches that end at or after it."""
    n = len(values)
    if not n:
        return []
    w, wv = (np.concatenate([[0.0], np.cumsum(x)]) for x in (np.asarray(weights, float), np.asarray(weights, float) * np.asarray(values, float)))
    begin, end = np.arange(n)[:, None], np.arange(1, n + 1)[None, :]
    with np.errstate(divide="ignore", invalid="ignore"):
        mean = np.where(end > begin, (wv[1:][None, :] - wv[:-1][:, None]) / (w[1:][None, :] - w[:-1][:, None]), np.inf)
    least = np.minimum.accumulate(mean[:, ::-1], axis=1)[:, ::-1]  # [i, j]: over ends at j or later
    return [float(least[: j + 1, j].max()) for j in range(n)]


def pooled_ends(values: list[float], weights: list[float]) -> list[int]:
    """Where the stretches of the fit end: after each place up to which no stretch has a greater mean than any that begins behind it."""
    means = lambda v, w: np.cumsum(np.multiply(v, w)) / np.cumsum(w)
    n = len(values)
    return [j for j in range(n) if j == n - 1 or means(values[: j + 1][::-1], weights[: j + 1][::-1]).max() <= means(values[j + 1 :], weights[j + 1 :]).min()]


def order_statistics(df: DataFrame, x: str, places: list[int]) -> list[float]:
    """The values at places of the sorted column, from 0, from counts by value; a row for each place reaches the driver."""
    counts = running(df.filter(F.col(x).isNotNull()).groupBy(F.col(x).cast("double").alias("v")).agg(F.count("*").alias("n")), ["v"], {"before": "n"})
    held = counts.filter(F.exists(F.array(*map(F.lit, places)), lambda k: (k >= F.col("before")) & (k < F.col("before") + F.col("n")))).collect() if places else []
    return [next(r.v for r in held if r.before <= k < r.before + r.n) for k in places]


def fit_bins(df: DataFrame, x: str, y: str, n: int = 4, compress: bool = False, compat: bool = False) -> DataFrame:
    """Quantile bins of x with the monotone mean of y: (bin, low, n, risk). At most n rows reach the driver.

    ``compress`` makes one bin of neighbours of equal risk. ``compat`` is the rule as it is in use: edges are the values at the rounded places k N / n,
    and each stretch of the fit, once, is paired with the bins in order, so that pooling shifts the edges and the last bins are left out; then it compresses.
    """
    if compat:
        known = df.filter(F.col(x).isNotNull()).count()
        found = order_statistics(df, x, [min(known - 1, round(k * known / n)) for k in range(1, n)]) if known else []
        found = [] if len(set(order_statistics(df, x, [0, known - 1]) if known else [])) < 2 else found
    else:
        found = exact_quantiles(df, x, {f"q{i}": i / n for i in range(1, n)}).drop("n").first()
    edges = sorted({v for v in found if v is not None})
    b = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= F.col(x))) if edges else F.lit(0)
    rows = df.filter(F.col(x).isNotNull()).groupBy(b.alias("bin")).agg(F.min(x).alias("low"), F.count("*").alias("n"), F.avg(y).alias("mean")).orderBy("bin").collect()
    means, sizes = [r.mean for r in rows], [r.n for r in rows]
    risk = pool_adjacent(means, sizes)
    if compat:
        risk = [risk[j] for j in pooled_ends(means, sizes)]
    out: list[list] = []
    for r, v in zip(rows, risk):
        if out and (compress or compat) and abs(out[-1][3] - v) <= 1e-12:
            out[-1][2] += r.n
        else:
            out.append([r.bin, float(r.low), r.n, float(v)])
    return df.sparkSession.createDataFrame([tuple(r) for r in out], "bin int, low double, n long, risk double")


def score_with_ledger(rates: DataFrame, ruleset: DataFrame, key: str, budget: float = 100.0) -> tuple[DataFrame, DataFrame]:
    """(scores, ledger) of (key, cls, grp, x) rows under (cls, bin, low, risk) rules.

    Points of a class: its even share of the budget times risk / largest risk; a group's deduction is
    its largest class and a quarter of the mean of the rest; score = 100 less all, within 0 to 100.
    """
    n_classes = ruleset.select("cls").distinct().count()
    top = ruleset.groupBy("cls").agg(F.max("risk").alias("top"))
    w = Window.partitionBy("cls").orderBy("low")
    spans = ruleset.withColumn("high", F.lead("low").over(w)).join(top, "cls")
    # A ruleset has a few rows for each event class: a fixed vocabulary.
    met = rates.join(F.broadcast(spans), "cls").filter(((F.col("x") >= F.col("low")) | (F.col("bin") == 0)) & (F.col("high").isNull() | (F.col("x") < F.col("high"))))
    ledger = met.select(key, "grp", "cls", "x", "bin", (F.lit(budget / max(n_classes, 1)) * F.coalesce(ratio(F.col("risk"), F.col("top")), F.lit(0.0))).alias("points"))
    groups = ledger.groupBy(key, "grp").agg(diminishing("points").alias("deduction"))
    return groups.groupBy(key).agg(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 - F.sum("deduction"))).alias("score")), ledger


def presence_baseline(df: DataFrame, key: str, dimension: str, active: Column, least: int = 3) -> DataFrame:
    """100 (1 - active / eligible) by dimension, and their mean where ``least`` dimensions have data."""
    d = df.groupBy(key, dimension).agg((100 * (1 - F.avg(active.cast("double")))).alias("part"))
    return d.groupBy(key).agg(F.count("*").alias("dimensions"), F.when(F.count("*") >= least, F.avg("part")).alias("score"))


def resolve_review(status: Column, age_days: Column, deadline: int = 3) -> Column:
    """Evidence that counts: valid; pending once it is ``deadline`` days old; exempt and rejected never."""
    return F.when(status == "valid", True).when(status == "pending", age_days >= deadline).otherwise(False)


def hysteresis(values: Column, enter: float, leave: float) -> Column:
    """State after an array of values: 1 at first, 0 under ``enter``, 1 again over ``leave``."""
    return F.aggregate(values, F.lit(1), lambda s, x: F.when((s == 1) & (x < enter), 0).when((s == 0) & (x > leave), 1).otherwise(s))


def replay(days: DataFrame, key: str, day: str, points: str, exposure: str, half_life: float = 7.0, prior: float = 80.0, k: float = 5.0, recovery: float = 2.0) -> DataFrame:
    """Daily published scores: points decay by exposure days, shrink to the prior by cumulative exposure,
    rise by at most ``recovery`` a day, and stay frozen on days without exposure.

    Sequential within a key; sorted partitions are read once with one key's state in memory. A null key is a key.
    """
    decay = 0.5 ** (1 / half_life)

    def step(state: list, row: tuple) -> list[tuple]:
        who, at, x, e = row
        if observed := bool(e and e > 0):
            risk, seen, score = state
            risk, seen = decay * risk + (x or 0.0), seen + e
            trust = seen / (seen + k)
            state[:] = risk, seen, min(trust * max(0.0, 100.0 - risk) + (1 - trust) * prior, score + recovery)
        return [(who, at, state[2], observed)]

    src = days.select(key, day, points, exposure)
    kinds = dict(src.dtypes)
    return scan_by_key(src, [key], [day], lambda row: [0.0, 0.0, prior], step, f"{key} {kinds[key]}, {day} {kinds[day]}, score double, observed boolean")


def nonnegative_ridge(df: DataFrame, xs: list[str], y: str, penalty: float = 1.0, rounds: int = 200) -> list[float]:
    """Coefficients >= 0 and a free intercept (last), by coordinate descent on the Gram matrix, which
    is one aggregate of len(xs)^2 sums."""
    cols = [*xs, "__one"]
    src = df.withColumn("__one", F.lit(1.0))
    row = src.agg(*(F.sum(F.col(a) * F.col(b)).alias(f"{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if i <= j), *(F.sum(F.col(a) * F.col(y)).alias(f"y{i}") for i, a in enumerate(cols))).first()
    n = len(cols)
    g = np.array([[float(row[f"{min(i, j)}_{max(i, j)}"] or 0) for j in range(n)] for i in range(n)])
    r, w = np.array([float(row[f"y{i}"] or 0) for i in range(n)]), np.zeros(n)
    for _ in range(rounds):
        for i in range(n):
            rest = r[i] - g[i] @ w + g[i, i] * w[i]
            w[i] = rest / g[i, i] if i == n - 1 and g[i, i] else max(0.0, rest / (g[i, i] + penalty)) if i < n - 1 else 0.0
    return w.tolist()
