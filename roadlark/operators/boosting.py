"""Boosting on histograms: trees that obey monotone directions, and additive models with a shape for each feature.

Both read a table of bins. Gradients are whole numbers, 1 / SCALE each, so that their sums are the same in any order
of the rows. What reaches the driver is one row a node or the sums by bin, never rows of the table.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import bin_index, number, sigmoid
from ..sources.shared import checkpoint

#: Parts of 1 in a gradient.
SCALE = 1 << 24
#: Trees after which the scores are written down.
EVERY = 4


# ---- bins


def fit_edges(df: DataFrame, features: list[str], bins: int) -> list[list[float]]:
    """Up to ``bins`` - 1 thresholds of each feature at even shares of its rows: one pass, a sketch for each feature
    (exact up to 10,000 rows, ranks off by at most 1 in 10,000 beyond)."""
    shares = [i / bins for i in range(bins)]
    row = df.agg(*(F.percentile_approx(number(F.col(c)), shares, 10_000).alias(f"e{i}") for i, c in enumerate(features))).first()
    return [sorted(set(row[f"e{i}"] or [])) for i in range(len(features))]


def binned(features: list[str], edges: list[list[float]]) -> Column:
    """The features' bins: how many thresholds are at most the value. A missing value is in bin 0, beneath all others."""
    one = lambda c, e: F.coalesce(F.when(number(F.col(c)).isNotNull(), bin_index(number(F.col(c)), F.array(*map(F.lit, e)))) if e else F.lit(0), F.lit(0))
    return F.array(*(one(c, e) for c, e in zip(features, edges)))


def _gradients(score: Column, label: Column) -> tuple[Column, Column]:
    p = sigmoid(score)
    return F.round((p - label) * SCALE).cast("long"), F.round(p * (1 - p) * SCALE).cast("long")


def _start(df: DataFrame, label: str) -> tuple[float, int]:
    """Log-odds of the labels, and the number of rows; a single class is kept from infinity by half a row."""
    n, ones = df.agg(F.count(label), F.sum(label)).first()
    if not n:
        raise ValueError("no labelled rows")
    ones = min(max(float(ones), 0.5), n - 0.5)
    return math.log(ones / (n - ones)), n


# ---- monotone trees


@dataclass
class Tree:
    """Nodes as arrays; a leaf has no feature (-1). A row goes left if its bin is at most ``at``."""

    feature: list[int] = field(default_factory=lambda: [-1])
    at: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, at: int, values: tuple[float, float]) -> tuple[int, int]:
        self.feature[node], self.at[node], self.left[node] = feature, at, len(self.feature)
        for v in values:
            for column, x in ((self.feature, -1), (self.at, 0), (self.left, -1), (self.value, v)):
                column.append(x)
        return self.left[node], self.left[node] + 1

    def column(self, bins: Column, of: Callable[[int], Column], node: int = 0) -> Column:
        """``of(leaf)`` of the leaf that a row falls into."""
        if self.feature[node] < 0:
            return of(node)
        go = F.get(bins, F.lit(self.feature[node])) <= self.at[node]
        return F.when(go, self.column(bins, of, self.left[node])).otherwise(self.column(bins, of, self.left[node] + 1))

    def values(self, bins: np.ndarray) -> np.ndarray:
        feature, at, left, node = (np.array(x) for x in (self.feature, self.at, self.left, [0] * len(bins)))
        while (inner := feature[node] >= 0).any():
            go = np.flatnonzero(inner)
            here = node[go]
            node[go] = left[here] + (bins[go, feature[here]] > at[here])
        return np.array(self.value)[node]


@dataclass
class MonotoneTrees:
    features: list[str]
    edges: list[list[float]]
    intercept: float
    rate: float
    trees: list[Tree]

    def transform(self, df: DataFrame, name: str = "p") -> DataFrame:
        """``df`` with the probability of the label; other columns stay as they are."""
        trees, intercept, rate = self.trees, self.intercept, self.rate

        @F.pandas_udf("double")
        def score(bins: pd.Series) -> pd.Series:
            held = np.stack(bins.to_list()) if len(bins) else np.empty((0, 1), np.int64)
            return pd.Series(intercept + rate * sum((t.values(held) for t in trees), np.zeros(len(held))))

        return df.withColumn(name, sigmoid(score(binned(self.features, self.edges))))


def split_gains(src: DataFrame, signs: list[int], bounds: dict[int, tuple[float, float]], penalty: float = 1.0, least_rows: int = 15) -> DataFrame:
    """(node, feature, at, left_rows, right_rows, left_value, right_value, gain) of every split that is allowed, from rows
    (node, g, h, bins): one aggregate of sums by node, feature and bin.

    A leaf's value is -G / (H + penalty), kept within its node's bounds; a split of a feature with sign +1 or -1 is allowed
    only if the values rise or fall with it.
    """
    sums = src.select("node", "g", "h", F.posexplode("bins").alias("feature", "at")).groupBy("node", "feature", "at").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.count("*").alias("n"))
    of = Window.partitionBy("node", "feature")  # as many rows as bins
    upto = of.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    s = sums.select("node", "feature", "at", *(F.sum(c).over(upto).alias(f"l{c}") for c in "ghn"), *(F.sum(c).over(of).alias(f"t{c}") for c in "ghn"))
    s = s.withColumns({f"r{c}": F.col(f"t{c}") - F.col(f"l{c}") for c in "ghn"}).filter((F.col("ln") >= least_rows) & (F.col("rn") >= least_rows))
    bound = lambda i: F.coalesce(*(F.when(F.col("node") == node, F.lit(float(b[i]))) for node, b in bounds.items()))
    weight = lambda side: F.col(f"{side}h") / SCALE + penalty
    value = lambda side: F.greatest(bound(0), F.least(bound(1), -(F.col(f"{side}g") / SCALE) / weight(side)))
    s = s.withColumns({f"{side}v": value(side) for side in "lrt"})
    loss = lambda side: F.col(f"{side}g") / SCALE * F.col(f"{side}v") + weight(side) * F.col(f"{side}v") * F.col(f"{side}v") / 2
    sign = F.get(F.array(*map(F.lit, signs)), F.col("feature"))
    s = s.withColumn("gain", loss("t") - loss("l") - loss("r")).filter(sign * (F.col("rv") - F.col("lv")) >= 0)
    return s.select("node", "feature", "at", F.col("ln").alias("left_rows"), F.col("rn").alias("right_rows"), F.col("lv").alias("left_value"), F.col("rv").alias("right_value"), "gain")


def fit_monotone(df: DataFrame, features: list[str], label: str, signs: dict[str, int] | None = None, rounds: int = 50, depth: int = 3, rate: float = 0.1, penalty: float = 1.0, least_rows: int = 15, bins: int = 64, least_gain: float = 1e-9, key: str | None = None, subsample: float = 1.0, colsample: float = 1.0, seed: int = 42) -> MonotoneTrees:
    """Boosted trees for a 0/1 label whose probability never falls along a feature of sign +1, nor rises along one of -1.

    A tree grows by levels, one aggregate for all nodes of a level; of equal gains the first feature and the lowest bin
    win. Bounds go down the tree: below a split of a signed feature each side stays on its side of the middle of the two
    values. With ``subsample`` a tree sees the rows whose hash of (seed, tree, ``key``) falls under it, with ``colsample`` that share
    of the features. Rows without a label are left out; a missing feature counts as beneath all values.
    """
    if subsample < 1 and key is None:
        raise ValueError("name a key to sample rows by")
    known = df.filter(F.col(label).isNotNull())
    intercept, _ = _start(known, label)
    edges = fit_edges(known, features, bins)
    y, score = F.col(label).cast("double"), F.col("score")
    kept = [F.col(key).alias("key")] if key else []
    src = checkpoint(known.select(*kept, y.alias("y"), binned(features, edges).alias("bins"), F.lit(intercept).alias("score")))
    order, trees = [int((signs or {}).get(c, 0)) for c in features], []
    for number_of in range(rounds):
        rng = random.Random(f"{seed}:{number_of}")
        using = sorted(rng.sample(range(len(features)), max(1, math.ceil(colsample * len(features)))))
        part = src if subsample >= 1 else src.filter(F.pmod(F.xxhash64(F.lit(seed), F.lit(number_of), "key"), F.lit(1 << 20)) < int(subsample * (1 << 20)))
        tree, bounds = Tree(), {0: (-math.inf, math.inf)}
        for _ in range(depth):
            g, h = _gradients(score, F.col("y"))
            rows = part.select(g.alias("g"), h.alias("h"), F.array(*(F.get("bins", F.lit(i)) for i in using)).alias("bins"), tree.column(F.col("bins"), lambda leaf: F.lit(leaf)).alias("node"))
            gains = split_gains(rows.filter(F.col("node").isin(list(bounds))), [order[i] for i in using], bounds, penalty, least_rows)
            best = gains.filter(F.col("gain") > least_gain).groupBy("node").agg(F.max_by(F.struct("feature", "at", "left_value", "right_value"), F.struct("gain", -F.col("feature"), -F.col("at"))).alias("b"))
            found = sorted(best.select("node", "b.*").collect())  # one row for each node of the level
            below = {}
            for node, at_feature, at, left, right in found:
                lo, hi = bounds[node]
                sides = tree.split(node, using[at_feature], at, (left, right))
                middle, sign = (left + right) / 2, order[using[at_feature]]
                below[sides[0]], below[sides[1]] = ((lo, middle), (middle, hi)) if sign > 0 else ((middle, hi), (lo, middle)) if sign < 0 else ((lo, hi), (lo, hi))
            bounds = below
            if not bounds:
                break
        if len(tree.feature) == 1:
            if subsample >= 1 and colsample >= 1:
                break
            continue
        trees.append(tree)
        src = src.withColumn("score", score + rate * tree.column(F.col("bins"), lambda leaf: F.lit(tree.value[leaf])))
        if len(trees) % EVERY == 0:
            src = checkpoint(src)
    return MonotoneTrees(features, edges, intercept, rate, trees)


def falls(model: MonotoneTrees, df: DataFrame, feature: str, sign: int, name: str = "p") -> int:
    """Steps along ``feature``, over all its thresholds and for every row of ``df``, on which the probability goes against ``sign``."""
    edges = model.edges[model.features.index(feature)]
    if not edges:
        return 0
    points = F.array(F.lit(edges[0] - 1.0), *map(F.lit, edges))
    rows = df.select(*(c for c in model.features if c != feature)).withColumn("__row", F.monotonically_increasing_id())
    grid = checkpoint(rows).select("*", F.posexplode(points).alias("__at", feature))
    p = Window.partitionBy("__row").orderBy("__at")  # as many rows as thresholds
    step = F.col(name) - F.lag(name).over(p)
    return model.transform(grid, name).select((sign * step < -1e-12).alias("bad")).agg(F.count_if("bad")).first()[0]


# ---- additive models


@dataclass
class AdditiveModel:
    """score = intercept + a value of each feature's bin + a value of each pair's cell; the shapes have mean 0 over the rows fitted."""

    features: list[str]
    edges: list[list[float]]
    intercept: float
    shapes: list[np.ndarray]
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def terms(self, bins: Column) -> list[Column]:
        one = lambda values, at: F.get(F.array(*(F.lit(float(v)) for v in values)), at)
        own = [one(s, F.get(bins, F.lit(i))) for i, s in enumerate(self.shapes)]
        return own + [one(s.ravel(), F.get(bins, F.lit(i)) * s.shape[1] + F.get(bins, F.lit(j))) for (i, j), s in self.pairs.items()]

    def score(self, bins: Column) -> Column:
        return sum(self.terms(bins), F.lit(float(self.intercept)))

    def transform(self, df: DataFrame, name: str = "p") -> DataFrame:
        """``df`` with the probability and, in ``<name>_terms``, what each feature and pair adds to the score."""
        bins = binned(self.features, self.edges)
        return df.withColumns({name: sigmoid(self.score(bins)), f"{name}_terms": F.array(*self.terms(bins))})

    def table(self, spark: SparkSession) -> DataFrame:
        """(term, bin, low, other, other_bin, other_low, value): the shapes; bin 0 has no lower end."""
        low = lambda i, b: float(self.edges[i][b - 1]) if b else None
        rows = [("intercept", None, None, None, None, None, float(self.intercept))]
        rows += [(self.features[i], b, low(i, b), None, None, None, float(v)) for i, s in enumerate(self.shapes) for b, v in enumerate(s)]
        rows += [(self.features[i], b, low(i, b), self.features[j], c, low(j, c), float(v)) for (i, j), s in self.pairs.items() for b, line in enumerate(s) for c, v in enumerate(line)]
        return spark.createDataFrame(rows, "term string, bin int, low double, other string, other_bin int, other_low double, value double")


def stairs(residual: np.ndarray, weight: np.ndarray, rows: np.ndarray, leaves: int, penalty: float, least_rows: int) -> np.ndarray:
    """The best step function of at most ``leaves`` stretches of bins, each of ``least_rows`` rows, found split by split."""
    cuts = [0, len(residual)]
    r, w, n = (np.concatenate([[0], np.cumsum(x)]) for x in (residual, weight, rows))
    worth = lambda a, b: (r[b] - r[a]) ** 2 / (w[b] - w[a] + penalty)
    while len(cuts) <= leaves:
        best = (1e-12, None)
        for a, b in zip(cuts, cuts[1:]):
            for m in range(a + 1, b):
                if min(n[m] - n[a], n[b] - n[m]) >= least_rows and (gain := worth(a, m) + worth(m, b) - worth(a, b)) > best[0]:
                    best = (gain, m)
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(residual))
    for a, b in zip(cuts, cuts[1:]):
        out[a:b] = (r[b] - r[a]) / (w[b] - w[a] + penalty)
    return out


def quadrants(residual: np.ndarray, weight: np.ndarray, rows: np.ndarray, penalty: float, least_rows: int) -> tuple[float, np.ndarray]:
    """(gain, values) of the best cut of a table into four by one threshold on each side."""
    best, values = 0.0, np.zeros_like(residual, dtype=float)
    whole = residual.sum() ** 2 / (weight.sum() + penalty)
    for b in range(1, residual.shape[0]):
        for c in range(1, residual.shape[1]):
            parts = [(x, y) for x in (slice(0, b), slice(b, None)) for y in (slice(0, c), slice(c, None))]
            if min(rows[p].sum() for p in parts) < least_rows:
                continue
            gain = sum(residual[p].sum() ** 2 / (weight[p].sum() + penalty) for p in parts) - whole
            if gain > best + 1e-12:
                best, values = gain, np.zeros_like(residual, dtype=float)
                for p in parts:
                    values[p] = residual[p].sum() / (weight[p].sum() + penalty)
    return best, values


def _tables(src: DataFrame, score: Column, sizes: list[int], pairs: list[tuple[int, int]]) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(-gradient, weight, rows) by the bins of each feature (i, i) and each pair (i, j): one aggregate, as many rows as cells."""
    g, h = _gradients(score, F.col("y"))
    asked = [*((i, i) for i in range(len(sizes))), *pairs]
    cell = F.array(*(F.struct(F.lit(k).alias("k"), F.get("bins", F.lit(i)).alias("b"), F.get("bins", F.lit(j)).alias("c")) for k, (i, j) in enumerate(asked)))
    sums = src.select(g.alias("g"), h.alias("h"), F.inline(cell)).groupBy("k", "b", "c").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.count("*").alias("n")).toArrow()
    k, b, c, gs, hs, ns = (sums.column(x).to_numpy() for x in ("k", "b", "c", "g", "h", "n"))
    out = {}
    for at, (i, j) in enumerate(asked):
        own = k == at
        held = tuple(np.zeros((sizes[i], sizes[j])) for _ in range(3))
        for table, x in zip(held, (-gs[own] / SCALE, hs[own] / SCALE, ns[own])):
            table[b[own], c[own]] = x
        out[i, j] = tuple(np.diag(t).copy() for t in held) if i == j else held
    return out


def fit_additive(df: DataFrame, features: list[str], label: str, rounds: int = 8, sweeps: int = 10, rate: float = 0.2, leaves: int = 3, penalty: float = 1e-3, least_rows: int = 20, bins: int = 32, pairs: int = 0, pair_rounds: int = 5) -> AdditiveModel:
    """A boosted additive model for a 0/1 label: one feature at a time in a cycle, a small step function each.

    A round reads the table once, for the sums of gradients by bin and of weights by pairs of bins. On these the effect of one
    feature's step on the residual sums of every other is known exactly, to the second order of the loss, so all ``sweeps`` of a round
    are cycles over sums. The pairs whose residual table has most to gain from a cut into four then get tables of their own,
    ``pairs`` at most. Features are as many as can be paired: the sums have a row for each cell of each pair.
    Rows without a label are left out; a missing feature has bin 0 for itself.
    """
    known = df.filter(F.col(label).isNotNull())
    intercept, _ = _start(known, label)
    edges = fit_edges(known, features, bins)
    sizes = [len(e) + 1 for e in edges]
    src = checkpoint(known.select(F.col(label).cast("double").alias("y"), binned(features, edges).alias("bins")))
    model = AdditiveModel(features, edges, intercept, [np.zeros(n) for n in sizes])
    every = [(i, j) for i in range(len(features)) for j in range(i + 1, len(features))]
    rows: list[np.ndarray] = []
    for _ in range(rounds):
        sums = _tables(src, model.score(F.col("bins")), sizes, every)
        residual, weight, rows = ([sums[i, i][x] for i in range(len(features))] for x in range(3))
        joint = lambda i, j: sums[i, j][1] if i < j else sums[j, i][1].T  # noqa: E731, B023
        for _ in range(sweeps):
            shift = rate * residual[0].sum() / (weight[0].sum() + penalty)
            model.intercept += shift
            for i in range(len(features)):
                residual[i] = residual[i] - weight[i] * shift
            for i in range(len(features)):
                step = rate * stairs(residual[i], weight[i], rows[i], leaves, penalty, least_rows)
                model.shapes[i] = model.shapes[i] + step
                for j in range(len(features)):
                    residual[j] = residual[j] - (weight[i] * step if i == j else joint(j, i) @ step)
    if pairs and every:
        sums = _tables(src, model.score(F.col("bins")), sizes, every)
        gains = {p: quadrants(*sums[p], penalty, least_rows)[0] for p in every}
        chosen = sorted((p for p in every if gains[p] > 0), key=lambda p: (-gains[p], p))[:pairs]
        model.pairs = {p: np.zeros((sizes[p[0]], sizes[p[1]])) for p in chosen}
        for _ in range(pair_rounds if chosen else 0):
            sums = _tables(src, model.score(F.col("bins")), sizes, chosen)
            for p in chosen:
                model.pairs[p] = model.pairs[p] + quadrants(*sums[p], penalty, least_rows)[1] / len(chosen)
        for p in chosen:
            model.intercept += (mean := float((model.pairs[p] * sums[p][2]).sum() / sums[p][2].sum()))
            model.pairs[p] = model.pairs[p] - mean
    for i, n in enumerate(rows):
        model.intercept += (mean := float((model.shapes[i] * n).sum() / n.sum()))
        model.shapes[i] = model.shapes[i] - mean
    return model
