"""Models with pyspark.ml: clustering with a choice of k, cross-fitted classifiers, fusion.

Boosted additive models of other libraries have no counterpart in pyspark.ml; gradient-boosted
trees stand in for them. Monotone constraints on trees are not supported there.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import logit, number, sigmoid
from .evaluation import auc


def to_vector(df: DataFrame, cols: list[str] | str, name: str = "features") -> DataFrame:
    if isinstance(cols, str):
        return df.withColumn(name, array_to_vector(F.col(cols).cast("array<double>")))
    return VectorAssembler(inputCols=cols, outputCol=name, handleInvalid="keep").transform(df)


def kmeans_by_silhouette(df: DataFrame, ks: range, features: str = "features", seed: int = 42) -> tuple[DataFrame, int, list[tuple[int, float]]]:
    """Clusters for the k of the best silhouette, the smaller of equals; (assigned, k, scores)."""
    best, scores = None, []
    for k in ks:
        out = KMeans(k=k, seed=seed, featuresCol=features, predictionCol="cluster").fit(df).transform(df)
        s = ClusteringEvaluator(featuresCol=features, predictionCol="cluster").evaluate(out)
        scores.append((k, s))
        if best is None or s > best[2]:
            best = (out, k, s)
    return best[0], best[1], scores


ESTIMATORS = {
    "logistic": lambda seed: LogisticRegression(regParam=0.1, maxIter=50),
    "forest": lambda seed: RandomForestClassifier(numTrees=40, maxDepth=5, seed=seed),
    "boosted": lambda seed: GBTClassifier(maxIter=20, maxDepth=3, seed=seed),
}


def out_of_fold(df: DataFrame, features: list[str], label: str, fold: str, folds: list[int], kind: str | Callable = "logistic", seed: int = 42, name: str = "p") -> DataFrame:
    """``kind`` names an estimator or makes one from a seed. Each row with ``p`` (or ``name``) from a model that has not seen its fold; scaling is fitted on training rows too."""
    parts = []
    for f in folds:
        train, test = (to_vector(df.filter(c), features, "__raw") for c in (F.col(fold) != f, F.col(fold) == f))
        scaler = StandardScaler(inputCol="__raw", outputCol="features", withMean=True).fit(train)
        model = (ESTIMATORS[kind] if isinstance(kind, str) else kind)(seed).setLabelCol(label).setFeaturesCol("features").fit(scaler.transform(train))
        p = vector_to_array("probability")[1]
        parts.append(model.transform(scaler.transform(test)).withColumn(name, p).select(*(c for c in df.columns if c != name), name))
    return reduce(DataFrame.unionByName, parts)


def nested_selection(df: DataFrame, features: list[str], label: str, fold: str, folds: list[int], kinds: list[str]) -> list[tuple[int, str]]:
    """For each outer fold the kind of best inner out-of-fold AUC; ties go to the first named."""
    chosen = []
    for f in folds:
        inner = df.filter(F.col(fold) != f)
        rest = [g for g in folds if g != f]
        scores = [(auc(out_of_fold(inner, features, label, fold, rest, k), "p", label).first().auc or 0.0, -i) for i, k in enumerate(kinds)]
        chosen.append((f, kinds[-max(scores)[1]]))
    return chosen


def logit_fusion(weights: dict[str, float]) -> Column:
    """Weighted mean of members' logits, back to a probability; weights must be positive with sum 1."""
    if any(w <= 0 for w in weights.values()) or abs(sum(weights.values()) - 1) > 1e-9:
        raise ValueError("weights must be positive and have sum 1")
    return sigmoid(reduce(lambda a, b: a + b, [w * logit(F.col(c)) for c, w in weights.items()]))


def best_alpha(df: DataFrame, a: str, b: str, label: str, alphas: list[float], least_auc: float = 0.0) -> tuple[float | None, float | None]:
    """The blend weight of best AUC over a grid; the larger of equals; none under ``least_auc``."""
    grid = df.join(F.broadcast(df.sparkSession.createDataFrame([(x,) for x in alphas], "alpha double")))  # the grid is a parameter
    scored = auc(grid.withColumn("__b", F.round(F.col("alpha") * F.col(a) + (1 - F.col("alpha")) * F.col(b), 12)), "__b", label, ["alpha"])
    row = scored.filter(F.col("auc") >= least_auc).orderBy(F.desc("auc"), F.desc("alpha")).first()
    return (row.alpha, row.auc) if row else (None, None)


def group_calibration(df: DataFrame, p: str, label: str, group: str, n0: float = 50.0) -> DataFrame:
    """Logit shift of each group towards its observed odds, shrunk by n / (n + n0)."""
    g = df.groupBy(group).agg(F.count("*").alias("__n"), F.avg(label).alias("__y"), F.avg(p).alias("__p"))
    shift = F.col("__n") / (F.col("__n") + n0) * (logit(F.col("__y"), 1e-3) - logit(F.col("__p"), 1e-3))
    return df.join(g.select(group, shift.alias("__s")), group).withColumn("calibrated", sigmoid(logit(F.col(p)) + F.col("__s"))).drop("__s")


def cluster_drivers(model: KMeansModel, features: list[str], k: int = 10) -> list[tuple[int, int, str, float]]:
    """(cluster, rank, feature, centre) of the k features whose standardised centre is largest in size; ties by position."""
    out = []
    for c, centre in enumerate(model.clusterCenters()):
        order = sorted(range(len(centre)), key=lambda i: (-abs(centre[i]), i))[:k]
        out += [(c, rank, features[i], float(centre[i])) for rank, i in enumerate(order, 1)]
    return out


def full_fit(train: DataFrame, test: DataFrame, features: list[str], label: str, members: dict[str, str], weights: dict[str, float], seeds: tuple[int, ...] = (42, 7, 2024)) -> DataFrame:
    """``test`` with ``p``: each member (name -> kind) fitted to all of ``train`` for each seed, its probabilities averaged
    over the seeds and the members fused by weighted logits."""
    out = test
    for name, kind in members.items():
        for seed in seeds:
            both = [to_vector(df, features, "__raw") for df in (train, out)]
            scaler = StandardScaler(inputCol="__raw", outputCol="__features", withMean=True).fit(both[0])
            model = (ESTIMATORS[kind] if isinstance(kind, str) else kind)(seed).setLabelCol(label).setFeaturesCol("__features").setPredictionCol("__hat").setProbabilityCol("__prob").setRawPredictionCol("__score").fit(scaler.transform(both[0]))
            out = model.transform(scaler.transform(both[1])).withColumn(f"__p_{name}_{seed}", vector_to_array("__prob")[1]).drop("__raw", "__features", "__hat", "__prob", "__score")
    mean = {name: sum((F.col(f"__p_{name}_{s}") for s in seeds[1:]), F.col(f"__p_{name}_{seeds[0]}")) / len(seeds) for name in members}
    return out.withColumns({f"__m_{n}": c for n, c in mean.items()}).withColumn("p", logit_fusion({f"__m_{n}": w for n, w in weights.items()})).select(*test.columns, "p")


def save_model(model, path: str) -> None:
    """A fitted model below a path that isn't there yet."""
    model.write().save(path)


def platt(df: DataFrame, p: str, label: str) -> tuple[float, float]:
    """Slope and intercept of a logistic fit of the label to logit(p)."""
    src = to_vector(df.select(logit(F.col(p)).alias("__z"), F.col(label).cast("double").alias("label")), ["__z"])
    m = LogisticRegression(maxIter=100, standardization=False).fit(src)
    return float(m.coefficients[0]), float(m.intercept)


def platt_by_group(train: DataFrame, p: str, label: str, group: str, own: list, shrunk: list, least_rows: int = 30, least_positives: int = 5) -> Callable[[float], Column]:
    """From logistic fits of ``train`` a function of n0 that gives the calibrated probability as a column: groups in ``own`` by their own
    fit, those in ``shrunk`` by n / (n + n0) of theirs and the rest of that of all rows, in logits; other groups, and those with few
    rows or positives or one class only, by that of all rows. The groups are parameters, so few."""
    slope, cut = platt(train, p, label)
    z = logit(F.col(p))
    sizes = {r[group]: (r["__n"], r["__k"]) for r in train.filter(F.col(group).isin(*own, *shrunk)).groupBy(group).agg(F.count("*").alias("__n"), F.sum(label).alias("__k")).collect()}
    fits = {g: (*platt(train.filter(F.col(group) == g), p, label), n) for g, (n, k) in sizes.items() if n >= least_rows and least_positives <= k < n}

    def calibrated(n0: float) -> Column:
        whole = out = slope * z + cut
        for g, (a, b, n) in fits.items():
            w = 1.0 if g in own else n / (n + n0)
            out = F.when(F.col(group) == g, w * (a * z + b) + (1 - w) * whole).otherwise(out)
        return sigmoid(out)

    return calibrated


def best_n0(df: DataFrame, p: str, label: str, group: str, own: list, shrunk: list, fold: str, grid: list[float], splits: int = 3) -> float:
    """The n0 of best mean AUC over splits of the folds, each fitted on the others; the larger of equals. Splits with one class don't count."""
    found: dict[float, list[float]] = {n0: [] for n0 in grid}
    for h in range(splits):
        fit, held = df.filter(F.col(fold) % splits != h), df.filter(F.col(fold) % splits == h)
        if fit.select(label).distinct().count() < 2 or held.select(label).distinct().count() < 2:
            continue
        at = platt_by_group(fit, p, label, group, own, shrunk)
        for n0 in grid:
            found[n0].append(auc(held.withColumn("__c", F.round(at(n0), 12)), "__c", label).first().auc)
    return max(grid, key=lambda n0: (sum(found[n0]) / len(found[n0]) if found[n0] else 0.5, n0))


def monotone_curves(train: DataFrame, xs: list[str], y: str, bins: int) -> dict[str, Column]:
    """For each feature a non-decreasing step function fitted to ``y``: the pooled means of its quantile bins; below the first bin's least value
    it is the first, a missing value has the mean of all rows."""
    from .rules import fit_bins

    mean = train.agg(F.avg(y)).first()[0]
    out = {}
    for x in xs:
        steps = fit_bins(train, x, y, bins).orderBy("low").collect()  # a row for each bin
        curve = F.lit(steps[0].risk) if steps else F.lit(mean)
        for r in steps[1:]:
            curve = F.when(F.col(x) >= r.low, r.risk).otherwise(curve)
        out[x] = F.when(number(F.col(x)).isNull(), mean).otherwise(curve)
    return out


def cross_fit(df: DataFrame, xs: list[str], y: str, fold: str, folds: list[int], penalty: float = 1.0, bins: int | None = None) -> DataFrame:
    """Each row with ``distilled``, a non-negative ridge of the other folds, for the fidelity to ``y`` out of fold; with ``bins`` over monotone
    curves of the features, which those folds fit too."""
    from .rules import nonnegative_ridge

    parts = []
    for f in folds:
        train = df.filter(F.col(fold) != f)
        made = monotone_curves(train, xs, y, bins) if bins else {x: F.col(x) for x in xs}
        names = [f"__c{i}" for i in range(len(xs))]
        w = nonnegative_ridge(train.withColumns(dict(zip(names, made.values()))), names, y, penalty)
        parts.append(df.filter(F.col(fold) == f).withColumn("distilled", sum((F.lit(a) * c for a, c in zip(w, made.values())), F.lit(w[-1]))))
    return reduce(DataFrame.unionByName, parts)


def fidelity(df: DataFrame, a: str, b: str, by: float = 0.2) -> DataFrame:
    """How well ``a`` stands for ``b``: Pearson, mean distance, that of the penalties in points of 100, and the share of rows on the same side of the 1 - ``by`` quantile."""
    from .windows import exact_quantiles

    cut = exact_quantiles(df, a, {"__ca": 1 - by}).drop("n").crossJoin(exact_quantiles(df, b, {"__cb": 1 - by}).drop("n"))  # one row each
    same = ((F.col(a) >= F.col("__ca")) == (F.col(b) >= F.col("__cb"))).cast("double")
    return df.join(F.broadcast(cut)).agg(F.corr(a, b).alias("pearson"), F.avg(F.abs(F.col(a) - F.col(b))).alias("distance"), F.avg(F.abs(100 * F.col(a) - 100 * F.col(b))).alias("penalty_mae"), F.avg(same).alias("same_side"))


def fused_views(df: DataFrame, arms: dict[str, str], label: str, keep: int = 4) -> tuple[list[tuple[str, str, float]], DataFrame]:
    """The best arm of each view (``arms``: score column -> view), the ``keep`` best of these, and ``df`` with a column
    ``fuse_<a>__<b>`` for every pair of them, by equal logit weights. Arms by AUC, ties to the later name; views by AUC, ties to the earlier."""
    found = {a: auc(df, a, label).first().auc for a in arms}  # one number for each arm
    rank = lambda a: (found[a] if found[a] is not None else -1.0, a)
    best = {v: max((a for a in arms if arms[a] == v), key=rank) for v in arms.values()}
    views = sorted(best, key=lambda v: (-rank(best[v])[0], v))[:keep]
    chosen = [best[v] for v in views]
    fused = {f"fuse_{a}__{b}": logit_fusion({a: 0.5, b: 0.5}) for i, a in enumerate(chosen) for b in chosen[i + 1:]}
    return [(v, best[v], found[best[v]]) for v in views], df.withColumns(fused) if fused else df


def clusters_with_rank(df: DataFrame, ks: range, features: list[str], index: str, eligible: Column) -> tuple[DataFrame, int]:
    """``df`` with ``cluster`` and ``risk_rank``: standardised eligible rows in the k of best silhouette, clusters ranked from 1 by
    their mean ``index``, lowest first, ties by cluster. Rows that are not eligible or lack a feature are -1 in both; if fewer rows than
    ``ks`` starts with are left, all are."""
    whole = F.coalesce(eligible, F.lit(False))
    for c in features:
        whole = whole & number(F.col(c)).isNotNull()
    fit = to_vector(df.filter(whole), features, "__raw")
    none = df.withColumns({"cluster": F.lit(-1), "risk_rank": F.lit(-1)})
    n = df.filter(whole).count()
    ks = [k for k in ks if k < n]
    if not ks:
        return none, 0
    scaled = StandardScaler(inputCol="__raw", outputCol="__features", withMean=True).fit(fit).transform(fit)
    out, k, _ = kmeans_by_silhouette(scaled, ks, "__features")
    means = out.groupBy("cluster").agg(F.avg(index).alias("__mean"))  # k rows
    ranks = means.select("cluster", F.row_number().over(Window.orderBy("__mean", "cluster")).alias("risk_rank"))
    found = out.join(F.broadcast(ranks), "cluster").select(*df.columns, "cluster", "risk_rank")
    return found.unionByName(none.filter(~whole)), k


def risk_group(df: DataFrame, rank: str = "risk_rank") -> DataFrame:
    """``df`` with ``risk_group``: -1 or null is 'insufficient', the highest rank 'high', all others 'low'."""
    top = df.agg(F.max(rank).alias("__top"))  # one row
    return df.join(F.broadcast(top)).withColumn("risk_group", F.when(F.coalesce(F.col(rank), F.lit(-1)) < 0, "insufficient").when(F.col(rank) == F.col("__top"), "high").otherwise("low")).drop("__top")


def blend_residuals(df: DataFrame, features: list[str], label: str, fold: str, folds: list[int], group: str, groups: list, inner: dict[int, str], outer: str, grid: tuple[float, ...] = (0.0, 0.1, 0.2, 0.3, 0.5), least_rows: int = 40, least_positives: int = 8, least_gain: float = 1e-4) -> tuple[DataFrame, list[tuple[int, object, float]]]:
    """(``df`` with ``blended``, [(fold, group, lambda)]): a probability and that of a model of what it leaves unexplained, in logits.

    ``outer`` is the probability of a row from models that haven't seen its fold, ``inner[k]`` that of the rows outside fold k from models that
    have seen neither their own fold nor k. For each fold and each of ``groups``, logistic models of ``features`` and the
    logit of the probability are fitted on the rows outside the fold, leaving out one of their folds in turn; the lambda of the grid whose blend
    (1 - lambda) base + lambda residual has the best AUC there is taken, 0 unless it gains over ``least_gain``, the smaller of equals. The fold's
    own rows are blended with a model of all rows outside it and have no say. Groups with few rows or positives, one class or fewer
    than two folds, and all other groups, keep the base.
    """
    parts, chosen = [], []
    taken = F.coalesce(F.col(group).isin(groups), F.lit(False))
    for k in folds:
        held, rest = df.filter(F.col(fold) == k), df.filter(F.col(fold) != k)
        parts.append(held.filter(~taken).withColumn("blended", F.col(outer)))
        for g in groups:
            test = held.filter(F.col(group) == g)
            train = rest.filter(F.col(group) == g).withColumn("__z", logit(F.col(inner[k])))
            sizes = train.groupBy(fold).agg(F.count("*").alias("n"), F.sum(label).alias("k")).collect()  # a row for each fold
            n, ones = sum(r.n for r in sizes), sum(r.k for r in sizes)
            best, names = 0.0, [*features, "__z"]
            apart = [r[fold] for r in sizes if 0 < ones - r.k < n - r.n]
            if n >= least_rows and least_positives <= ones < n and len(sizes) > 1 and len(apart) == len(sizes):
                seen = out_of_fold(train, names, label, fold, sorted(apart), name="__r")
                blends = F.array(*(F.struct(F.lit(x).alias("lam"), F.round((1 - x) * F.col("__z") + x * logit(F.col("__r")), 12).alias("b")) for x in grid))
                found = {r.lam: r.auc for r in auc(seen.select(label, F.inline(blends)), "b", label, ["lam"]).collect()}
                top = max(sorted(grid), key=lambda x: (found[x] if found[x] is not None else -1.0, -x))
                best = top if found.get(0.0) is None or found[top] > found[0.0] + least_gain else 0.0
            chosen.append((k, g, best))
            if best:
                at = test.withColumn("__z", logit(F.col(outer))).withColumn("__part", F.lit(1))
                whole = train.withColumn("__part", F.lit(0))
                made = out_of_fold(whole.unionByName(at), names, label, "__part", [1], name="__r")
                test = made.withColumn("blended", sigmoid((1 - best) * F.col("__z") + best * logit(F.col("__r"))))
                parts.append(test.select(*df.columns, "blended"))
            else:
                parts.append(test.withColumn("blended", F.col(outer)))
    return reduce(DataFrame.unionByName, parts), chosen
