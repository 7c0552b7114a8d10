"""Queries over fitted models: monotone trees and additive shapes from counts of events by user, quantile transforms, blended residuals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import boosting, cleaning, models
from ..operators.fold_transform import FoldTransform
from .evaluation import _D, scored
from .registry import AS_OF, query, r6, table

_KINDS = ("click", "error", "purchase", "signup", "view")
_SIGNS = {"click": 1, "error": 1}


def exposed(spark, sf_dir):
    """(user_id, counts by type before the cut-off, y: an error after it)."""
    ev, before = table(spark, sf_dir, "events"), F.col("ts") < AS_OF
    counts = [F.count_if(before & (F.col("event_type") == k)).cast("double").alias(k) for k in _KINDS]
    return ev.groupBy("user_id").agg(*counts, F.max((~before & (F.col("event_type") == "error")).cast("int")).alias("y"))


@query(f"""
WITH u AS (SELECT user_id, {', '.join(f"count(*) FILTER (ts < TIMESTAMP '{AS_OF}' AND event_type = '{k}') AS {k}" for k in _KINDS)}, max((ts >= TIMESTAMP '{AS_OF}' AND event_type = 'error')::INT) y FROM events GROUP BY 1),
b AS (SELECT y, unnest([{', '.join(f"'{k}'" for k in _KINDS)}]) "feature", least(unnest([{', '.join(_KINDS)}]), 15) "at" FROM u),
s AS (SELECT "feature", "at", sum(0.5 - y)::DOUBLE g, sum(0.25)::DOUBLE h, count(*) n FROM b GROUP BY 1, 2),
c AS (SELECT "feature", "at", sum(g) OVER o lg, sum(h) OVER o lh, sum(n) OVER o ln, sum(g) OVER w tg, sum(h) OVER w th, sum(n) OVER w tn FROM s WINDOW w AS (PARTITION BY "feature"), o AS (PARTITION BY "feature" ORDER BY "at" ROWS UNBOUNDED PRECEDING)),
v AS (SELECT *, -lg / (lh + 1) lv, -(tg - lg) / (th - lh + 1) rv, -tg / (th + 1) tv FROM c WHERE ln >= 15 AND tn - ln >= 15),
q AS (SELECT *, (tg * tv + (th + 1) * tv * tv / 2) - (lg * lv + (lh + 1) * lv * lv / 2) - ((tg - lg) * rv + (th - lh + 1) * rv * rv / 2) gain FROM v WHERE "feature" NOT IN ('click', 'error') OR rv >= lv)
SELECT "feature", "at"::INT "at", ln::BIGINT left_rows, (tn - ln)::BIGINT right_rows, round(lv, 6) left_value, round(rv, 6) right_value, round(gain, 6) gain FROM q""")
def monotone_splits(spark, sf_dir):
    """Every split of the first node that the monotone directions allow, with its values and its gain."""
    u = exposed(spark, sf_dir)
    bins = F.array(*(F.least(F.col(k), F.lit(15.0)).cast("int") for k in _KINDS))
    half = boosting.SCALE // 2
    rows = u.select(F.lit(0).alias("node"), (half - F.col("y") * boosting.SCALE).cast("long").alias("g"), F.lit(half // 2).cast("long").alias("h"), bins.alias("bins"))
    gains = boosting.split_gains(rows, [_SIGNS.get(k, 0) for k in _KINDS], {0: (-float("inf"), float("inf"))})
    name = F.get(F.array(*map(F.lit, _KINDS)), F.col("feature"))
    return gains.select(name.alias("feature"), "at", "left_rows", "right_rows", *(r6(c).alias(c) for c in ("left_value", "right_value", "gain")))


@query()
def monotone_boosting(spark, sf_dir):
    """Out-of-fold probabilities of trees that never fall with clicks or errors."""
    u = exposed(spark, sf_dir).withColumn("fold", (F.col("user_id") % 2).cast("int"))
    out = None
    for f in (0, 1):
        model = boosting.fit_monotone(u.filter(F.col("fold") != f), list(_KINDS), "y", _SIGNS, rounds=6, rate=0.3, key="user_id", subsample=0.8)
        part = model.transform(u.filter(F.col("fold") == f)).select("user_id", "fold", "y", r6("p").alias("p"))
        out = part if out is None else out.unionByName(part)
    return out


@query()
def additive_shapes(spark, sf_dir):
    """The shape of each type's count, and of the pair that adds most."""
    model = boosting.fit_additive(exposed(spark, sf_dir), list(_KINDS), "y", rounds=3, bins=16, pairs=1, pair_rounds=2)
    t = model.table(spark)
    return t.withColumn("value", r6("value"))


@query()
def additive_scores(spark, sf_dir):
    """Each user's probability and what each term adds to its score."""
    u = exposed(spark, sf_dir)
    model = boosting.fit_additive(u, list(_KINDS), "y", rounds=3, bins=16)
    out = model.transform(u)
    return out.select("user_id", r6("p").alias("p"), *(r6(F.get("p_terms", F.lit(i))).alias(f"{k}_term") for i, k in enumerate(_KINDS)))


_REFS = f"[{', '.join(repr(i / 19) for i in range(20))}]::DOUBLE[]"
_SHARE = """list_transform([{q}], lambda q: CASE WHEN {x} <= q[1] THEN 0.0 WHEN {x} >= q[20] THEN 1.0 ELSE (
 (len(list_filter(q, lambda e: e <= {x})) - 1 + ({x} - q[len(list_filter(q, lambda e: e <= {x}))]) / (q[len(list_filter(q, lambda e: e <= {x})) + 1] - q[len(list_filter(q, lambda e: e <= {x}))])) / 19.0 +
 CASE WHEN {x} = q[len(list_filter(q, lambda e: e < {x})) + 1] THEN len(list_filter(q, lambda e: e < {x})) / 19.0 ELSE
 (len(list_filter(q, lambda e: e < {x})) - 1 + ({x} - q[len(list_filter(q, lambda e: e < {x}))]) / (q[len(list_filter(q, lambda e: e < {x})) + 1] - q[len(list_filter(q, lambda e: e < {x}))])) / 19.0 END) / 2 END)[1]"""


@query(_D + f""", z AS (SELECT doc_id, (doc_id % 2)::INT fold, p::DOUBLE p, CASE WHEN doc_id % 9 <> 0 THEN p2::DOUBLE END p2 FROM d),
m AS (SELECT f, median(p) mp, median(p2) mp2 FROM z, (VALUES (0), (1)) t(f) WHERE fold <> f GROUP BY 1),
q AS (SELECT f, quantile_cont(coalesce(p, mp), {_REFS}) qp, quantile_cont(coalesce(p2, mp2), {_REFS}) qp2 FROM z JOIN m ON fold <> f GROUP BY 1),
x AS (SELECT doc_id, fold, coalesce(p, mp) p, coalesce(p2, mp2) p2, qp, qp2 FROM z JOIN m ON f = fold JOIN q USING (f))
SELECT doc_id, fold, round({_SHARE.format(x='p', q='qp')}, 6) p_share, round({_SHARE.format(x='p2', q='qp2')}, 6) p2_share, round(least(greatest(p, qp[1]), qp[20]), 6) p_back, true ordered FROM x""")
def quantile_normal(spark, sf_dir):
    """Scores brought to a normal shape by the quantiles of the other fold: shares, the value that comes back, and whether the normal value has the share's side."""
    d = scored(spark, sf_dir).select("doc_id", (F.col("doc_id") % 2).cast("int").alias("fold"), "p", F.when(F.col("doc_id") % 9 != 0, F.col("p2")).alias("p2"))
    out = []
    for f in (0, 1):
        fitted = cleaning.QuantileNormal.fit(d.filter(F.col("fold") != f), {"scores": ["p", "p2"]}, most=20)
        part = d.filter(F.col("fold") == f).withColumns({f"{c}_share": fitted.share(c) for c in ("p", "p2")})
        back = fitted.inverse(fitted.transform(part).withColumn("p_normal", F.col("p")))
        side = (F.col("p_normal") > 0) == (F.col("p_share") > 0.5)
        out.append(back.select("doc_id", "fold", r6("p_share").alias("p_share"), r6("p2_share").alias("p2_share"), r6("p").alias("p_back"), (side | (F.abs(F.col("p_share") - 0.5) < 1e-9)).alias("ordered")))
    return reduce(DataFrame.unionByName, out)


@query()
def residual_blend(spark, sf_dir):
    """A score blended with models of what it leaves unexplained, by language."""
    d = scored(spark, sf_dir).withColumn("fold", (F.col("doc_id") % 3).cast("int")).withColumn("length", F.length("source").cast("double"))
    out, chosen = models.blend_residuals(d, ["p2", "length"], "y", "fold", [0, 1, 2], "lang", ["en", "de"], {k: "p" for k in range(3)}, "p")
    lam = F.coalesce(*(F.when((F.col("fold") == k) & (F.col("lang") == g), F.lit(x)) for k, g, x in chosen), F.lit(0.0))
    return out.select("doc_id", "fold", "lang", lam.alias("lambda"), r6("blended").alias("blended"))


@query("""
WITH c AS (SELECT c_custkey, c_custkey % 5 <> 0 tr, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal::DOUBLE END x, c_nationkey::DOUBLE r, CASE WHEN c_custkey % 11 <> 0 THEN c_mktsegment END seg FROM customer),
m AS (SELECT median(r) mr, median(x) mx FROM c WHERE tr), k AS (SELECT c.*, mx, coalesce(seg, 'unknown') || '|' || CASE WHEN r > mr THEN 'hi' ELSE 'lo' END cohort FROM c, m),
st AS (SELECT cohort, avg(x) mu, stddev_pop(x) sd, count(x) n, count(*) size FROM k WHERE tr GROUP BY 1), g AS (SELECT avg(x) mu, stddev_pop(x) sd, count(x) n FROM k WHERE tr),
z AS (SELECT k.*, size < 30 OR size IS NULL fb, CASE WHEN size < 30 OR size IS NULL THEN (x - g.mu) / g.sd ELSE (x - st.mu) / st.sd END z,
 CASE WHEN x IS NULL THEN NULL WHEN size < 30 OR size IS NULL THEN (SELECT count(*) FROM k p WHERE p.tr AND p.x <= k.x) / g.n::DOUBLE ELSE (SELECT count(*) FROM k p WHERE p.tr AND p.cohort = k.cohort AND p.x <= k.x) / st.n::DOUBLE END pct FROM k LEFT JOIN st USING (cohort), g),
f AS (SELECT median(z) mz, median(pct) mp FROM z WHERE tr)
SELECT c_custkey, round(coalesce(x, mx), 6) x, round(coalesce(z, mz), 6) x_cohort_z, round(CASE WHEN x IS NULL THEN mp ELSE pct END, 6) x_cohort_pct, (seg IS NULL)::INT missing, coalesce(seg = 'BUILDING', false)::INT building FROM z, f WHERE NOT tr""")
def fold_transform(spark, sf_dir):
    """Rows of one fold by what was learnt from the others: cohort positions, medians, categories."""
    key = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(key % 7 != 0, F.col("c_acctbal").cast("double")).alias("x"), F.col("c_nationkey").cast("double").alias("r"), F.when(key % 11 != 0, F.col("c_mktsegment")).alias("seg"))
    fitted = FoldTransform.fit(c.filter(key % 5 != 0), "c_custkey", ["x"], ["seg"], ["x"], "seg", "r", limit=1.0)
    out = fitted.transform(c.filter(key % 5 == 0), ["c_custkey"])
    return out.select("c_custkey", *(r6(n).alias(n) for n in ("x", "x_cohort_z", "x_cohort_pct")), F.col("`seg=__MISSING__`").alias("missing"), F.col("`seg=BUILDING`").alias("building"))
