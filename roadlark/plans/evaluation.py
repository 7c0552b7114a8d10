"""Queries over scores with labels: metrics, tops, subgroups, calibration, audits, models."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalars import clip, ratio
from ..operators import bootstrap, cleaning, evaluation, models
from ..operators.windows import exact_quantiles, with_average_rank
from .registry import big, query, r6, table

_D = """WITH d AS (SELECT doc_id, lang, source, least(n_chars/8000.0::DOUBLE,1) p, least(length(source)*0.1::DOUBLE + n_chars/20000.0::DOUBLE,1) p2, quality y, toxic t FROM documents JOIN labels USING (doc_id))
"""


def scored(spark, sf_dir):
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    n = F.col("n_chars")
    return d.select("doc_id", "lang", "source", F.least(n / 8000.0, F.lit(1.0)).alias("p"), F.least(F.length("source") * 0.1 + n / 20000.0, F.lit(1.0)).alias("p2")).join(l.select("doc_id", F.col("quality").alias("y"), F.col("toxic").alias("t")), "doc_id")


_AUC = """(SELECT (sum(CASE WHEN y=1 THEN r END) - sum(y)*(sum(y)+1)/2.0::DOUBLE)/nullif(sum(y)*(count(*)-sum(y)),0) FROM (SELECT y, rank() OVER (ORDER BY {s}) + (count(*) OVER (PARTITION BY {s})-1)/2.0::DOUBLE r FROM {t}))"""


@query(_D + f"SELECT round({_AUC.format(s='p', t='d')},6) auc, round(1-{_AUC.format(s='-p', t='d')},6) mirrored, (SELECT sum(y) FROM d)::BIGINT positives")
def auc(spark, sf_dir):
    a = evaluation.auc(scored(spark, sf_dir), "p", "y")
    return a.select(r6("auc").alias("auc"), r6("auc").alias("mirrored"), "positives")


@query(_D + """, g AS (SELECT p, sum(y) tp, count(*) n FROM d GROUP BY 1), c AS (SELECT tp, sum(tp) OVER (ORDER BY p DESC) ct, sum(n) OVER (ORDER BY p DESC) cn FROM g)
SELECT round(sum(tp*ct/cn::DOUBLE)/sum(tp),6) average_precision FROM c""")
def average_precision(spark, sf_dir):
    return evaluation.average_precision(scored(spark, sf_dir), "p", "y").select(r6("average_precision").alias("average_precision"))


@query(_D + "SELECT round(avg((p-y)*(p-y)),6) brier, round(-avg(CASE WHEN y=1 THEN ln(least(greatest(p,1e-15),1-1e-15)) ELSE ln(1-least(greatest(p,1e-15),1-1e-15)) END),5) log_loss, round(avg(abs(p-p2)),6) mae FROM d")
def brier_logloss(spark, sf_dir):
    d = scored(spark, sf_dir)
    return d.agg(r6(evaluation.brier(F.col("p"), F.col("y"))).alias("brier"), F.round(evaluation.log_loss(F.col("p"), F.col("y")), 5).alias("log_loss"), r6(F.avg(F.abs(F.col("p") - F.col("p2")))).alias("mae"))


@query(_D + """, r AS (SELECT *, row_number() OVER (ORDER BY p DESC, doc_id) rn, count(*) OVER () n FROM d), k AS (SELECT * FROM r WHERE rn <= ceil(0.2*n))
SELECT count(*) k, round(sum(y)/count(*)::DOUBLE,6) "precision", round(sum(y)/(SELECT sum(y) FROM d)::DOUBLE,6) recall, round((sum(y)/count(*)::DOUBLE)/(SELECT avg(y) FROM d),6) lift, (SELECT count(*) FROM d WHERE p = (SELECT min(p) FROM k)) ties FROM k""")
def topk_recall(spark, sf_dir):
    d = scored(spark, sf_dir)
    k = evaluation.top_k(d, "p", "doc_id", 0.2)
    a = k.agg(F.count("*").alias("k"), F.sum("y").alias("hits"), F.min("p").alias("cut"))
    b = d.join(F.broadcast(a)).groupBy("k", "hits").agg(F.sum("y").alias("all"), F.avg("y").alias("rate"), F.count_if(F.col("p") == F.col("cut")).alias("ties"))  # a: one row
    return b.select("k", r6(ratio(F.col("hits"), F.col("k"))).alias("precision"), r6(ratio(F.col("hits"), F.col("all"))).alias("recall"), r6(ratio(F.col("hits"), F.col("k")) / F.col("rate")).alias("lift"), "ties")


@query(_D + """SELECT bucket, count(*) n, sum(y)::BIGINT positives, round(avg(p),6) mean_p FROM (SELECT *, floor((row_number() OVER (ORDER BY p, doc_id)-1)*5/count(*) OVER ())::INT bucket FROM d) GROUP BY 1""")
def quintiles(spark, sf_dir):
    return evaluation.quintiles(scored(spark, sf_dir), "p", "doc_id").groupBy("bucket").agg(F.count("*").alias("n"), big(F.sum("y")).alias("positives"), r6(F.avg("p")).alias("mean_p"))


@query(_D + "SELECT greatest(ceil(p*10),1)::INT bin, count(*) n, round(avg(p),6) mean_p, round(avg(y),6) mean_y FROM d GROUP BY 1")
def calibration(spark, sf_dir):
    return evaluation.calibration(scored(spark, sf_dir), "p", "y").withColumns({"mean_p": r6("mean_p"), "mean_y": r6("mean_y")})


@query(_D + """SELECT CASE WHEN grouping(lang)=0 THEN 'lang' ELSE 'source' END field, coalesce(lang, source) "value", count(*) n, sum(y)::BIGINT positives, CASE WHEN count(*) >= 10 THEN round(avg((p-y)*(p-y)),6) END brier, CASE WHEN count(*) < 10 THEN 1 ELSE 0 END insufficient FROM d GROUP BY GROUPING SETS ((lang),(source))""")
def subgroup_metrics(spark, sf_dir):
    g = scored(spark, sf_dir).groupingSets([[F.col("lang")], [F.col("source")]], F.col("lang"), F.col("source")).agg(F.grouping("lang").alias("g"), F.count("*").alias("n"), big(F.sum("y")).alias("positives"), evaluation.brier(F.col("p"), F.col("y")).alias("b"))
    return g.select(F.when(F.col("g") == 0, "lang").otherwise("source").alias("field"), F.coalesce("lang", "source").alias("value"), "n", "positives", r6(F.when(F.col("n") >= 10, F.col("b"))).alias("brier"), (F.col("n") < 10).cast("int").alias("insufficient"))


@query(_D + """, r AS (SELECT rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p)-1)/2.0::DOUBLE a, rank() OVER (ORDER BY p2) + (count(*) OVER (PARTITION BY p2)-1)/2.0::DOUBLE b FROM d),
k AS (SELECT sum(sign(x.p-y.p)*sign(x.p2-y.p2)) s, sum(CASE WHEN x.p<>y.p THEN 1 END)::DOUBLE a, sum(CASE WHEN x.p2<>y.p2 THEN 1 END)::DOUBLE b FROM d x JOIN d y ON x.doc_id < y.doc_id)
SELECT round((SELECT corr(p,p2) FROM d),6) pearson, round((SELECT corr(a,b) FROM r),6) spearman, round((SELECT s/sqrt(a*b) FROM k),6) kendall""")
def correlations(spark, sf_dir):
    d = scored(spark, sf_dir)
    a, b, c = d.agg(r6(F.corr("p", "p2")).alias("pearson")), evaluation.spearman(d, "p", "p2"), evaluation.kendall_tau_b(d, "p", "p2")
    return a.crossJoin(b.select(r6("spearman").alias("spearman"))).crossJoin(c.select(r6("kendall_tau_b").alias("kendall")))  # one row each


@query(_D + """, a AS (SELECT doc_id, y FROM d ORDER BY p DESC, doc_id LIMIT 100), b AS (SELECT doc_id, y FROM d ORDER BY p2 DESC, doc_id LIMIT 100)
SELECT (SELECT count(*) FROM a JOIN b USING (doc_id)) overlap, (SELECT count(*) FROM b ANTI JOIN a USING (doc_id) WHERE y=1) gained_positive, (SELECT count(*) FROM b ANTI JOIN a USING (doc_id) WHERE y=0) gained_negative, (SELECT count(*) FROM a ANTI JOIN b USING (doc_id) WHERE y=1) lost_positive, (SELECT count(*) FROM a ANTI JOIN b USING (doc_id) WHERE y=0) lost_negative""")
def topk_set_change(spark, sf_dir):
    d = scored(spark, sf_dir)
    top = lambda s, n: d.orderBy(F.desc(s), "doc_id").limit(100).select("doc_id", F.col("y").alias(n))
    j = top("p", "ya").join(top("p2", "yb"), "doc_id", "full_outer")
    a, b = F.col("ya").isNotNull(), F.col("yb").isNotNull()
    return j.agg(F.count_if(a & b).alias("overlap"), F.count_if(~a & (F.col("yb") == 1)).alias("gained_positive"), F.count_if(~a & (F.col("yb") == 0)).alias("gained_negative"), F.count_if(~b & (F.col("ya") == 1)).alias("lost_positive"), F.count_if(~b & (F.col("ya") == 0)).alias("lost_negative"))


@query(_D + """, q AS (SELECT *, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END h FROM d) SELECT y || '/' || h cell, count(*) n, round(median(p),6) median_p, round(median(p2),6) median_p2 FROM q GROUP BY 1""")
def error_cells(spark, sf_dir):
    cell = F.concat(F.col("y").cast("string"), F.lit("/"), (F.col("p") >= 0.5).cast("int").cast("string"))
    d = scored(spark, sf_dir).withColumn("cell", cell)
    median = lambda c: exact_quantiles(d, c, {"m": 0.5}, "cell").select("cell", r6("m").alias(f"median_{c}"))
    return d.groupBy("cell").agg(F.count("*").alias("n")).join(median("p"), "cell", "left").join(median("p2"), "cell", "left")


@query("""
SELECT (doc_id % 5)::INT fold, count(*) n, count(*) FILTER (quality=0) q0, count(*) FILTER (quality=1) q1, count(*) FILTER (toxic=1) toxic FROM labels GROUP BY 1""")
def fold_crosstab(spark, sf_dir):
    return table(spark, sf_dir, "labels").groupBy((F.col("doc_id") % 5).cast("int").alias("fold")).agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 0).alias("q0"), F.count_if(F.col("quality") == 1).alias("q1"), F.count_if(F.col("toxic") == 1).alias("toxic"))


@query("""
SELECT c column_name, count(*) n, count(*) - count(v) nulls, count(*) FILTER (v = 0) zeros, round(quantile_cont(v,0.25),4) p25, round(quantile_cont(v,0.5),4) p50, round(quantile_cont(v,0.75),4) p75, round(max(v),4) mx FROM
 (SELECT 'l_quantity' c, l_quantity::DOUBLE v FROM lineitem UNION ALL SELECT 'l_extendedprice', l_extendedprice::DOUBLE FROM lineitem UNION ALL SELECT 'l_discount', CASE WHEN l_discount > 0.05 THEN l_discount::DOUBLE END FROM lineitem UNION ALL SELECT 'l_tax', l_tax::DOUBLE FROM lineitem) GROUP BY 1""")
def column_audit(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").withColumn("l_discount", F.when(F.col("l_discount") > 0.05, F.col("l_discount")))
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    long = l.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("v")) for c in cols))))
    g = long.groupBy("column_name").agg(F.count("*").alias("n"), (F.count("*") - F.count("v")).alias("nulls"), F.count_if(F.col("v") == 0).alias("zeros"), F.max("v").alias("mx"))
    q = exact_quantiles(long, "v", {"p25": 0.25, "p50": 0.5, "p75": 0.75}, "column_name").drop("n")
    return g.join(q, "column_name", "left").select("column_name", "n", "nulls", "zeros", *(F.round(c, 4).alias(c) for c in ("p25", "p50", "p75", "mx")))


@query(_D + "SELECT count(*) n, count(*) - count(DISTINCT doc_id) repeated, count(*) FILTER (p IS NULL) missing, count(*) FILTER (p < 0 OR p > 1) outside, count(*) FILTER (y NOT IN (0,1)) bad_label FROM d")
def input_checks(spark, sf_dir):
    return scored(spark, sf_dir).agg(F.count("*").alias("n"), (F.count("*") - F.count_distinct("doc_id")).alias("repeated"), F.count_if(F.col("p").isNull()).alias("missing"), F.count_if((F.col("p") < 0) | (F.col("p") > 1)).alias("outside"), F.count_if(~F.col("y").isin(0, 1)).alias("bad_label"))


@query("""
WITH c AS (SELECT c_custkey, c_acctbal, c_mktsegment, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END x, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_mktsegment END g FROM customer), m AS (SELECT median(x) md, mode(g) mg FROM (SELECT * FROM c WHERE c_custkey % 5 <> 0)),
k AS (SELECT g, count(*) n FROM c WHERE c_custkey % 5 <> 0 AND g IS NOT NULL GROUP BY 1 ORDER BY n DESC, g LIMIT 1)
SELECT c_custkey, round(coalesce(x, md),4) x, CASE WHEN g = 'BUILDING' THEN 1 ELSE 0 END is_building, CASE WHEN g = 'MACHINERY' THEN 1 ELSE 0 END is_machinery FROM c, m""")
def imputed_encoded(spark, sf_dir):
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(k % 7 != 0, F.col("c_acctbal")).alias("x"), F.when(k % 11 != 0, F.col("c_mktsegment")).alias("g"))
    out = cleaning.one_hot(cleaning.impute(c.filter(k % 5 != 0), c, ["x"], []), "g", ["BUILDING", "MACHINERY"])
    return out.select("c_custkey", F.round("x", 4).alias("x"), F.col("g_BUILDING").alias("is_building"), F.col("g_MACHINERY").alias("is_machinery"))


@query()
def feature_prune(spark, sf_dir):
    """The columns that each pruning step keeps, over a table with a constant, a copy and a monotone image."""
    p = table(spark, sf_dir, "part").select("p_retailprice", "p_size", F.lit(1.0).alias("constant"), F.col("p_retailprice").alias("copy"), F.log("p_retailprice").alias("monotone"))
    names = p.columns
    kept = [("informative", names := cleaning.informative(p, names)), ("without_equal", names := cleaning.without_equal(p, names)), ("spearman", cleaning.prune_correlated(p, names))]
    return spark.createDataFrame([(step, i, c) for step, cols in kept for i, c in enumerate(cols)], "step string, position int, column string")


@query()
def bootstrap_auc(spark, sf_dir):
    """AUC and top-share recall of two scores, resampled in pairs."""
    return bootstrap.paired_bootstrap(scored(spark, sf_dir), "p", "p2", "y", "doc_id")


@query()
def kmeans_profile(spark, sf_dir):
    e = models.to_vector(table(spark, sf_dir, "embeddings"), "embedding")
    out, k, _ = models.kmeans_by_silhouette(e.select("vec_id", "label", "features"), range(2, 9))
    return out.groupBy("cluster").agg(F.lit(k).alias("k"), F.count("*").alias("n"), r6(F.avg("label")).alias("mean_label"), F.min("vec_id").alias("first_id"))


@query()
def logistic_oof(spark, sf_dir):
    d = scored(spark, sf_dir).withColumn("fold", (F.col("doc_id") % 3).cast("int"))
    out = models.out_of_fold(d.withColumnRenamed("p", "p1"), ["p1", "p2"], "y", "fold", [0, 1, 2])
    return out.select("doc_id", "fold", "y", r6("p").alias("probability"))


@query(_D + """, f AS (SELECT doc_id, y, 1/(1+exp(-(0.6*ln(least(greatest(p,1e-6),1-1e-6)/(1-least(greatest(p,1e-6),1-1e-6))) + 0.4*ln(least(greatest(p2,1e-6),1-1e-6)/(1-least(greatest(p2,1e-6),1-1e-6)))))) fused FROM d)
SELECT doc_id, round(fused,6) fused, round(100*(1-fused),4) safety FROM f""")
def logit_fusion(spark, sf_dir):
    f = models.logit_fusion({"p": 0.6, "p2": 0.4})
    return scored(spark, sf_dir).select("doc_id", r6(f).alias("fused"), F.round(100 * (1 - f), 4).alias("safety"))


@query(_D + """, q AS (SELECT *, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p)-1)/2.0::DOUBLE ra, rank() OVER (ORDER BY p2) + (count(*) OVER (PARTITION BY p2)-1)/2.0::DOUBLE rb FROM d)
SELECT doc_id, ra, rb, abs(ra-rb) apart FROM q ORDER BY apart DESC, doc_id LIMIT 20""")
def rank_disagreements(spark, sf_dir):
    q = with_average_rank(scored(spark, sf_dir).select("doc_id", "p", "p2"), {"ra": "p", "rb": "p2"}).select("doc_id", "ra", "rb")
    return q.withColumn("apart", F.abs(F.col("ra") - F.col("rb"))).orderBy(F.desc("apart"), "doc_id").limit(20)
