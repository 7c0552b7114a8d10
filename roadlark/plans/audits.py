"""Queries that check, reconcile and explain: protocols, gates, dictionaries, reasons, roll-ups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalars import epoch_seconds, ratio
from ..operators import aggregates, contract, evaluation
from .evaluation import _AUC, _D, scored
from .registry import AS_OF, LOOKBACK, big, query, r6, table
from ..operators.windows import exact_quantiles, in_history


@query("SELECT event_type, count(*) n, count(*) FILTER (user_id NOT IN (SELECT c_custkey FROM customer)) orphans FROM events GROUP BY 1")
def referential_check(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    known = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.lit(1).alias("known"))
    return ev.join(known, "user_id", "left").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("known").isNull()).alias("orphans"))


@query("""
WITH s AS (SELECT c_custkey::VARCHAR || '_20240121_20' sample_id, c_custkey % 5 fold FROM customer), k AS (SELECT *, split_part(sample_id,'_',1)::BIGINT key FROM s),
l AS (SELECT doc_id key, quality y FROM labels)
SELECT fold, count(*) samples, count(y) labelled, coalesce(sum(y),0)::BIGINT positives, CASE WHEN sum(y) > 0 AND sum(1-y) > 0 THEN 1 ELSE 0 END both_classes FROM k LEFT JOIN l USING (key) GROUP BY 1""")
def protocol_binding(spark, sf_dir):
    s = table(spark, sf_dir, "customer").select(F.concat(F.col("c_custkey").cast("string"), F.lit("_20240121_20")).alias("sample_id"), (F.col("c_custkey") % 5).alias("fold"))
    s = s.withColumn("key", F.split("sample_id", "_")[0].try_cast("long"))
    l = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("key"), F.col("quality").alias("y"))
    both = (F.sum("y") > 0) & (F.sum(1 - F.col("y")) > 0)
    return s.join(l, "key", "left").groupBy("fold").agg(F.count("*").alias("samples"), F.count("y").alias("labelled"), big(F.coalesce(F.sum("y"), F.lit(0))).alias("positives"), F.coalesce(both, F.lit(False)).cast("int").alias("both_classes"))


@query("""
WITH f AS (SELECT o_custkey k, count(*) n, avg(o_totalprice) v FROM orders WHERE o_orderpriority LIKE '1%' GROUP BY 1)
SELECT c_custkey, coalesce(n,0) n, round(v,4) v, CASE WHEN k IS NULL THEN 1 ELSE 0 END sensor_missing FROM customer LEFT JOIN f ON c_custkey = k""")
def missing_flag_join(spark, sf_dir):
    f = table(spark, sf_dir, "orders").filter(F.col("o_orderpriority").startswith("1")).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("v"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(f, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"), F.round("v", 4).alias("v"), F.col("n").isNull().cast("int").alias("sensor_missing"))


@query("""
SELECT l_suppkey, count(*) n, CASE WHEN count(*) >= 500 THEN round(avg(abs(l_quantity - l_discount*500)),5) END mean_gap, CASE WHEN count(*) >= 500 THEN round(quantile_cont(abs(l_quantity - l_discount*500),0.95),5) END p95_gap FROM lineitem GROUP BY 1""")
def source_discrepancy(spark, sf_dir):
    d = F.abs(F.col("l_quantity") - F.col("l_discount") * 500)
    enough = F.count("*") >= 500
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.round(F.when(enough, F.avg(d)), 5).alias("mean_gap"), F.round(F.when(enough, F.percentile(d, 0.95)), 5).alias("p95_gap"))


@query("""
WITH d AS (SELECT l_suppkey k, l_shipdate::DATE d, l_returnflag f, count(*) n, avg(l_quantity) v, sum(l_extendedprice) km FROM lineitem GROUP BY 1,2,3)
SELECT k, sum(n)::BIGINT n, round(sum(v*n)/sum(n),5) v, round(sum(km),2) km FROM d GROUP BY 1""")
def weighted_rollup(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("k"), F.to_date("l_shipdate").alias("d"), "l_returnflag").agg(F.count("*").alias("n"), F.avg("l_quantity").alias("v"), F.sum("l_extendedprice").alias("km"))
    return contract.weighted_rollup(d, ["k"], "n", ["v"], ["km"]).select("k", "n", F.round("v", 5).alias("v"), F.round("km", 2).alias("km"))


@query("""
WITH w AS (SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-21')
SELECT user_id, count(*) n, count(DISTINCT event_type) types, round(quantile_cont(value,0.5),6) p50, round(quantile_cont(value,0.9),6) p90, count(*) FILTER (value > 80) high, round(count(*) FILTER (value > 80)/count(*)::DOUBLE,6) high_ratio, round(avg(value) FILTER (event_type='error'),6) error_mean,
 round(count(*) FILTER (event_type='error' AND (hour(ts) >= 22 OR hour(ts) < 5))/nullif(count(*) FILTER (event_type='error'),0)::DOUBLE,6) error_night_share, round(count(*) FILTER (event_type IN ('click','view'))*1000.0::DOUBLE/nullif(sum(value),0),5) attention_per_1000 FROM w GROUP BY 1""")
def severity_diversity(spark, sf_dir):
    w = table(spark, sf_dir, "events").filter(in_history(F.col("ts"), AS_OF, LOOKBACK))
    error, night = F.col("event_type") == "error", (F.hour("ts") >= 22) | (F.hour("ts") < 5)
    q = F.percentile("value", F.array(F.lit(0.5), F.lit(0.9)))
    return w.groupBy("user_id").agg(F.count("*").alias("n"), F.count_distinct("event_type").alias("types"), r6(q[0]).alias("p50"), r6(q[1]).alias("p90"), F.count_if(F.col("value") > 80).alias("high"), r6(ratio(F.count_if(F.col("value") > 80), F.count("*"))).alias("high_ratio"),
                                    r6(F.avg(F.when(error, F.col("value")))).alias("error_mean"), r6(ratio(F.count_if(error & night), F.count_if(error))).alias("error_night_share"), F.round(ratio(F.count_if(F.col("event_type").isin("click", "view")) * 1000, F.sum("value")), 5).alias("attention_per_1000"))


@query("""
WITH p AS (SELECT user_id, event_type, sum(value::VARCHAR::DECIMAL(38,18)) points FROM events WHERE value > 0 GROUP BY 1,2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY points DESC, event_type) rn FROM p)
SELECT user_id, string_agg(event_type, ',' ORDER BY rn) reasons, 'Most points: ' || max(CASE WHEN rn=1 THEN event_type END) sentence FROM r WHERE rn <= 3 GROUP BY 1""")
def top_reasons(spark, sf_dir):
    p = table(spark, sf_dir, "events").filter("value > 0").groupBy("user_id", "event_type").agg(aggregates.steady_sum(F.col("value")).alias("points"))
    r = p.withColumn("rn", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("points"), F.asc_nulls_last("event_type")))).filter("rn <= 3")
    g = r.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("rn", "event_type"))).alias("top"))
    known = F.array_compact(F.transform("top", lambda x: x.event_type))
    return g.select("user_id", F.when(F.size(known) > 0, F.array_join(known, ",")).alias("reasons"), F.concat(F.lit("Most points: "), F.col("top")[0]["event_type"]).alias("sentence"))


@query(_D + f"""SELECT round({_AUC.format(s='p2', t='d')} - {_AUC.format(s='p', t='d')},6) delta_auc, round((SELECT avg((p2-y)*(p2-y)) - avg((p-y)*(p-y)) FROM d),6) delta_brier,
 CASE WHEN {_AUC.format(s='p2', t='d')} - {_AUC.format(s='p', t='d')} >= 0.005 AND (SELECT avg((p2-y)*(p2-y)) - avg((p-y)*(p-y)) FROM d) <= 0.001 THEN 'adopt' ELSE 'keep' END decision""")
def adoption_gate(spark, sf_dir):
    d = scored(spark, sf_dir)
    one, two = evaluation.auc(d, "p", "y").select(F.col("auc").alias("a")), evaluation.auc(d, "p2", "y").select(F.col("auc").alias("b"))
    b = d.agg((evaluation.brier(F.col("p2"), F.col("y")) - evaluation.brier(F.col("p"), F.col("y"))).alias("db"))
    x = one.crossJoin(two).crossJoin(b)  # one row each
    ok = contract.gate(F.col("b") - F.col("a"), 0.005) & (F.col("db") <= 0.001)
    return x.select(r6(F.col("b") - F.col("a")).alias("delta_auc"), r6("db").alias("delta_brier"), F.when(ok, "adopt").otherwise("keep").alias("decision"))


@query(_D + """, m AS (SELECT max(lang) FROM d) SELECT doc_id, CASE WHEN lang IS NULL THEN 'insufficient' WHEN r = mx THEN 'high' ELSE 'low' END risk_group FROM (SELECT doc_id, lang, length(source) r, max(length(source)) OVER () mx FROM d)""")
def risk_group(spark, sf_dir):
    d = scored(spark, sf_dir).withColumn("r", F.length("source"))
    top = d.agg(F.max("r").alias("mx"))
    return d.join(F.broadcast(top)).select("doc_id", F.when(F.col("lang").isNull(), "insufficient").when(F.col("r") == F.col("mx"), "high").otherwise("low").alias("risk_group"))  # top: one row


@query("""
WITH p AS (SELECT user_id, event_id, epoch(date_trunc('second', ts))::BIGINT s, CASE WHEN user_id % 2 = 0 THEN (epoch(date_trunc('second', ts))::BIGINT % 43200) ELSE event_id END::DOUBLE r FROM events),
a AS (SELECT *, coalesce(r - lag(r) OVER w < -1, false) reset, coalesce(s - lag(s) OVER w > 10800, false) lng FROM p WINDOW w AS (PARTITION BY user_id ORDER BY s, event_id)),
t AS (SELECT *, sum(reset::INT) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS UNBOUNDED PRECEDING) trip FROM a),
g AS (SELECT user_id, trip, arg_min(r, (s, event_id)) f, arg_max(r, (s, event_id)) l, count(*) FILTER (lng AND NOT reset) u FROM t GROUP BY 1,2)
SELECT user_id, CASE WHEN max(trip) > 0 AND count(*) FILTER (trip > 0 AND f > 0.2*l + 60) = 0 AND sum(u) = 0 THEN 'trip' ELSE 'gap' END kind, count(*) trips FROM g GROUP BY 1""")
def run_duration_kind(spark, sf_dir):
    s = epoch_seconds(F.col("ts"))
    p = table(spark, sf_dir, "events").select("user_id", "event_id", s.alias("s"), F.when(F.col("user_id") % 2 == 0, s % 43200).otherwise(F.col("event_id")).cast("double").alias("r"))
    return contract.run_duration_kind(p, "user_id", "s", "r", "event_id")


@query()
def contract_violations(spark, sf_dir):
    return contract.violations(contract.contract(spark))


@query()
def column_dictionary(spark, sf_dir):
    from .events import family_window_counts

    return spark.createDataFrame(contract.column_dictionary(family_window_counts(spark, sf_dir)), "column string, family string, type string")


@query("""
WITH x AS (SELECT event_type, count(*) n, count(DISTINCT user_id) users, count(*) FILTER (value >= 100) saturated FROM events GROUP BY 1)
SELECT event_type, n, users, saturated, round(saturated/n::DOUBLE,6) share, CASE WHEN saturated > 0.05*n THEN 'saturated' ELSE 'fine' END verdict FROM x""")
def saturation_audit(spark, sf_dir):
    x = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.count_if(F.col("value") >= 100).alias("saturated"))
    return x.select("*", r6(ratio(F.col("saturated"), F.col("n"))).alias("share"), F.when(F.col("saturated") > 0.05 * F.col("n"), "saturated").otherwise("fine").alias("verdict"))


@query("""
WITH r AS (SELECT id reviewer, cas, (id * 7 + cas * 3) % 3 + 3 rating FROM range(5) t(id), range(10) c(cas))
SELECT reviewer, count(*) cases, round(avg(rating),6) mean_rating, min(rating) lowest, CASE WHEN count(*) = 10 AND avg(rating) >= 4 AND min(rating) >= 3 THEN 1 ELSE 0 END passes FROM r GROUP BY 1""")
def review_matrix(spark, sf_dir):
    r = spark.range(50).select(F.floor(F.col("id") / 10).alias("reviewer"), (F.col("id") % 10).alias("cas"))
    r = r.withColumn("rating", (F.col("reviewer") * 7 + F.col("cas") * 3) % 3 + 3)
    ok = (F.count("*") == 10) & (F.avg("rating") >= 4) & (F.min("rating") >= 3)
    return r.groupBy("reviewer").agg(F.count("*").alias("cases"), r6(F.avg("rating")).alias("mean_rating"), F.min("rating").alias("lowest"), ok.cast("int").alias("passes"))


@query("""
SELECT o_custkey, count(*) n, round(sum(CASE WHEN o_orderdate >= DATE '2001-07-01' THEN o_totalprice ELSE 0 END),2) v31, round(sum(CASE WHEN o_orderdate >= DATE '2001-02-01' THEN o_totalprice ELSE 0 END),2) v181, count(DISTINCT o_orderdate::DATE) FILTER (o_orderdate >= DATE '2001-02-01') days181 FROM orders GROUP BY 1""")
def exposure_windows(spark, sf_dir):
    since = lambda d: F.col("o_orderdate") >= F.lit(d).cast("date")
    part = lambda d: F.round(F.sum(F.when(since(d), F.col("o_totalprice")).otherwise(0)), 2)
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), part("2001-07-01").alias("v31"), part("2001-02-01").alias("v181"), F.count_distinct(F.when(since("2001-02-01"), F.to_date("o_orderdate"))).alias("days181"))


@query("""
WITH s AS (SELECT l_returnflag flag, unnest(['quantity','price','tax']) signal, unnest([l_quantity::DOUBLE, l_extendedprice/1000, l_tax*100]) v FROM lineitem)
SELECT flag, signal, count(*) n, round(quantile_cont(v,0.5),3) p50, round(quantile_cont(v,0.95),3) p95, round(quantile_cont(v,0.99),3) p99, round(quantile_cont(v,0.995),3) p995 FROM s GROUP BY 1,2""")
def signal_quantiles(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    pairs = (("quantity", F.col("l_quantity").cast("double")), ("price", F.col("l_extendedprice") / 1000), ("tax", F.col("l_tax") * 100))
    s = l.select(F.col("l_returnflag").alias("flag"), F.inline(F.array(*(F.struct(F.lit(n).alias("signal"), c.alias("v")) for n, c in pairs))))
    qs = {"p50": 0.5, "p95": 0.95, "p99": 0.99, "p995": 0.995}
    g = exact_quantiles(s.select(F.concat_ws("|", "flag", "signal").alias("key"), "v"), "v", qs, "key")
    part = F.split("key", r"\|")
    return g.select(part[0].alias("flag"), part[1].alias("signal"), "n", *(F.round(c, 3).alias(c) for c in qs))


@query("""
WITH d AS (SELECT user_id, ts::DATE AS day, count(*) n, avg(value) v, max(value) mx, avg(CASE WHEN value < 5 THEN 1.0 ELSE 0 END)::DOUBLE slow FROM events GROUP BY 1,2)
SELECT user_id, count(*) active_days, sum(n)::BIGINT n, round(avg(v),9) mean_of_days, round(sum(v*n)/sum(n),9) mean_of_rows, round(max(mx),5) mx, round(avg(slow),6) slow_share, round(stddev_samp(v)/(avg(v)+1e-6),5) day_cv FROM d GROUP BY 1""")
def day_rollup(spark, sf_dir):
    d = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.avg("value").alias("v"), F.max("value").alias("mx"), F.avg((F.col("value") < 5).cast("double")).alias("slow"))
    return d.groupBy("user_id").agg(F.count("*").alias("active_days"), F.sum("n").alias("n"), F.round(F.avg("v"), 9).alias("mean_of_days"), F.round(ratio(F.sum(F.col("v") * F.col("n")), F.sum("n")), 9).alias("mean_of_rows"), F.round(F.max("mx"), 5).alias("mx"), r6(F.avg("slow")).alias("slow_share"), F.round(F.stddev_samp("v") / (F.avg("v") + 1e-6), 5).alias("day_cv"))


@query(_D + """, a AS (SELECT lang, 'p' arm, p s, y FROM d UNION ALL SELECT lang, 'p2', p2, y FROM d), r AS (SELECT lang, arm, y, rank() OVER (PARTITION BY lang, arm ORDER BY s) + (count(*) OVER (PARTITION BY lang, arm, s)-1)/2.0::DOUBLE rk FROM a),
u AS (SELECT lang, arm, round((sum(CASE WHEN y=1 THEN rk END) - sum(y)*(sum(y)+1)/2.0::DOUBLE)/nullif(sum(y)*(count(*)-sum(y)),0),6) auc FROM r GROUP BY 1,2),
w AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY auc DESC NULLS LAST, arm DESC) rn FROM u) SELECT lang AS "view", arm, auc FROM w WHERE rn = 1""")
def best_arm(spark, sf_dir):
    """For each view the scoring arm of best AUC, ties to the later name."""
    arms = F.array(F.struct(F.lit("p").alias("arm"), F.col("p").alias("s")), F.struct(F.lit("p2").alias("arm"), F.col("p2").alias("s")))
    a = scored(spark, sf_dir).select(F.col("lang").alias("view"), "y", F.inline(arms))
    u = evaluation.auc(a, "s", "y", ["view", "arm"]).select("view", "arm", r6("auc").alias("auc"))
    w = Window.partitionBy("view").orderBy(F.desc_nulls_last("auc"), F.desc("arm"))
    return u.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


@query()
def synthetic_rows(spark, sf_dir):
    """Seeded rows for tests: the same on any cluster, for every value is a hash of the seed and the id."""
    u = lambda name: F.pmod(F.xxhash64(F.lit(42), F.lit(name), F.col("id")), F.lit(1 << 20)) / float(1 << 20)
    r = spark.range(1000).select("id", *(u(c).alias(c) for c in ("x1", "x2", "noise")))
    return r.withColumns({"y": (F.col("x1") + 0.5 * F.col("x2") + 0.3 * F.col("noise") > 1.0).cast("int"), "fold": (F.col("id") % 5).cast("int")})
