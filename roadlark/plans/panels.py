"""Queries over daily panels: dense calendars, dynamics, rolling rates, decayed scores, cohorts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalars import knots, ratio
from ..operators import aggregates, joins
from ..operators.windows import average_rank, counts_below, dense_days, ewma, exact_quantiles, half, runs, trailing, with_position
from .registry import big, query, r6, table

FIRST, LAST = "2024-01-01", "2024-01-30"

_PANEL = """WITH u AS (SELECT DISTINCT user_id FROM events), cal AS (SELECT user_id, unnest(generate_series(DATE '2024-01-01', DATE '2024-01-30', INTERVAL 1 DAY))::DATE AS day FROM u),
n AS (SELECT user_id, ts::DATE AS day, count(*) n, count(*) FILTER (event_type='error') e FROM events GROUP BY 1,2),
p AS (SELECT cal.user_id, cal.day, coalesce(n,0) n, coalesce(e,0) e, date_diff('day', DATE '2024-01-01', cal.day) d FROM cal LEFT JOIN n ON cal.user_id=n.user_id AND cal.day=n.day)
"""


def panel(spark, sf_dir):
    """(user, day, n, e, d): every user with every day."""
    ev = table(spark, sf_dir, "events")
    counts = ev.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("e"))
    out = dense_days(ev.select("user_id").distinct(), FIRST, LAST).join(counts, ["user_id", "day"], "left")
    return out.withColumns({"n": F.coalesce("n", F.lit(0)), "e": F.coalesce("e", F.lit(0)), "d": F.date_diff("day", F.lit(FIRST).cast("date"))})


@query(_PANEL + """, q AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day) rn FROM p),
z AS (SELECT user_id, grp, count(*) len FROM (SELECT user_id, n, rn - row_number() OVER (PARTITION BY user_id, n=0 ORDER BY day) grp FROM q) WHERE n=0 GROUP BY 1,2),
zz AS (SELECT user_id, max(len) longest_gap FROM z GROUP BY 1)
SELECT q.user_id, round(regr_slope(n, rn),6) slope, round((avg(n) FILTER (rn > 15) + 0.5) / (avg(n) FILTER (rn <= 15) + 0.5),6) late_over_early, coalesce(max(longest_gap),0)::BIGINT longest_gap, round(avg(CASE WHEN n=0 THEN 1.0 ELSE 0 END)::DOUBLE,6) gap_share, max(n) busiest, round(max(n)/sum(n)::DOUBLE,6) concentration, round(stddev_samp(n)/(avg(n)+1e-6),6) cv
FROM q LEFT JOIN zz USING (user_id) GROUP BY q.user_id""")
def panel_dynamics(spark, sf_dir):
    p = panel(spark, sf_dir)
    w = Window.partitionBy("user_id").orderBy("day")
    p = runs(p, ["user_id"], ["day"], F.col("n") == 0, "run").withColumn("rn", F.row_number().over(w))
    p = p.withColumn("half", half(F.col("rn"), F.count("*").over(Window.partitionBy("user_id"))))
    p = p.withColumn("len", F.when(F.col("n") == 0, F.count("*").over(Window.partitionBy("user_id", "run"))))
    part = lambda h: F.avg(F.when(F.col("half") == h, F.col("n")))
    return p.groupBy("user_id").agg(
        r6(F.regr_slope("n", "rn")).alias("slope"), r6((part("late") + 0.5) / (part("early") + 0.5)).alias("late_over_early"), big(F.coalesce(F.max("len"), F.lit(0))).alias("longest_gap"),
        r6(F.avg((F.col("n") == 0).cast("double"))).alias("gap_share"), F.max("n").alias("busiest"), r6(ratio(F.max("n"), F.sum("n"))).alias("concentration"), r6(F.stddev_samp("n") / (F.avg("n") + 1e-6)).alias("cv"))


@query(_PANEL + "SELECT user_id, day, sum(n) OVER (PARTITION BY user_id ORDER BY d RANGE BETWEEN 20 PRECEDING AND 1 PRECEDING)::BIGINT n20, round(sum(n) OVER (PARTITION BY user_id ORDER BY d RANGE BETWEEN 20 PRECEDING AND 1 PRECEDING)/20.0::DOUBLE,6) rate20, sum((e>0)::INT) OVER (PARTITION BY user_id ORDER BY d RANGE BETWEEN 13 PRECEDING AND CURRENT ROW)::BIGINT risk_days14 FROM p")
def rolling_rates(spark, sf_dir):
    p = panel(spark, sf_dir)
    n20 = trailing(F.col("n"), "user_id", F.col("d"), -20, -1)
    return p.select("user_id", "day", n20.alias("n20"), r6(n20 / 20).alias("rate20"), trailing((F.col("e") > 0).cast("int"), "user_id", F.col("d"), -13, 0).alias("risk_days14"))


@query(_PANEL + """, q AS (SELECT user_id, n, e, row_number() OVER (PARTITION BY user_id ORDER BY day DESC) - 1 AS back FROM p WHERE n > 0)
SELECT user_id, round(sum(e * pow(0.9::DOUBLE, back)),6) decayed, sum(n)::BIGINT exposure, round(sum(n)/(sum(n)+10.0::DOUBLE),6) reliability, round(sum(n)/(sum(n)+10.0::DOUBLE) * greatest(100 - 5 * sum(e * pow(0.9::DOUBLE, back)), 0) + (1 - sum(n)/(sum(n)+10.0::DOUBLE)) * 80, 5) score FROM q GROUP BY 1""")
def ewma_score(spark, sf_dir):
    p = panel(spark, sf_dir).filter("n > 0")
    g = p.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("d", "e"))).alias("days"), F.sum("n").alias("exposure"))
    s = ewma(F.transform("days", lambda x: x.e.cast("double")), 0.9)
    trust = F.col("exposure") / (F.col("exposure") + 10)
    g = g.select("user_id", s.alias("s"), "exposure", trust.alias("trust"))
    return g.select("user_id", r6("s").alias("decayed"), "exposure", r6("trust").alias("reliability"), F.round(F.col("trust") * F.greatest(100 - 5 * F.col("s"), F.lit(0.0)) + (1 - F.col("trust")) * 80, 5).alias("score"))


@query(_PANEL + """, r AS (SELECT user_id, day, sum(n) OVER (PARTITION BY user_id ORDER BY d RANGE BETWEEN 20 PRECEDING AND 1 PRECEDING)/20.0::DOUBLE x FROM p),
k AS (SELECT quantile_cont(x,0.5) k50, quantile_cont(x,0.75) k75, quantile_cont(x,0.95) k95 FROM r WHERE x IS NOT NULL)
SELECT user_id, day, round(CASE WHEN x <= 0 THEN 0 WHEN x <= k50 THEN 0.5*x/k50 WHEN x <= k75 THEN 0.5 + 0.25*(x-k50)/(k75-k50) WHEN x <= k95 THEN 0.75 + 0.25*(x-k75)/(k95-k75) WHEN x IS NOT NULL THEN 1 END,6) frac FROM r, k""")
def knot_replay(spark, sf_dir):
    p = panel(spark, sf_dir)
    x = trailing(F.col("n"), "user_id", F.col("d"), -20, -1) / 20.0
    r = p.select("user_id", "day", x.alias("x"))
    k = exact_quantiles(r, "x", {"k50": 0.5, "k75": 0.75, "k95": 0.95})
    return r.join(F.broadcast(k)).select("user_id", "day", r6(knots(F.col("x"), F.col("k50"), F.col("k75"), F.col("k95"))).alias("frac"))  # k: one row


@query("""
WITH o AS (SELECT o_custkey, count(*) n, sum(o_totalprice) v, count(DISTINCT o_orderdate::DATE) AS days FROM orders GROUP BY 1)
SELECT c_custkey, coalesce(n,0) orders, CASE WHEN v >= 100000 THEN round(n*100000.0::DOUBLE/v,6) END per_100k, CASE WHEN days >= 3 THEN round(n*10.0::DOUBLE/days,6) END per_10_days, CASE WHEN coalesce(v,0) < 100000 OR coalesce(days,0) < 3 THEN 1 ELSE 0 END low_exposure, round((coalesce(n,0) + 5.0::DOUBLE * (SELECT sum(n)/sum(days)::DOUBLE FROM o)) / (coalesce(days,0) + 5.0),6) smoothed
FROM customer LEFT JOIN o ON c_custkey = o_custkey""")
def exposure_rates(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("v"), F.count_distinct(F.to_date("o_orderdate")).alias("days"))
    prior = o.agg(ratio(F.sum("n"), F.sum("days")).alias("prior"))
    c = joins.on_roster(table(spark, sf_dir, "customer").select("c_custkey"), o, "c_custkey", ["n", "days"]).join(F.broadcast(prior))  # one row
    return c.select("c_custkey", F.col("n").alias("orders"), r6(aggregates.exposure_rate(F.col("n"), F.col("v"), 100_000, 100_000)).alias("per_100k"), r6(aggregates.exposure_rate(F.col("n"), F.col("days"), 10, 3)).alias("per_10_days"),
                    ((F.coalesce("v", F.lit(0.0)) < 100_000) | (F.col("days") < 3)).cast("int").alias("low_exposure"), r6(aggregates.smooth_rate(F.col("n"), F.col("days"), F.col("prior"), 5.0)).alias("smoothed"))


_COHORT = """WITH c AS (SELECT c_custkey, c_acctbal x, c_mktsegment seg, (c_custkey % 5)::INT fold FROM customer), f AS (SELECT unnest(range(5))::INT f),
m AS (SELECT f, median(x) med FROM c, f WHERE fold <> f GROUP BY f),
k AS (SELECT c.*, f, seg || ':' || CASE WHEN x > med THEN 'hi' ELSE 'lo' END cohort FROM c, m WHERE true),
st AS (SELECT f, cohort, avg(x) mu, stddev_pop(x) sd, count(*) n FROM k WHERE fold <> f GROUP BY 1,2), g AS (SELECT f, avg(x) mu, stddev_pop(x) sd FROM k WHERE fold <> f GROUP BY 1)
"""


@query(_COHORT + """SELECT c_custkey, k.cohort, CASE WHEN coalesce(n,0) < 30 THEN 1 ELSE 0 END fallback, round(CASE WHEN coalesce(n,0) < 30 THEN CASE WHEN g.sd > 1e-9 THEN (x-g.mu)/g.sd END ELSE CASE WHEN st.sd > 1e-9 THEN (x-st.mu)/st.sd END END,6) z
FROM k LEFT JOIN st ON k.f=st.f AND k.cohort=st.cohort JOIN g ON g.f=k.f WHERE k.fold = k.f""")
def cohort_relative(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("x"), F.col("c_mktsegment").alias("seg"), (F.col("c_custkey") % 5).cast("int").alias("fold"))
    others = c.select("x", F.explode(F.filter(F.array(*map(F.lit, range(5))), lambda f: f != F.col("fold"))).alias("target_fold"))
    med = exact_quantiles(others, "x", {"med": 0.5}, "target_fold").drop("n")
    keyed = lambda df: df.withColumn("cohort", F.concat("seg", F.lit(":"), F.when(F.col("x") > F.col("med"), "hi").otherwise("lo")))
    train = keyed(c.join(F.broadcast(med), F.col("fold") != F.col("target_fold")))  # one row for each of 5 folds
    st = train.groupBy("target_fold", "cohort").agg(F.avg("x").alias("mu"), F.stddev_pop("x").alias("sd"), F.count("*").alias("n"))
    g = train.groupBy("target_fold").agg(F.avg("x").alias("gmu"), F.stddev_pop("x").alias("gsd"))
    own = keyed(c.join(F.broadcast(med), F.col("fold") == F.col("target_fold")))
    out = own.join(st, ["target_fold", "cohort"], "left").join(F.broadcast(g), "target_fold")
    few = F.coalesce("n", F.lit(0)) < 30
    z = lambda mu, sd: F.when(F.col(sd) > 1e-9, (F.col("x") - F.col(mu)) / F.col(sd))
    return out.select("c_custkey", "cohort", few.cast("int").alias("fallback"), r6(F.when(few, z("gmu", "gsd")).otherwise(z("mu", "sd"))).alias("z"))


@query("""
WITH o AS (SELECT o_custkey, count(*) n, sum(o_totalprice) v FROM orders GROUP BY 1),
q AS (SELECT quantile_cont(n, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) edges FROM o),
b AS (SELECT o_custkey, v, len(list_filter(edges, lambda x: x < n)) + 1 decile FROM o, q),
r AS (SELECT *, rank() OVER (PARTITION BY decile ORDER BY v) + (count(*) OVER (PARTITION BY decile, v) - 1)/2.0::DOUBLE rk, count(*) OVER (PARTITION BY decile) c FROM b)
SELECT o_custkey, decile::BIGINT decile, round(rk/c,6) pct FROM r""")
def decile_percentile(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), aggregates.steady_sum(F.col("o_totalprice")).alias("v"))  # equal sums are ties
    edges = exact_quantiles(o, "n", {f"e{i}": i / 10 for i in range(1, 10)}).select(F.array(*(f"e{i}" for i in range(1, 10))).alias("edges"))
    b = o.join(F.broadcast(edges)).withColumn("decile", big(F.size(F.filter("edges", lambda e: e < F.col("n"))) + 1))  # edges: one row
    rank = counts_below(b, ["decile"], "v").select("decile", "v", r6((F.col("__below") + (F.col("__n") + 1) / 2) / F.col("__all")).alias("pct"))
    return b.join(rank, ["decile", "v"]).select("o_custkey", "decile", "pct")


@query("""
WITH a AS (SELECT o_custkey k, o_orderdate::DATE d, count(*) n, sum(o_totalprice) v FROM orders GROUP BY 1,2), b AS (SELECT o_custkey k, o_orderdate::DATE d, count(*) m FROM orders WHERE o_orderpriority LIKE '1%' GROUP BY 1,2)
SELECT coalesce(a.k,b.k) k, coalesce(a.d,b.d) d, coalesce(n,0) n, coalesce(m,0) m, round(v,4) v FROM a FULL OUTER JOIN b ON a.k=b.k AND a.d=b.d""")
def day_union(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumns({"k": F.col("o_custkey"), "d": F.to_date("o_orderdate")})
    a = o.groupBy("k", "d").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("v"))
    b = o.filter(F.col("o_orderpriority").startswith("1")).groupBy("k", "d").agg(F.count("*").alias("m"))
    return a.join(b, ["k", "d"], "full_outer").select("k", "d", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("m", F.lit(0)).alias("m"), F.round("v", 4).alias("v"))


@query("""
WITH a AS (SELECT o_custkey k, count(*) n, sum(o_totalprice) v FROM orders GROUP BY 1), b AS (SELECT o_custkey k, count(*) n, sum(o_totalprice) v FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1)
SELECT count(*) keys, count(*) FILTER (a.n = b.n) same_count, count(*) FILTER (abs(a.v - b.v) <= 1e-6) AS within, count(*) FILTER (b.k IS NULL) missing, max(a.n - coalesce(b.n,0)) widest FROM a LEFT JOIN b USING (k)""")
def reconciliation(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    agg = lambda df, s: df.groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n" + s), F.sum("o_totalprice").alias("v" + s))
    met = agg(o, "1").join(agg(o.filter("o_orderstatus <> 'P'"), "2"), "k", "left")
    return met.agg(F.count("*").alias("keys"), F.count_if(F.col("n1") == F.col("n2")).alias("same_count"), F.count_if(F.abs(F.col("v1") - F.col("v2")) <= 1e-6).alias("within"), F.count_if(F.col("n2").isNull()).alias("missing"), F.max(F.col("n1") - F.coalesce("n2", F.lit(0))).alias("widest"))


@query(_PANEL + """, t AS (SELECT user_id, sum(n) FILTER (d < 10) a, sum(n) FILTER (d < 20) b, sum(n) c FROM p GROUP BY 1),
r AS (SELECT user_id, a::BIGINT a, b::BIGINT b, c::BIGINT c, row_number() OVER (ORDER BY a, user_id) ra, row_number() OVER (ORDER BY c, user_id) rc FROM t)
SELECT user_id, a, b, c, c - a change, CASE WHEN c > 2*a THEN 'improved' WHEN c < 2*a THEN 'worsened' ELSE 'unchanged' END direction, abs(ra-rc) moved FROM r""")
def three_cutoffs(spark, sf_dir):
    p = panel(spark, sf_dir)
    upto = lambda k: big(F.sum(F.when(F.col("d") < k, F.col("n")).otherwise(0)))
    t = p.groupBy("user_id").agg(upto(10).alias("a"), upto(20).alias("b"), upto(30).alias("c"))
    t = with_position(with_position(t, ["a", "user_id"], "ra"), ["c", "user_id"], "rc")
    way = F.when(F.col("c") > 2 * F.col("a"), "improved").when(F.col("c") < 2 * F.col("a"), "worsened").otherwise("unchanged")
    return t.select("user_id", "a", "b", "c", (F.col("c") - F.col("a")).alias("change"), way.alias("direction"), big(F.abs(F.col("ra") - F.col("rc"))).alias("moved"))


@query("""
WITH p AS (SELECT user_id, event_type dimension, avg(CASE WHEN value > 20 THEN 1.0 ELSE 0.0 END)::DOUBLE share FROM events GROUP BY 1,2)
SELECT user_id, count(*) dimensions, CASE WHEN count(*) >= 3 THEN round(avg(100*(1-share)),6) END score FROM p GROUP BY 1""")
def presence_baseline(spark, sf_dir):
    from ..operators.rules import presence_baseline as baseline

    return baseline(table(spark, sf_dir, "events"), "user_id", "event_type", F.col("value") > 20).withColumn("score", r6("score"))


@query("""
WITH e AS (SELECT user_id, event_type, count(*)::DOUBLE pts FROM events GROUP BY 1,2), g AS (SELECT user_id, max(pts) mx, sum(pts) s, count(*) c FROM e GROUP BY 1)
SELECT user_id, round(mx + 0.25 * CASE WHEN c > 1 THEN (s-mx)/(c-1) ELSE 0 END,6) deduction FROM g""")
def group_deduction(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").cast("double").alias("pts"))
    return e.groupBy("user_id").agg(r6(aggregates.diminishing("pts")).alias("deduction"))
