"""Queries over the event log: windows, families, chains, segments, transitions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalars import category, clip, epoch_seconds, hour_of_day, is_night, ratio, sha_key, smoothed_lift, sorted_pair, time_band
from ..operators import joins, sessions
from ..operators.cleaning import coordinate_rules, drop_exact_duplicates, speed_rules, split_window
from ..operators.windows import in_history, in_label_window, islands
from .registry import AS_OF, LOOKBACK, big, query, r6, table

FAMILIES = {"total": None, "error": ["error"], "commerce": ["purchase"], "attention": ["click", "view"], "onboarding": ["signup"]}
TOP_N = 12


@query("""
WITH u AS (SELECT DISTINCT user_id FROM events),
w AS (SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-21'),
c AS (SELECT user_id,
  count(*) FILTER (ts >= TIMESTAMP '2024-01-16') total_5d, count(*) FILTER (ts >= TIMESTAMP '2024-01-11') total_10d, count(*) total_20d,
  count(*) FILTER (event_type='error' AND ts >= TIMESTAMP '2024-01-16') error_5d, count(*) FILTER (event_type='error' AND ts >= TIMESTAMP '2024-01-11') error_10d, count(*) FILTER (event_type='error') error_20d,
  count(*) FILTER (event_type='purchase' AND ts >= TIMESTAMP '2024-01-16') commerce_5d, count(*) FILTER (event_type='purchase' AND ts >= TIMESTAMP '2024-01-11') commerce_10d, count(*) FILTER (event_type='purchase') commerce_20d,
  count(*) FILTER (event_type IN ('click','view') AND ts >= TIMESTAMP '2024-01-16') attention_5d, count(*) FILTER (event_type IN ('click','view') AND ts >= TIMESTAMP '2024-01-11') attention_10d, count(*) FILTER (event_type IN ('click','view')) attention_20d,
  count(*) FILTER (event_type='signup' AND ts >= TIMESTAMP '2024-01-16') onboarding_5d, count(*) FILTER (event_type='signup' AND ts >= TIMESTAMP '2024-01-11') onboarding_10d, count(*) FILTER (event_type='signup') onboarding_20d,
  max(ts) FILTER (event_type='error') last_error
  FROM w GROUP BY user_id)
SELECT user_id, coalesce(total_5d,0) total_5d, coalesce(total_10d,0) total_10d, coalesce(total_20d,0) total_20d,
 coalesce(error_5d,0) error_5d, coalesce(error_10d,0) error_10d, coalesce(error_20d,0) error_20d,
 coalesce(commerce_5d,0) commerce_5d, coalesce(commerce_10d,0) commerce_10d, coalesce(commerce_20d,0) commerce_20d,
 coalesce(attention_5d,0) attention_5d, coalesce(attention_10d,0) attention_10d, coalesce(attention_20d,0) attention_20d,
 coalesce(onboarding_5d,0) onboarding_5d, coalesce(onboarding_10d,0) onboarding_10d, coalesce(onboarding_20d,0) onboarding_20d,
 round((1705795200 - floor(epoch(last_error))::BIGINT) / 86400.0::DOUBLE, 6) days_since_error,
 CASE WHEN last_error IS NULL THEN 1 ELSE 0 END never_error,
 round((coalesce(total_5d,0) + 0.5) / (coalesce(total_20d,0) * 0.25::DOUBLE + 0.5), 6) total_lift
FROM u LEFT JOIN c USING (user_id)""")
def family_window_counts(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    w = ev.filter(in_history(F.col("ts"), AS_OF, LOOKBACK))
    of = lambda types: F.lit(True) if types is None else F.col("event_type").isin(*types)
    counts = {f"{n}_{d}d": F.count_if(of(t) & in_history(F.col("ts"), AS_OF, d)) for n, t in FAMILIES.items() for d in (5, 10, 20)}
    last = F.max(F.when(F.col("event_type") == "error", epoch_seconds(F.col("ts"))))
    facts = w.groupBy("user_id").agg(*(c.alias(n) for n, c in counts.items()), last.alias("__last"))
    out = joins.on_roster(ev.select("user_id").distinct(), facts, "user_id", list(counts))
    as_of = epoch_seconds(F.lit(AS_OF).cast("timestamp_ntz"))
    return out.select("user_id", *counts, r6(ratio(as_of - F.col("__last"), F.lit(86400))).alias("days_since_error"), F.col("__last").isNull().cast("int").alias("never_error"), r6(smoothed_lift(F.col("total_5d"), F.col("total_20d"), 0.25)).alias("total_lift"))


@query("""
WITH s AS (SELECT user_id, user_id::VARCHAR || '_20240121_20' sample_id FROM (SELECT DISTINCT user_id FROM events)),
d AS (SELECT user_id, ts::DATE d, count(*) n, sum(value) v FROM events GROUP BY 1, 2)
SELECT sample_id, count(d.d) active_days, coalesce(sum(n),0)::BIGINT events, round(coalesce(sum(v),0),4) total_value, round(least(greatest(count(d.d)/20.0::DOUBLE,0),1),6) coverage
FROM s LEFT JOIN d ON s.user_id = d.user_id AND d.d >= DATE '2024-01-01' AND d.d < DATE '2024-01-21' GROUP BY sample_id""")
def interval_join_coverage(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    end = F.lit(AS_OF).cast("date")
    samples = ev.select("user_id").distinct().select("user_id", F.concat(F.col("user_id").cast("string"), F.lit("_20240121_20")).alias("sample_id"), F.date_sub(end, LOOKBACK).alias("start"), end.alias("end"))
    days = ev.groupBy("user_id", F.to_date("ts").alias("d")).agg(F.count("*").alias("n"), F.sum("value").alias("v"))
    met = joins.interval_join(days, samples, "user_id", F.col("d"), F.col("start"), F.col("end"))
    a = met.groupBy("sample_id").agg(F.count("d").alias("active_days"), F.sum("n").alias("events"), F.sum("v").alias("v"))
    out = joins.on_roster(samples.select("sample_id"), a, "sample_id", ["active_days", "events", "v"])
    return out.select("sample_id", "active_days", "events", F.round("v", 4).alias("total_value"), r6(clip(ratio(F.col("active_days"), F.lit(20)), 0.0, 1.0)).alias("coverage"))


@query("""
WITH e AS (SELECT DISTINCT user_id, event_type, ts, value FROM events WHERE ts >= TIMESTAMP '2024-01-21' AND ts < TIMESTAMP '2024-01-31'),
u AS (SELECT DISTINCT user_id FROM events),
c AS (SELECT user_id, count(*) FILTER (event_type='error') errors, count(*) FILTER (event_type='signup') signups FROM e GROUP BY 1)
SELECT user_id, coalesce(errors,0) errors, coalesce(signups,0) signups, CASE WHEN coalesce(errors,0) >= 1 OR coalesce(signups,0) >= 2 THEN 1 ELSE 0 END y FROM u LEFT JOIN c USING (user_id)""")
def label_binary(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    e = drop_exact_duplicates(ev.filter(in_label_window(F.col("ts"), AS_OF, 10)), ["user_id", "event_type", "ts", "value"])
    c = e.groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if(F.col("event_type") == "signup").alias("signups"))
    out = joins.on_roster(ev.select("user_id").distinct(), c, "user_id", ["errors", "signups"])
    return out.withColumn("y", ((F.col("errors") >= 1) | (F.col("signups") >= 2)).cast("int"))


@query("""
WITH c AS (SELECT c_custkey, c_mktsegment, sha256('42:' || c_custkey::VARCHAR) k FROM customer)
SELECT c_custkey, c_mktsegment, ((row_number() OVER (PARTITION BY c_mktsegment ORDER BY k) - 1) % 5)::INTEGER fold FROM c""")
def stratified_fold(spark, sf_dir):
    row = F.row_number().over(Window.partitionBy("c_mktsegment").orderBy(sha_key(F.col("c_custkey"))))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", ((row - 1) % 5).alias("fold"))


@query("""
WITH a AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch(ts)::BIGINT - epoch(lag(ts) OVER w)::BIGINT > 3600 THEN 1 ELSE 0 END b FROM (SELECT event_id, user_id, event_type, date_trunc('second', ts) ts FROM events) WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id))
SELECT user_id, count(*) raw_events, sum(b)::BIGINT segments FROM a GROUP BY user_id""")
def event_segments(spark, sf_dir):
    ev = table(spark, sf_dir, "events").withColumn("s", epoch_seconds(F.col("ts")))
    seg = islands(ev, ["user_id", "event_type"], ["s", "event_id"], F.col("s"), 3600, "seg")
    per = seg.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.max("seg").alias("k"))
    return per.groupBy("user_id").agg(F.sum("n").alias("raw_events"), big(F.sum("k")).alias("segments"))


_CHAIN = """WITH e AS (SELECT event_id, user_id, event_type, epoch(date_trunc('second', ts))::BIGINT s FROM events),
b AS (SELECT *, CASE WHEN lag(s) OVER w IS NULL OR s - lag(s) OVER w > 21600 THEN 1 ELSE 0 END b FROM e WINDOW w AS (PARTITION BY user_id ORDER BY s, event_id)),
c AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS UNBOUNDED PRECEDING)::BIGINT chain FROM b)
"""


def _chained(spark, sf_dir):
    ev = table(spark, sf_dir, "events").withColumn("s", epoch_seconds(F.col("ts")))
    return islands(ev, ["user_id"], ["s", "event_id"], F.col("s"), 6 * 3600, "chain")


@query(_CHAIN + """, g AS (SELECT user_id, chain, count(*) n, max(s)-min(s) span FROM c GROUP BY 1,2)
SELECT user_id, count(*) chains, count(*) FILTER (n >= 2) chains_multi, coalesce(sum(n) FILTER (n >= 2),0)::BIGINT events_in_chains, max(n) longest, max(span) longest_s FROM g GROUP BY 1""")
def event_chains(spark, sf_dir):
    g = _chained(spark, sf_dir).groupBy("user_id", "chain").agg(F.count("*").alias("n"), (F.max("s") - F.min("s")).alias("span"))
    return g.groupBy("user_id").agg(F.count("*").alias("chains"), F.count_if(F.col("n") >= 2).alias("chains_multi"), F.coalesce(F.sum(F.when(F.col("n") >= 2, F.col("n"))), F.lit(0)).alias("events_in_chains"), F.max("n").alias("longest"), F.max("span").alias("longest_s"))


@query(_CHAIN + """, p AS (SELECT c.user_id, 'pair_' || least(c.event_type,d.event_type) || '__' || greatest(c.event_type,d.event_type) pair FROM c JOIN c d ON c.user_id=d.user_id AND c.chain=d.chain AND (c.s,c.event_id) < (d.s,d.event_id))
SELECT user_id, pair, count(*) pairs FROM p GROUP BY 1,2""")
def chain_copairs(spark, sf_dir):
    p = joins.pairs_within(_chained(spark, sf_dir), ["user_id", "chain"], "event_id", "event_type")
    return p.groupBy("user_id", sorted_pair("pair_", F.col("a"), F.col("b")).alias("pair")).agg(F.sum("pairs").alias("pairs"))


CONTRACT = [("error", "risk", 21600, "lead"), ("purchase", "commerce", 43200, "lead"), ("click", "attention", 7200, "lead"), ("view", "attention", 7200, "lead"), ("signup", "onboarding", 0, "outcome")]


@query("""
WITH k(event_type, chain, merge_s, role) AS (VALUES ('error','risk',21600,'lead'),('purchase','commerce',43200,'lead'),('click','attention',7200,'lead'),('view','attention',7200,'lead'),('signup','onboarding',0,'outcome')),
e AS (SELECT event_id, user_id, event_type, value, chain, merge_s, epoch(date_trunc('second', ts))::BIGINT s FROM events JOIN k USING (event_type) WHERE role <> 'outcome'),
b AS (SELECT *, CASE WHEN lag(s) OVER w IS NULL OR s - lag(s) OVER w > merge_s THEN 1 ELSE 0 END b FROM e WINDOW w AS (PARTITION BY user_id, chain ORDER BY s, event_id)),
c AS (SELECT *, sum(b) OVER (PARTITION BY user_id, chain ORDER BY s, event_id ROWS UNBOUNDED PRECEDING)::BIGINT segment FROM b),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, chain, segment ORDER BY value DESC, s, event_id) rn FROM c)
SELECT user_id, chain, segment, min(s) start_s, max(s) end_s, count(*) events, max(CASE WHEN rn=1 THEN event_type END) representative, array_to_string(list_sort(list(DISTINCT event_type)), ',') merged_codes FROM r GROUP BY 1,2,3""")
def risk_segments(spark, sf_dir):
    contract = spark.createDataFrame(CONTRACT, "event_type string, chain string, merge_s long, role string")
    s = sessions.risk_segments(table(spark, sf_dir, "events"), contract, "user_id", "event_type", F.col("ts"), "value", "event_id")
    return s.withColumn("merged_codes", F.array_join("merged_codes", ","))


_T12 = """WITH p AS (SELECT user_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) || '>' || event_type pair FROM events),
t AS (SELECT pair, count(*) n FROM p WHERE pair IS NOT NULL GROUP BY 1 ORDER BY n DESC, pair LIMIT 12)
"""


@query(_T12 + "SELECT user_id, pair, count(*) n FROM p JOIN t USING (pair) GROUP BY 1,2")
def transitions_top12(spark, sf_dir):
    t = sessions.transitions(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type").withColumn("pair", F.concat("previous", F.lit(">"), "next"))
    top = t.groupBy("pair").agg(F.sum("n").alias("all")).orderBy(F.desc("all"), "pair").limit(TOP_N).select("pair")
    return t.join(F.broadcast(top), "pair").select("user_id", "pair", "n")  # TOP_N rows


@query("""
WITH g AS (SELECT user_id, (epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)))/60 m FROM (SELECT event_id, user_id, date_trunc('second', ts) ts FROM events))
SELECT user_id, round(quantile_cont(m,0.25),4) p25, round(quantile_cont(m,0.5),4) p50, round(quantile_cont(m,0.75),4) p75 FROM g WHERE m IS NOT NULL GROUP BY 1""")
def interval_quartiles(spark, sf_dir):
    ev = table(spark, sf_dir, "events").withColumn("s", epoch_seconds(F.col("ts")))
    gap = (F.col("s") - F.lag("s").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))) / 60
    g = ev.select("user_id", gap.alias("m")).filter("m is not null").groupBy("user_id").agg(F.percentile("m", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    return g.select("user_id", *(F.round(F.col("q")[i], 4).alias(n) for i, n in enumerate(("p25", "p50", "p75"))))


@query("""
WITH w AS (SELECT * FROM (SELECT user_id, date_trunc('second', ts) ts, event_id FROM events) WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-21'),
d AS (SELECT user_id, ts::DATE d, count(*) n FROM w GROUP BY 1,2), m AS (SELECT user_id, max(n) mx FROM d GROUP BY 1),
g AS (SELECT user_id, epoch(ts)::BIGINT - lag(epoch(ts)::BIGINT) OVER (PARTITION BY user_id ORDER BY ts, event_id) gap, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) rn FROM w),
a AS (SELECT user_id, count(*) n, sum(CASE WHEN ts >= TIMESTAMP '2024-01-16' THEN 2 ELSE 1 END)::BIGINT decayed, count(*) FILTER (ts >= TIMESTAMP '2024-01-11') back, count(*) FILTER (ts < TIMESTAMP '2024-01-11') front FROM w GROUP BY 1)
SELECT a.user_id, n, decayed, g.gap last_gap_s, round(mx / (n / 20.0::DOUBLE), 6) burst, round((back-front)/10.0::DOUBLE, 6) trend, round(decayed * ((back-front)/10.0::DOUBLE), 6) interaction
FROM a JOIN m USING (user_id) JOIN g ON a.user_id=g.user_id AND rn=1""")
def hist_decay_trend(spark, sf_dir):
    w = table(spark, sf_dir, "events").filter(in_history(F.col("ts"), AS_OF, LOOKBACK)).withColumn("s", epoch_seconds(F.col("ts")))
    w = w.withColumn("gap", F.col("s") - F.lag("s").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    recent, back = in_history(F.col("ts"), AS_OF, 5), in_history(F.col("ts"), AS_OF, 10)
    per = w.groupBy("user_id", F.to_date("ts").alias("d")).agg(F.count("*").alias("n"), F.sum(F.when(recent, 2).otherwise(1)).alias("dec"), F.count_if(back).alias("b"), F.max_by("gap", F.struct("ts", "event_id")).alias("g"))
    a = per.groupBy("user_id").agg(F.sum("n").alias("n"), F.sum("dec").alias("decayed"), F.max_by("g", "d").alias("last_gap_s"), F.max("n").alias("mx"), F.sum("b").alias("b"))
    trend = (2 * F.col("b") - F.col("n")) / F.lit(10.0)
    return a.select("user_id", "n", "decayed", "last_gap_s", r6(F.col("mx") / (F.col("n") / 20)).alias("burst"), r6(trend).alias("trend"), r6(F.col("decayed") * trend).alias("interaction"))


@query("""
WITH e AS (SELECT event_type, user_id, hour(ts) h FROM events), b AS (SELECT *, (h >= 23 OR h < 5) night, (h >= 9 AND h < 17) dayp FROM e),
g AS (SELECT user_id, coalesce(event_type, '__merged__') scenario, grouping(event_type) gr, count(*) n, count(*) FILTER (night) night_n, count(*) FILTER (dayp) day_n FROM b GROUP BY GROUPING SETS ((user_id, event_type),(user_id)))
SELECT user_id, scenario, n, night_n, day_n, CASE WHEN n >= 5 AND day_n > 0 THEN round((night_n/6.0::DOUBLE)/(day_n/8.0::DOUBLE),6) END degradation FROM g""")
def night_degradation(spark, sf_dir):
    ev = table(spark, sf_dir, "events").withColumn("h", hour_of_day(F.col("ts")))
    g = ev.groupingSets([[F.col("user_id"), F.col("event_type")], [F.col("user_id")]], F.col("user_id"), F.col("event_type")).agg(
        F.count("*").alias("n"), F.count_if(is_night(F.col("h"), "research")).alias("night_n"), F.count_if((F.col("h") >= 9) & (F.col("h") < 17)).alias("day_n"))
    rate = ratio(F.col("night_n") / 6, F.col("day_n") / 8)
    return g.select("user_id", category(F.col("event_type"), "__merged__").alias("scenario"), "n", "night_n", "day_n", r6(F.when(F.col("n") >= 5, rate)).alias("degradation"))


@query("""
SELECT event_id, CASE WHEN value < 0 OR value > 200 THEN NULL ELSE round(value,6) END speed, CASE WHEN value IS NULL THEN 'missing' WHEN value < 0 OR value > 200 THEN 'invalid' WHEN value >= 160 THEN 'high' ELSE 'ok' END speed_flag,
 CASE WHEN event_id % 97 = 0 THEN NULL ELSE round(30 + (event_id % 1000)/1000.0::DOUBLE,6) END lat, CASE WHEN event_id % 97 = 0 THEN 'zero' ELSE 'ok' END coord_flag,
 CASE WHEN ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-21' THEN 'kept' ELSE 'quarantined' END fate,
 CASE WHEN hour(ts) >= 21 OR hour(ts) < 6 THEN 'night' WHEN hour(ts) < 9 THEN 'morning' WHEN hour(ts) < 18 THEN 'day' ELSE 'dusk' END band, json_extract_string(props, '$.k')::BIGINT k
FROM events""")
def clean_flags(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    zero = F.col("event_id") % 97 == 0
    lat, lon, flag = coordinate_rules(F.when(zero, 0.0).otherwise(30 + (F.col("event_id") % 1000) / 1000), F.when(zero, 0.0).otherwise(114.0))
    speed, speed_flag = speed_rules(F.col("value"))
    kept, out = split_window(ev, in_history(F.col("ts"), AS_OF, LOOKBACK))
    both = kept.withColumn("fate", F.lit("kept")).unionByName(out.withColumn("fate", F.lit("quarantined")))
    return both.select("event_id", r6(speed).alias("speed"), speed_flag.alias("speed_flag"), r6(lat).alias("lat"), flag.alias("coord_flag"), "fate", time_band(F.col("ts")).alias("band"), F.get_json_object("props", "$.k").try_cast("long").alias("k"))


@query("""
WITH e AS (SELECT user_id, event_type, date_trunc('second', ts) ts FROM events)
SELECT user_id, count(*) events, count(DISTINCT ts::DATE) active_days, count(DISTINCT event_type) types, round(ln(1 + count(*)),6) log_events, count(*) FILTER (event_type='click') n_click, count(*) FILTER (event_type='error') n_error, count(*) FILTER (event_type='purchase') n_purchase, count(*) FILTER (event_type='signup') n_signup, count(*) FILTER (event_type='view') n_view,
 round(avg(CASE WHEN isodow(ts) >= 6 THEN 1.0 ELSE 0.0 END)::DOUBLE,6) weekend_share, count(DISTINCT week(ts)) AS weeks FROM e GROUP BY 1""")
def activity_pivot(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    kinds = ["click", "error", "purchase", "signup", "view"]
    a = ev.groupBy("user_id").agg(F.count("*").alias("events"), F.count_distinct(F.to_date("ts")).alias("active_days"), F.count_distinct("event_type").alias("types"), r6(F.log1p(F.count("*").cast("double"))).alias("log_events"),
                                  r6(F.avg((F.weekday("ts") >= 5).cast("double"))).alias("weekend_share"), F.count_distinct(F.weekofyear("ts")).alias("weeks"))
    p = ev.groupBy("user_id").pivot("event_type", kinds).agg(F.count(F.lit(1)))
    p = p.select("user_id", *(F.coalesce(F.col(k), F.lit(0)).alias(f"n_{k}") for k in kinds))
    return a.join(p, "user_id")


@query("""
WITH e AS (SELECT event_id, user_id, event_type, value, epoch(date_trunc('second', ts))::BIGINT s FROM events),
l AS (SELECT * FROM e WHERE event_type='error'), r AS (SELECT * FROM e WHERE event_type='click'),
j AS (SELECT l.event_id, l.user_id, l.s, r.s rs, r.event_id rid, row_number() OVER (PARTITION BY l.event_id ORDER BY abs(l.s-r.s), r.s, r.event_id) rn FROM l LEFT JOIN r ON l.user_id=r.user_id AND abs(l.s-r.s) <= 14400)
SELECT event_id, user_id, s, rs nearest_s, rid click_id FROM j WHERE rn = 1""")
def nearest_event(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("s", epoch_seconds(F.col("ts")))
    left = e.filter("event_type = 'error'").select("event_id", "user_id", "s")
    right = e.filter("event_type = 'click'").select("user_id", F.col("s").alias("rs"), F.col("event_id").alias("click_id"))
    return joins.nearest_in_time(left, right, "user_id", "s", "rs", 14400, ["click_id"], ["click_id"])


@query("""
WITH e AS (SELECT user_id, event_type, value, epoch(date_trunc('second', ts))::BIGINT s, event_id FROM events),
b AS (SELECT *, CASE WHEN lag(s) OVER w IS NULL OR s - lag(s) OVER w > 7200 THEN 1 ELSE 0 END b FROM e WINDOW w AS (PARTITION BY user_id, event_type ORDER BY s, value)),
c AS (SELECT *, sum(b) OVER (PARTITION BY user_id, event_type ORDER BY s, value ROWS UNBOUNDED PRECEDING)::BIGINT event FROM b),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, event ORDER BY abs(value) DESC, s) rn FROM c)
SELECT user_id, event_type, event, min(s) start_s, max(s)-min(s) duration_s, count(*) "rows", max(CASE WHEN rn=1 THEN s END) peak_s, round(max(CASE WHEN rn=1 THEN value END),6) peak FROM r GROUP BY 1,2,3""")
def peak_events(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "value", epoch_seconds(F.col("ts")).alias("s"))
    return sessions.peak_events(e, ["user_id", "event_type"], "s", "value", 7200).withColumn("peak", r6("peak"))


@query("""
WITH RECURSIVE e AS (SELECT user_id, event_type, epoch(date_trunc('second', ts))::BIGINT s, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY date_trunc('second', ts), value) rn FROM events),
r AS (SELECT user_id, event_type, rn, s ks, value kv, 1 AS c FROM e WHERE rn = 1
 UNION ALL SELECT e.user_id, e.event_type, e.rn, CASE WHEN e.s - r.ks > 21600 OR abs(e.value) > abs(r.kv) THEN e.s ELSE r.ks END, CASE WHEN e.s - r.ks > 21600 OR abs(e.value) > abs(r.kv) THEN e.value ELSE r.kv END, r.c + CASE WHEN e.s - r.ks > 21600 THEN 1 ELSE 0 END
 FROM r JOIN e ON e.user_id = r.user_id AND e.event_type = r.event_type AND e.rn = r.rn + 1)
SELECT user_id, event_type, max_by(ks, rn) s, max_by(kv, rn) "value" FROM r GROUP BY user_id, event_type, c""")
def cool_down_events(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", epoch_seconds(F.col("ts")).alias("s"), "value")
    return sessions.cool_down(e, ["user_id", "event_type"], "s", "value", 6 * 3600)


@query("""
SELECT user_id, 'only_' || CASE WHEN a AND NOT b THEN 'first' ELSE 'second' END side FROM (SELECT user_id, bool_or(ts < TIMESTAMP '2024-01-03') a, bool_or(ts >= TIMESTAMP '2024-01-28') b FROM events GROUP BY 1) WHERE a <> b""")
def key_differences(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    d = joins.key_differences(ev.filter("ts < '2024-01-03'"), ev.filter("ts >= '2024-01-28'"), "user_id")
    return d.select("user_id", F.when(F.col("side") == "left", "only_first").otherwise("only_second").alias("side"))


@query("""
WITH x AS (SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1) title, regexp_extract(html, '<html lang="([a-z]+)"', 1) lang, regexp_extract(url, '^[a-z]+://([^/]+)', 1) host FROM pages)
SELECT page_id, title, lang, host, lpad(page_id::VARCHAR, 8, '0') padded FROM x""")
def html_extract(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"), F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"), F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"), F.lpad(F.col("page_id").cast("string"), 8, "0").alias("padded"))


@query("""
WITH a AS (SELECT user_id, max(ts) at FROM events WHERE event_type = 'error' GROUP BY 1)
SELECT a.user_id, count(e.ts) before, count(e.ts) FILTER (e.ts >= a."at" - INTERVAL 20 DAY) recent FROM a LEFT JOIN events e ON e.user_id = a.user_id AND e.ts < a."at" GROUP BY 1""".replace("max(ts) at", 'max(ts) AS "at"'))
def strict_past(spark, sf_dir):
    """Events strictly before each user's own day of reference, the last error: that row itself is not in its past."""
    ev = table(spark, sf_dir, "events")
    last = ev.filter("event_type = 'error'").groupBy("user_id").agg(F.max("ts").alias("at"))
    past = last.join(ev.select("user_id", "ts"), "user_id").filter(F.col("ts") < F.col("at"))
    n = past.groupBy("user_id").agg(F.count("*").alias("before"), F.count_if(F.col("ts") >= F.col("at") - F.expr("interval 20 days")).alias("recent"))
    return last.select("user_id").join(n, "user_id", "left").na.fill(0)
