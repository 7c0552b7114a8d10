"""Queries over sensor rows and trajectories: signals, histograms, alignment, steps, spells, hotspots.

``lineitem`` stands for three-axis sensor rows of a supplier, and points are derived from events by
plain arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalars import epoch_seconds, norm, ratio
from ..operators import aggregates, sessions, trajectory
from ..operators.cleaning import motion_rules, sensor_rules
from ..operators.windows import exact_quantiles, with_average_rank
from .registry import big, query, r6, table

_ROWS = """WITH s AS (SELECT l_suppkey k, l_quantity/50 ax, l_discount*10 ay, l_tax*10 az, l_extendedprice/1000 v, l_returnflag flag, l_shipdate::DATE d FROM lineitem),
r AS (SELECT *, sqrt(ax*ax+ay*ay+az*az) norm FROM s)
"""


def rows(spark, sf_dir):
    src = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), (F.col("l_quantity") / 50).alias("ax"), (F.col("l_discount") * 10).alias("ay"), (F.col("l_tax") * 10).alias("az"), (F.col("l_extendedprice") / 1000).alias("v"), F.col("l_returnflag").alias("flag"), F.to_date("l_shipdate").alias("d"))
    return src.withColumn("norm", norm(F.col("ax"), F.col("ay"), F.col("az")))


@query(_ROWS + """, g AS (SELECT k, count(*) n, avg(norm) mean_norm, stddev_pop(norm) sd, max(norm) mx, count(*) FILTER (abs(norm-1) > 0.3) impact, count(*) FILTER (abs(norm-1) > 0.5) severe, count(*) FILTER (abs(norm-1) > 0.5 AND v >= 40) collision, count(*) FILTER (abs(abs(az)-0.4) > 0.3) tilt, count(*) FILTER (norm > 1.2 AND abs(az) < 0.2) rollover FROM r GROUP BY k)
SELECT k, n, round(mean_norm,6) mean_norm, round(sd,6) sd, round(mx,6) mx, impact, severe, collision, tilt, rollover, round(impact*10000.0::DOUBLE/n,6) impact_10k, round(severe*10000.0::DOUBLE/n,6) severe_10k,
 round((impact + 3*severe + 8*collision + 2*tilt + 6*rollover)*10000.0::DOUBLE/n,6) risk_index FROM g""")
def impact_signals(spark, sf_dir):
    off = F.abs(F.col("norm") - 1)
    g = rows(spark, sf_dir).groupBy("k").agg(
        F.count("*").alias("n"), r6(F.avg("norm")).alias("mean_norm"), r6(F.stddev_pop("norm")).alias("sd"), r6(F.max("norm")).alias("mx"), F.count_if(off > 0.3).alias("impact"), F.count_if(off > 0.5).alias("severe"),
        F.count_if((off > 0.5) & (F.col("v") >= 40)).alias("collision"), F.count_if(F.abs(F.abs("az") - 0.4) > 0.3).alias("tilt"), F.count_if((F.col("norm") > 1.2) & (F.abs("az") < 0.2)).alias("rollover"))
    weights = {"impact": 1, "severe": 3, "collision": 8, "tilt": 2, "rollover": 6}
    index = sum((w * F.col(c) for c, w in weights.items()), F.lit(0))
    rate = lambda c: r6(aggregates.per_10k(c, F.col("n")))
    return g.select("*", rate(F.col("impact")).alias("impact_10k"), rate(F.col("severe")).alias("severe_10k"), rate(index).alias("risk_index"))


def _hist_sql(rule):
    need = {"upper": "greatest(ceil(tot*{q}),1)", "midpoint": "tot*{q}", "midpoint_ceil": "ceil(tot*{q})"}[rule]
    shift = "1" if rule == "upper" else "0.5"
    part = lambda n, q: f"round((min(bin) FILTER (cum >= {need.format(q=q)}) + {shift}) * 1.0::DOUBLE, 6) {n}"
    return _ROWS + f""", h AS (SELECT k, least(greatest(floor(v/1.0),0),119)::INT bin, count(*) n FROM r GROUP BY 1,2), c AS (SELECT *, sum(n) OVER (PARTITION BY k ORDER BY bin) cum, sum(n) OVER (PARTITION BY k) tot FROM h)
SELECT k, max(tot)::BIGINT n, {part('p50', '0.5::DOUBLE')}, {part('p95', '0.95::DOUBLE')}, {part('p99', '0.99::DOUBLE')} FROM c GROUP BY k"""


def _hist(spark, sf_dir, rule):
    h = aggregates.histogram(rows(spark, sf_dir), ["k"], F.col("v"), 0.0, 1.0, 120)
    q = aggregates.histogram_quantiles(h, ["k"], {"p50": 0.5, "p95": 0.95, "p99": 0.99}, 0.0, 1.0, rule)
    return q.select("k", big("n").alias("n"), r6("p50").alias("p50"), r6("p95").alias("p95"), r6("p99").alias("p99"))


@query(_hist_sql("upper"))
def hist_quantile_upper(spark, sf_dir):
    return _hist(spark, sf_dir, "upper")


@query(_hist_sql("midpoint"))
def hist_quantile_mid(spark, sf_dir):
    return _hist(spark, sf_dir, "midpoint")


@query(_hist_sql("midpoint_ceil"))
def hist_quantile_mid_ceil(spark, sf_dir):
    return _hist(spark, sf_dir, "midpoint_ceil")


@query(_ROWS + """, h AS (SELECT k, CASE WHEN v >= 80 THEN 5 WHEN v >= 60 THEN 4 WHEN v >= 40 THEN 3 WHEN v >= 20 THEN 2 WHEN v >= 10 THEN 1 ELSE 0 END b, count(*) n FROM r GROUP BY 1,2),
c AS (SELECT *, sum(CASE WHEN b>0 THEN n ELSE 0 END) OVER (PARTITION BY k ORDER BY b) cum, sum(CASE WHEN b>0 THEN n ELSE 0 END) OVER (PARTITION BY k) ov, sum(n) OVER (PARTITION BY k) tot FROM h)
SELECT k, [10.0,20,40,60,80][min(b) FILTER (b>0 AND cum >= ov*0.95::DOUBLE)]::DOUBLE q, round(max(ov)/max(tot)::DOUBLE,6) share_over FROM c GROUP BY k""")
def edge_histogram(spark, sf_dir):
    return aggregates.edge_quantile(rows(spark, sf_dir), ["k"], F.col("v"), [10.0, 20.0, 40.0, 60.0, 80.0], 0.95).withColumn("share_over", r6("share_over"))


@query(_ROWS + """SELECT coalesce(flag,'__global__') flag, count(*) n, round(quantile_cont(v,0.9),4) p90, round(quantile_cont(v,0.95),4) p95 FROM r GROUP BY GROUPING SETS ((flag),())""")
def fleet_reference(spark, sf_dir):
    """Quantiles of each flag and of all rows, from counts by value."""
    r, q = rows(spark, sf_dir), {"p90": 0.9, "p95": 0.95}
    both = exact_quantiles(r, "v", q, "flag").unionByName(exact_quantiles(r, "v", q).withColumn("flag", F.lit("__global__")))
    return both.select("flag", "n", F.round("p90", 4).alias("p90"), F.round("p95", 4).alias("p95"))


@query(_ROWS + """, q AS (SELECT flag, least(greatest(quantile_cont(norm,0.99),0.8),1.3) hi FROM r GROUP BY 1), u AS (SELECT max(hi) a, min(hi) b, avg(hi) c FROM q)
SELECT flag, round(CASE WHEN (a-b)/abs(c) < 0.10 THEN c ELSE hi END,6) threshold, CASE WHEN (a-b)/abs(c) < 0.10 THEN 1 ELSE 0 END unified FROM q, u""")
def calibrated_thresholds(spark, sf_dir):
    q = exact_quantiles(rows(spark, sf_dir), "norm", {"q": 0.99}, "flag").select("flag", F.least(F.greatest("q", F.lit(0.8)), F.lit(1.3)).alias("hi"))
    u = q.agg(F.max("hi").alias("a"), F.min("hi").alias("b"), F.avg("hi").alias("c"))
    one = ratio(F.col("a") - F.col("b"), F.abs("c")) < 0.10
    return q.join(F.broadcast(u)).select("flag", r6(F.when(one, F.col("c")).otherwise(F.col("hi"))).alias("threshold"), one.cast("int").alias("unified"))  # u: one row


@query(_ROWS + """, f AS (SELECT quantile_cont(v,0.9) p90, quantile_cont(v,0.95) p95 FROM r)
SELECT k, CASE WHEN count(*) >= 500 THEN round(stddev_pop(v),6) END sd, CASE WHEN count(*) >= 500 THEN round(stddev_pop(v)/avg(v),6) END cv, CASE WHEN count(*) >= 500 THEN round(quantile_cont(v,0.75)-quantile_cont(v,0.25),4) END iqr, round(avg(CASE WHEN v > p90 THEN 1.0 ELSE 0 END)::DOUBLE,6) over_p90, round(avg(CASE WHEN v > p95 THEN 1.0 ELSE 0 END)::DOUBLE,6) over_p95, round(median(norm),6) median_norm FROM r, f GROUP BY k""")
def volatility(spark, sf_dir):
    r = rows(spark, sf_dir)
    f = exact_quantiles(r, "v", {"p90": 0.9, "p95": 0.95}).drop("n")
    q = F.percentile("v", F.array(F.lit(0.25), F.lit(0.75)))
    enough = lambda c: r6(F.when(F.count("*") >= 500, c))
    return r.join(F.broadcast(f)).groupBy("k").agg(enough(F.stddev_pop("v")).alias("sd"), enough(ratio(F.stddev_pop("v"), F.avg("v"))).alias("cv"), F.round(F.when(F.count("*") >= 500, q[1] - q[0]), 4).alias("iqr"),
                                                   r6(F.avg((F.col("v") > F.col("p90")).cast("double"))).alias("over_p90"), r6(F.avg((F.col("v") > F.col("p95")).cast("double"))).alias("over_p95"), r6(F.percentile("norm", 0.5)).alias("median_norm"))  # f: one row


@query(_ROWS + """, o AS (SELECT *, lag(d) OVER w pd, lag(ax) OVER w pax, lag(ay) OVER w pay, lag(az) OVER w paz FROM r WINDOW w AS (PARTITION BY k ORDER BY d, ax, ay, az, v))
SELECT k, count(*) n, count(*) FILTER (ax=pax AND ay=pay AND az=paz AND d-pd BETWEEN 0 AND 2) dups, count(*) - count(*) FILTER (ax=pax AND ay=pay AND az=paz AND d-pd BETWEEN 0 AND 2) denominator, count(*) FILTER (pd IS NULL OR d-pd > 10) segments, CASE WHEN count(pd) >= 100 THEN round(count(*) FILTER (ax=pax AND ay=pay AND az=paz AND d-pd BETWEEN 0 AND 2)/count(pd)::DOUBLE,6) END dup_rate, round(avg(CASE WHEN ax >= 1 THEN 1.0 ELSE 0 END)::DOUBLE,6) saturated FROM o GROUP BY k""")
def device_quality(spark, sf_dir):
    w = Window.partitionBy("k").orderBy("d", "ax", "ay", "az", "v")
    o = rows(spark, sf_dir).withColumn("gap", F.date_diff("d", F.lag("d").over(w))).withColumn("same", (F.col("ax") == F.lag("ax").over(w)) & (F.col("ay") == F.lag("ay").over(w)) & (F.col("az") == F.lag("az").over(w)))
    dup = F.count_if(F.col("same") & F.col("gap").between(0, 2))
    return o.groupBy("k").agg(F.count("*").alias("n"), dup.alias("dups"), (F.count("*") - dup).alias("denominator"), F.count_if(F.col("gap").isNull() | (F.col("gap") > 10)).alias("segments"),
                              r6(F.when(F.count("gap") >= 100, ratio(dup, F.count("gap")))).alias("dup_rate"), r6(F.avg((F.col("ax") >= 1).cast("double"))).alias("saturated"))


@query(_ROWS + """, g AS (SELECT k, count(*) n, avg(ax) mx, avg(ay) my, avg(az) mz, avg(ax*ax)-avg(ax)*avg(ax) sxx, avg(ay*ay)-avg(ay)*avg(ay) syy, avg(ax*ay)-avg(ax)*avg(ay) sxy FROM r GROUP BY k),
e AS (SELECT *, (sxx+syy)/2 + sqrt(greatest((sxx-syy)*(sxx-syy)/4 + sxy*sxy,0)) l1, (sxx+syy)/2 - sqrt(greatest((sxx-syy)*(sxx-syy)/4 + sxy*sxy,0)) l2 FROM g)
SELECT k, n, round(sqrt(mx*mx+my*my+mz*mz),5) gravity, round(l1,5) l1, round(l2,5) l2, CASE WHEN n >= 500 AND l1/nullif(l2,0) >= 1.3 THEN 1 ELSE 0 END aligned, round(0.5*atan2(2*sxy, sxx-syy),4) heading FROM e""")
def alignment(spark, sf_dir):
    """Mean axis, and the principal axes of the horizontal plane by the closed form of a 2 x 2 matrix."""
    r = rows(spark, sf_dir)
    cov = lambda a, b: F.avg(F.col(a) * F.col(b)) - F.avg(a) * F.avg(b)
    g = r.groupBy("k").agg(F.count("*").alias("n"), norm(F.avg("ax"), F.avg("ay"), F.avg("az")).alias("g"), cov("ax", "ax").alias("xx"), cov("ay", "ay").alias("yy"), cov("ax", "ay").alias("xy"))
    x, y, c = F.col("xx"), F.col("yy"), F.col("xy")
    root = F.sqrt(F.greatest((x - y) * (x - y) / 4 + c * c, F.lit(0.0)))
    l1, l2 = (x + y) / 2 + root, (x + y) / 2 - root
    ok = (F.col("n") >= 500) & (ratio(l1, l2) >= 1.3)
    return g.select("k", "n", F.round("g", 5).alias("gravity"), F.round(l1, 5).alias("l1"), F.round(l2, 5).alias("l2"), F.coalesce(ok.cast("int"), F.lit(0)).alias("aligned"), F.round(0.5 * F.atan2(2 * c, x - y), 4).alias("heading"))


@query(_ROWS + """SELECT flag, scenario, count(*) n, round(avg(value),5) mean_value FROM (
 SELECT flag, 'accel' scenario, ax value FROM r WHERE v >= 10 AND ax > 0.9 UNION ALL SELECT flag, 'brake', ax FROM r WHERE v >= 10 AND ax < 0.1
 UNION ALL SELECT flag, 'turn', ay FROM r WHERE v >= 10 AND abs(az) > 0.5 AND abs(ay) > 0.5 AND ay*az > 0 UNION ALL SELECT flag, 'sway', ay FROM r WHERE v >= 10 AND abs(az) > 0.5 AND abs(ay) > 0.5 AND ay*az < 0
 UNION ALL SELECT flag, 'collision', sqrt(ax*ax+ay*ay) FROM r WHERE sqrt(ax*ax+ay*ay) > 1.2 UNION ALL SELECT flag, 'rollover', az FROM r WHERE abs(az) < 0.05) GROUP BY 1,2""")
def driving_scenarios(spark, sf_dir):
    t = {"accel": 0.9, "brake": 0.1, "gyro": 0.5, "lateral": 0.5, "collision": 1.2, "rollover": 0.05}
    s = sessions.driving_scenarios(rows(spark, sf_dir), F.col("ax"), F.col("ay"), F.col("az"), F.col("az"), F.col("v"), t, ["flag"])
    return s.groupBy("flag", "scenario").agg(F.count("*").alias("n"), F.round(F.avg("value"), 5).alias("mean_value"))


@query("""
SELECT l_shipmode_flag flag, count(*) n FROM (SELECT concat_ws(';', CASE WHEN l_quantity < 5 OR l_quantity >= 48 THEN 'heading' END, CASE WHEN l_extendedprice > 5000 AND l_tax = 0 THEN 'run_contradiction' END, CASE WHEN l_discount*10 < 0.1 OR l_discount*10 > 0.9 THEN 'norm' END) l_shipmode_flag FROM lineitem) GROUP BY 1""")
def row_flags(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    heading = F.when(F.col("l_quantity") < 5, -1).when(F.col("l_quantity") >= 48, 360).otherwise(10)
    a = motion_rules(heading, F.when(F.col("l_extendedprice") > 5000, 10).otherwise(0), F.col("l_tax"))
    size = F.when(F.col("l_discount") * 10 < 0.1, 0.0).when(F.col("l_discount") * 10 > 0.9, 6.0).otherwise(1.0)
    b = sensor_rules(size, F.col("l_shipdate"), F.to_date("l_shipdate"))
    both = F.concat_ws(";", F.nullif(a, F.lit("")), F.nullif(b, F.lit("")))
    return l.select(both.alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


# ---- trajectories

_STEPS = """WITH p AS (SELECT event_id, user_id, epoch(date_trunc('second', ts))::BIGINT s, 30 + (event_id % 1000)/1000.0::DOUBLE lat, 114 + value/1000.0::DOUBLE lon, CASE WHEN event_id % 5 = 0 THEN 0.0 ELSE value END speed FROM events),
l AS (SELECT *, s - lag(s) OVER w dt, lag(s) OVER w bs, lag(lat) OVER w pla, lag(lon) OVER w plo FROM p WINDOW w AS (PARTITION BY user_id ORDER BY s, event_id)),
m AS (SELECT *, 2*6371000.0::DOUBLE*asin(sqrt(least(pow(sin(radians(lat-pla)/2),2) + cos(radians(pla))*cos(radians(lat))*pow(sin(radians(lon-plo)/2),2), 1))) metres FROM l),
t AS (SELECT *, coalesce(metres > 70.0*dt, false) jump FROM m),
st AS (SELECT *, coalesce((speed = 0 OR metres < 50) AND NOT jump AND dt IS NOT NULL, false) stationary FROM t)
"""


def points(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "user_id", epoch_seconds(F.col("ts")).alias("s"), (30 + (F.col("event_id") % 1000) / 1000).alias("lat"), (114 + F.col("value") / 1000).alias("lon"), F.when(F.col("event_id") % 5 == 0, 0.0).otherwise(F.col("value")).alias("speed"))


def stepped(spark, sf_dir):
    return trajectory.steps(points(spark, sf_dir), "user_id", "s", "lat", "lon", "speed", "event_id")


@query(_STEPS + """SELECT user_id, count(*) points, count(*) FILTER (jump) jumps, count(*) FILTER (stationary) still, round(sum(metres) FILTER (dt > 0 AND dt <= 10800 AND NOT jump)/1000,4) km, round(sum(dt) FILTER (dt > 0 AND dt <= 10800 AND NOT jump)/3600.0::DOUBLE,6) AS hours FROM st GROUP BY 1""")
def step_geometry(spark, sf_dir):
    ok = trajectory.valid_step()
    return stepped(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("points"), F.count_if("jump").alias("jumps"), F.count_if("stationary").alias("still"), F.round(F.sum(F.when(ok, F.col("metres"))) / 1000, 4).alias("km"), r6(F.sum(F.when(ok, F.col("dt"))) / 3600).alias("hours"))


@query(_STEPS + """, a0 AS (SELECT *, lag(stationary) OVER w was FROM st WINDOW w AS (PARTITION BY user_id ORDER BY s, event_id)),
a AS (SELECT *, sum(CASE WHEN dt IS NULL OR dt > 10800 OR jump OR stationary <> was THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS UNBOUNDED PRECEDING) run FROM a0),
b AS (SELECT *, stationary AND max(s) OVER (PARTITION BY user_id, run) - min(CASE WHEN stationary THEN bs END) OVER (PARTITION BY user_id, run) >= 1800 stop FROM a),
c AS (SELECT *, CASE WHEN dt IS NULL OR dt > 10800 OR jump OR stop OR lag(stop) OVER (PARTITION BY user_id ORDER BY s, event_id) THEN 1 ELSE 0 END cut FROM b),
d AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS UNBOUNDED PRECEDING) spell FROM c),
g AS (SELECT user_id, spell, min(s) a, max(s) b FROM d WHERE NOT stop GROUP BY 1,2),
n AS (SELECT user_id, spell, a, b, sum(greatest(0, least(b, (x+1)*86400+18000) - greatest(a, x*86400+82800))) night FROM g, unnest(generate_series(floor(a/86400)::BIGINT - 1, floor(b/86400)::BIGINT)) z(x) GROUP BY 1,2,3,4)
SELECT user_id, count(*) spells, round(max((b-a)/3600.0::DOUBLE),6) longest_h, round(avg(CASE WHEN (b-a)/3600.0 > 4 THEN 1.0 ELSE 0 END)::DOUBLE,6) share_over_4h, round(sum(night)/3600.0::DOUBLE,6) night_h FROM n GROUP BY 1""")
def spells(spark, sf_dir):
    f = trajectory.spell_features(trajectory.spells(stepped(spark, sf_dir), "user_id", "s", "event_id"), "user_id")
    return f.select("user_id", "spells", *(r6(c).alias(c) for c in ("longest_h", "share_over_4h", "night_h")))


@query(_STEPS + """, d AS (SELECT user_id, floor(bs/86400)::BIGINT AS day, sum(metres)/1000 km, sum(dt)/3600.0::DOUBLE h FROM st WHERE dt > 0 AND dt <= 10800 AND NOT jump GROUP BY 1,2)
SELECT user_id, count(*) active_days, (max(day)-min(day)+1-count(*))::BIGINT missing_days, round(avg(h),5) mean_h, CASE WHEN count(*) >= 5 THEN round(stddev_pop(km)/nullif(avg(km),0),5) END km_cv FROM d GROUP BY 1""")
def daily_rhythm(spark, sf_dir):
    d = stepped(spark, sf_dir).filter(trajectory.valid_step()).groupBy("user_id", F.floor(F.col("before_s") / 86400).alias("day")).agg((F.sum("metres") / 1000).alias("km"), (F.sum("dt") / 3600).alias("h"))
    return d.groupBy("user_id").agg(F.count("*").alias("active_days"), big(F.max("day") - F.min("day") + 1 - F.count("*")).alias("missing_days"), F.round(F.avg("h"), 5).alias("mean_h"), F.round(F.when(F.count("*") >= 5, ratio(F.stddev_pop("km"), F.avg("km"))), 5).alias("km_cv"))


@query("""
WITH p AS (SELECT user_id, hour(ts) h, 30 + (event_id % 1000)/1000.0::DOUBLE lat, 114 + value/1000.0::DOUBLE lon FROM events), c AS (SELECT user_id, avg(lat) a, avg(lon) o, count(*) n, avg(lat) FILTER (NOT(h>=23 OR h<5)) da, avg(lon) FILTER (NOT(h>=23 OR h<5)) dl, avg(lat) FILTER (h>=23 OR h<5) na, avg(lon) FILTER (h>=23 OR h<5) nl FROM p GROUP BY 1),
d AS (SELECT p.user_id, n, pow(2*6371000.0::DOUBLE*asin(sqrt(least(pow(sin(radians(a-lat)/2),2)+cos(radians(lat))*cos(radians(a))*pow(sin(radians(o-lon)/2),2),1))),2) m2 FROM p JOIN c USING (user_id)),
r AS (SELECT user_id, max(n) points, sqrt(avg(m2)) radius FROM d GROUP BY 1)
SELECT user_id, points, round(radius,3) radius_m, round(2*6371000.0::DOUBLE*asin(sqrt(least(pow(sin(radians(na-da)/2),2)+cos(radians(da))*cos(radians(na))*pow(sin(radians(nl-dl)/2),2),1))),3) shift_m FROM r JOIN c USING (user_id)""")
def spatial_spread(spark, sf_dir):
    p = points(spark, sf_dir).withColumn("h", F.floor(F.pmod(F.col("s"), F.lit(86400)) / 3600))
    a = trajectory.activity_radius(p, "user_id", "lat", "lon")
    b = trajectory.centroid_shift(p, "user_id", "lat", "lon", (F.col("h") >= 23) | (F.col("h") < 5))
    return a.join(b, "user_id").select("user_id", "points", F.round("radius_m", 3).alias("radius_m"), F.round("shift_m", 3).alias("shift_m"))


@query("""
WITH p AS (SELECT event_id, user_id, floor(epoch(ts)/86400)::BIGINT AS day, 30 + (event_id % 1000)/1000.0::DOUBLE lat, 114 + value/1000.0::DOUBLE lon FROM events),
j AS (SELECT a.user_id, a.day, a.event_id i, b.event_id i2, 2*6371000.0::DOUBLE*asin(sqrt(least(pow(sin(radians(b.lat-a.lat)/2),2)+cos(radians(a.lat))*cos(radians(b.lat))*pow(sin(radians(b.lon-a.lon)/2),2),1))) m FROM p a JOIN p b ON a.user_id=b.user_id AND b.day=a.day+1),
x AS (SELECT user_id, min(m) m FROM j GROUP BY user_id, day, i UNION ALL SELECT user_id, min(m) FROM j GROUP BY user_id, day, i2)
SELECT user_id, round(avg(m),3) repeat_m FROM x GROUP BY 1""")
def nearest_day_distance(spark, sf_dir):
    p = points(spark, sf_dir).withColumn("day", F.floor(F.col("s") / 86400))
    return trajectory.route_repeat(p, "user_id", "day", "event_id", "lat", "lon").withColumn("repeat_m", F.round("repeat_m", 3))


@query("""
WITH RECURSIVE p AS (SELECT event_id, user_id, 30 + (event_id % 1000)/1000.0::DOUBLE lat, 114 + value/1000.0::DOUBLE lon FROM events),
e AS (SELECT a.user_id, a.event_id u, b.event_id v FROM p a JOIN p b ON a.user_id=b.user_id AND a.event_id<>b.event_id WHERE 2*6371000.0::DOUBLE*asin(sqrt(least(pow(sin(radians(b.lat-a.lat)/2),2)+cos(radians(a.lat))*cos(radians(b.lat))*pow(sin(radians(b.lon-a.lon)/2),2),1))) <= 200),
r AS (SELECT user_id, u, u AS label FROM e UNION SELECT e.user_id, e.v, r.label FROM r JOIN e ON r.u = e.u AND r.user_id = e.user_id),
m AS (SELECT user_id, u, min(label) c FROM r GROUP BY 1,2)
SELECT user_id, count(DISTINCT c) hotspots, count(*) clustered, count(*) - count(DISTINCT c) recurrences FROM m GROUP BY 1""")
def hotspots(spark, sf_dir):
    h = trajectory.hotspots(points(spark, sf_dir), "user_id", "event_id", "lat", "lon")
    return h.groupBy("user_id").agg(F.count_distinct("cluster").alias("hotspots"), F.count("*").alias("clustered"), (F.count("*") - F.count_distinct("cluster")).alias("recurrences"))


@query("""
SELECT user_id, CASE WHEN hour(ts) >= 23 OR hour(ts) < 5 THEN 'night' WHEN hour(ts) >= 9 AND hour(ts) < 17 THEN 'day' WHEN hour(ts) >= 7 AND hour(ts) < 9 THEN 'am_peak' ELSE 'other' END band, count(*) n, round(quantile_cont(value,0.5),6) p50, round(quantile_cont(value,0.9),6) p90, round(quantile_cont(value,0.99),6) p99, round(stddev_pop(value)/avg(value),6) cv, round(avg(CASE WHEN value > 90 THEN 1.0 ELSE 0 END)::DOUBLE,6) over_90 FROM events GROUP BY 1,2""")
def speed_shape(spark, sf_dir):
    from ..functions.scalars import time_band

    e = table(spark, sf_dir, "events").withColumn("band", time_band(F.col("ts"), "research"))
    g = e.groupBy("user_id", "band").agg(F.count("*").alias("n"), F.percentile("value", F.array(F.lit(0.5), F.lit(0.9), F.lit(0.99))).alias("q"), r6(ratio(F.stddev_pop("value"), F.avg("value"))).alias("cv"), r6(F.avg((F.col("value") > 90).cast("double"))).alias("over_90"))
    return g.select("user_id", "band", "n", *(r6(F.col("q")[i]).alias(n) for i, n in enumerate(("p50", "p90", "p99"))), "cv", "over_90")


@query("""
WITH b AS (SELECT p_partkey, p_retailprice v, p_size FROM part) SELECT p_partkey, round(rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1)/2.0::DOUBLE,1) avg_rank, round(rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1)/2.0::DOUBLE + rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1)/2.0::DOUBLE,1) rank_sum FROM b""")
def rank_fusion(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    r = with_average_rank(p.select("p_partkey", "p_retailprice", "p_size"), {"a": "p_retailprice", "b": "p_size"})
    return r.select("p_partkey", F.round("a", 1).alias("avg_rank"), F.round(F.col("a") + F.col("b"), 1).alias("rank_sum"))


@query("""
WITH e AS (SELECT user_id, ts::DATE AS "day", epoch(date_trunc('second', ts))::BIGINT s FROM events), g AS (SELECT *, s - lag(s) OVER (PARTITION BY user_id, "day" ORDER BY s) gap FROM e)
SELECT user_id, "day", count(*) "rows", coalesce(sum(gap) FILTER (gap < 7200), 0)::BIGINT observed_s, (min(s) % 86400)::BIGINT first_s, (max(s) % 86400)::BIGINT last_s FROM g GROUP BY 1, 2""")
def sensor_days(spark, sf_dir):
    """Rows, observed seconds and first and last second of each user's days."""
    return trajectory.sensor_days(table(spark, sf_dir, "events"), "user_id", "ts", 7200)
