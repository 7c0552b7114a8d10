"""Queries over cleaning rules, checks between streams, sensor axes, contracts, reviews and fused views.

``events`` stands for three streams of a user: views for trajectory points, clicks for sensor rows, errors for events.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import epoch_seconds
from ..operators import bootstrap, cleaning, contract, cross_checks, evaluation, models, replay, sensing
from ..operators.windows import exact_quantiles
from ..sources import files
from ..sources.shared import path as shared_path
from .evaluation import _AUC, _D, scored
from .registry import query, r6, table
from .sensors import _ROWS, rows

_FAULTY = """WITH e AS (SELECT user_id, ts, event_type, CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 13 = 0 THEN -value ELSE value END speed,
 CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 19 = 0 THEN 0.0 WHEN event_id % 23 = 0 THEN 95.0 ELSE 30 + (event_id % 1000)/1000.0::DOUBLE END lat, CASE WHEN event_id % 19 = 0 THEN 0.0 ELSE 114 + value/1000.0::DOUBLE END lon FROM events),
d AS (SELECT * FROM e UNION ALL SELECT * FROM e WHERE event_type = 'click'),
f AS (SELECT *, CASE WHEN lat IS NULL OR lon IS NULL THEN 'missing' WHEN lat = 0 AND lon = 0 THEN 'zero_placeholder' WHEN abs(lat) > 90 OR abs(lon) > 180 THEN 'out_of_range' END coord_flag, CASE WHEN speed IS NULL THEN 'missing' WHEN speed < 0 THEN 'negative_invalid' WHEN speed > 200 THEN 'impossible_gt200' WHEN speed >= 160 THEN 'suspicious_gt160' END speed_flag FROM d)
"""


def faulty(spark, sf_dir):
    i, v = F.col("event_id"), F.col("value")
    e = table(spark, sf_dir, "events").select(
        "user_id", "ts", "event_type", F.when(i % 11 == 0, F.lit(None)).when(i % 13 == 0, -v).otherwise(v).alias("speed"),
        F.when(i % 17 == 0, F.lit(None)).when(i % 19 == 0, 0.0).when(i % 23 == 0, 95.0).otherwise(30 + (i % 1000) / 1000).alias("lat"), F.when(i % 19 == 0, 0.0).otherwise(114 + v / 1000).alias("lon"))
    return e.unionAll(e.filter("event_type = 'click'"))


@query(_FAULTY + """, k AS (SELECT DISTINCT * FROM f WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-21'),
m AS (SELECT user_id, quantile_cont(CASE WHEN coord_flag IS NULL THEN lat END, 0.5) mlat, quantile_cont(CASE WHEN coord_flag IS NULL THEN lon END, 0.5) mlon FROM k GROUP BY 1),
c AS (SELECT k.*, CASE WHEN coord_flag IS NULL THEN lat WHEN coord_flag <> 'missing' THEN mlat END clat, CASE WHEN coord_flag IS NULL THEN lon WHEN coord_flag <> 'missing' THEN mlon END clon, CASE WHEN speed_flag IS NULL OR speed_flag = 'suspicious_gt160' THEN speed END cspeed FROM k JOIN m USING (user_id)),
q AS (SELECT CASE WHEN ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-21' THEN 'exact_duplicate' ELSE 'out_of_window' END reason, count(*) - CASE WHEN ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-21' THEN 1 ELSE 0 END n FROM f GROUP BY user_id, ts, event_type, speed, lat, lon)
SELECT 'kept' fate, coord_flag, speed_flag, count(*) n, round(avg(clat),6) lat, round(avg(clon),6) lon, round(avg(cspeed),6) speed FROM c GROUP BY 2,3 UNION ALL SELECT reason, NULL, NULL, sum(n)::BIGINT, NULL, NULL, NULL FROM q WHERE n > 0 GROUP BY 1""")
def event_cleaning(spark, sf_dir):
    kept, out = cleaning.clean_events(faulty(spark, sf_dir), "ts", "2024-01-01", "2024-01-21", "lat", "lon", "speed", "user_id")
    a = kept.groupBy("coord_flag", "speed_flag").agg(F.count("*").alias("n"), *(r6(F.avg(c)).alias(c) for c in ("lat", "lon", "speed"))).withColumn("fate", F.lit("kept"))
    return a.unionByName(out.groupBy(F.col("reason").alias("fate")).agg(F.count("*").alias("n")), allowMissingColumns=True)


@query(_FAULTY + """SELECT coord_flag, speed_flag, CASE WHEN speed IS NULL THEN 'missing' WHEN speed*4 < 0 OR speed*4 >= 360 THEN 'out_of_range' END course_flag, CASE WHEN speed BETWEEN 5.0000001 AND 200 AND event_type = 'view' THEN 'runtime_inconsistent_moving' END runtime_flag, CASE WHEN ts::DATE >= DATE '2024-01-01' AND ts::DATE < DATE '2024-01-21' THEN 1 ELSE 0 END window_flag, count(*) n FROM f GROUP BY 1,2,3,4,5""")
def trajectory_cleaning(spark, sf_dir):
    t = faulty(spark, sf_dir).withColumns({"day": F.to_date("ts"), "course": F.col("speed") * 4, "run_time": F.when(F.col("event_type") == "view", 0).otherwise(60)})
    t = cleaning.clean_trajectory(t, "day", "2024-01-01", "2024-01-21", "lat", "lon", "speed", "course", "run_time")
    return t.groupBy("coord_flag", "speed_flag", "course_flag", "runtime_flag", "window_flag").agg(F.count("*").alias("n"))


@query(_FAULTY + """SELECT CASE WHEN speed IS NULL THEN 'missing' END ems_flag, CASE WHEN lat IS NULL THEN 'missing' END gps_flag, CASE WHEN abs(speed)/50 < 0.1 OR abs(speed)/50 > 5 THEN 'accel_extreme' END accel_flag, CASE WHEN event_type = 'error' THEN 'date_mismatch' END date_flag, CASE WHEN ts::DATE + (event_type = 'error')::INT >= DATE '2024-01-01' AND ts::DATE + (event_type = 'error')::INT < DATE '2024-01-21' THEN 1 ELSE 0 END window_flag, count(*) n FROM f GROUP BY 1,2,3,4,5""")
def sensor_cleaning(spark, sf_dir):
    t = faulty(spark, sf_dir).withColumn("day", F.date_add(F.to_date("ts"), (F.col("event_type") == "error").cast("int")))
    t = cleaning.clean_sensors(t, "ts", "day", "2024-01-01", "2024-01-21", "speed", "lat", F.abs("speed") / 50)
    return t.groupBy("ems_flag", "gps_flag", "accel_flag", "date_flag", "window_flag").agg(F.count("*").alias("n"))


# ---- one stream against another

_STREAMS = """WITH e AS (SELECT event_id, user_id, event_type, epoch(date_trunc('second', ts))::BIGINT s, value v, ts::DATE AS day, 30 + (event_id % 1000)/1000.0::DOUBLE lat FROM events),
t AS (SELECT * FROM e WHERE event_type = 'view'), i AS (SELECT * FROM e WHERE event_type = 'click'), x AS (SELECT * FROM e WHERE event_type = 'error')
"""


def streams(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", epoch_seconds(F.col("ts")).alias("s"), F.col("value").alias("v"), F.to_date("ts").alias("day"), (30 + (F.col("event_id") % 1000) / 1000).alias("lat"))
    return (e.filter(F.col("event_type") == kind) for kind in ("view", "click", "error"))


@query(_STREAMS + """SELECT i.event_id, round(max(t.v),6) fastest FROM i JOIN t ON i.user_id = t.user_id AND abs(i.s - t.s) <= 14400 WHERE i.v > 20 GROUP BY 1 HAVING max(t.v) < 40""")
def speed_conflicts(spark, sf_dir):
    t, i, _ = streams(spark, sf_dir)
    return cross_checks.persistent_conflicts(i, t, "user_id", "s", "v", "v", still=40, within_s=14400).select("event_id", r6("fastest").alias("fastest"))


@query(_STREAMS + """, n AS (SELECT i.event_id, i.user_id, i.s, i.v, t.v tv, row_number() OVER (PARTITION BY i.event_id ORDER BY abs(i.s - t.s), t.s, t.v) rn FROM i LEFT JOIN t ON i.user_id = t.user_id AND abs(i.s - t.s) <= 172800),
f AS (SELECT *, coalesce(abs(v - tv) > 30, false) off FROM n WHERE rn = 1), b AS (SELECT *, CASE WHEN off = lag(off) OVER (PARTITION BY user_id ORDER BY s, event_id) THEN 0 ELSE 1 END b FROM f),
r AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS UNBOUNDED PRECEDING) run FROM b)
SELECT user_id, min(s) start_s, max(s) end_s, count(*) "rows" FROM r WHERE off GROUP BY user_id, run HAVING max(s) - min(s) >= 3600""")
def speed_differences(spark, sf_dir):
    t, i, _ = streams(spark, sf_dir)
    return cross_checks.lasting_differences(i, t, "user_id", "s", "v", "v", "event_id", least_s=3600, within_s=172800)


@query(_STREAMS + """, a AS (SELECT user_id, s // 172800 "window", count(*) "rows" FROM i GROUP BY 1,2 HAVING count(*) >= 2 AND var_pop(v) <= 400 AND var_pop(lat) <= 0.05), b AS (SELECT user_id, s // 172800 "window", min(v) slowest FROM t GROUP BY 1,2 HAVING min(v) >= 20)
SELECT user_id, "window", "rows", round(slowest,6) slowest FROM a JOIN b USING (user_id, "window")""")
def dead_sensor_windows(spark, sf_dir):
    """Both signals are scaled so that one tolerance serves them."""
    t, i, _ = streams(spark, sf_dir)
    i = i.withColumns({"v": F.col("v") / 20, "turn": F.col("lat") / 0.05 ** 0.5})
    return cross_checks.dead_windows(i, t, "user_id", "s", "v", "turn", "v", window_s=172800, eps=1.0).withColumn("slowest", r6("slowest"))


@query(_STREAMS + """, b AS (SELECT user_id, min(lat) la, max(lat) lb, min(v) va, max(v) vb FROM t GROUP BY 1), n AS (SELECT event_id FROM x WHERE EXISTS (SELECT 1 FROM t WHERE t.user_id = x.user_id AND abs(t.s - x.s) <= 86400))
SELECT event_id, CASE WHEN event_id NOT IN (SELECT event_id FROM n) THEN 'no_point' WHEN NOT (lat BETWEEN la AND lb AND v BETWEEN va AND vb) THEN 'outside_box' END xtype_coord_flag FROM x LEFT JOIN b USING (user_id)""")
def coordinate_conflicts(spark, sf_dir):
    t, _, x = streams(spark, sf_dir)
    return cross_checks.coordinate_conflicts(x, t, "user_id", "s", "lat", "v", 86400).select("event_id", "xtype_coord_flag")


@query(_STREAMS + """, n AS (SELECT x.event_id, x.v, t.v tv, t.event_id % 3 dist, row_number() OVER (PARTITION BY x.event_id ORDER BY abs(x.s - t.s), t.s, t.v, t.event_id % 3) rn FROM x LEFT JOIN t ON x.user_id = t.user_id AND abs(x.s - t.s) <= 86400)
SELECT event_id, CASE WHEN v >= 50 AND tv < 30 AND dist = 0 THEN 'driving_event_at_rest' WHEN v < 50 AND tv > 60 THEN 'parking_event_moving' END xtype_motion_flag FROM n WHERE rn = 1""")
def motion_conflicts(spark, sf_dir):
    t, _, x = streams(spark, sf_dir)
    t = t.select("user_id", "s", F.col("v").alias("speed"), (F.col("event_id") % 3).alias("distance"))
    return cross_checks.motion_conflicts(x, t, "user_id", "s", F.col("v") >= 50, F.col("v") < 50, "speed", "distance", 86400, still=30, moving=60).select("event_id", "xtype_motion_flag")


@query(_STREAMS + "SELECT DISTINCT user_id, t.day FROM t WHERE v > 0 AND NOT EXISTS (SELECT 1 FROM i WHERE i.user_id = t.user_id AND i.day = t.day)")
def uncovered_days(spark, sf_dir):
    t, i, _ = streams(spark, sf_dir)
    return cross_checks.uncovered_days(t, i, "user_id", F.col("day"), "v")


# ---- sensor axes

_MEANS = ", ".join(f"sum({c}) FILTER (v >= 20) s{c[1]}" for c in ("ax", "ay", "az")) + ", " + ", ".join(f"sum({a}*{b}) FILTER (v >= 20) s{a[1]}{b[1]}" for a, b in (("ax", "ax"), ("ax", "ay"), ("ax", "az"), ("ay", "ay"), ("ay", "az"), ("az", "az")))


def _plane(a: str, b: str, t: str) -> str:
    """SQL of a' C b for the covariance C of the sums of ``t``."""
    c = lambda i, j: f"({t}.s{min(i, j)}{max(i, j)}/{t}.nd - {t}.s{i}/{t}.nd*{t}.s{j}/{t}.nd)"
    return "(" + " + ".join(f"{a}{i}*{c(i, j)}*{b}{j}" for i in "xyz" for j in "xyz") + ")"


_AXES = _ROWS + f""", y AS (SELECT k, year(d) yr, count(*) n, count(*) FILTER (v >= 20) nd, {_MEANS} FROM r GROUP BY 1,2), a AS (SELECT k, count(*) n, count(*) FILTER (v >= 20) nd, sum(ax) ax, sum(ay) ay, sum(az) az, {_MEANS} FROM r GROUP BY 1),
g AS (SELECT *, sqrt(ax*ax+ay*ay+az*az) size FROM a), g1 AS (SELECT *, size/n gn, ax/size gx, ay/size gy, az/size gz FROM g),
g2 AS (SELECT *, CASE WHEN abs(gx) >= 0.9 THEN gz ELSE 0 END cx, CASE WHEN abs(gx) >= 0.9 THEN 0 ELSE -gz END cy, CASE WHEN abs(gx) >= 0.9 THEN -gx ELSE gy END cz FROM g1),
g3 AS (SELECT *, cx/sqrt(cx*cx+cy*cy+cz*cz) ex, cy/sqrt(cx*cx+cy*cy+cz*cz) ey, cz/sqrt(cx*cx+cy*cy+cz*cz) ez FROM g2), g4 AS (SELECT *, gy*ez-gz*ey fx, gz*ex-gx*ez fy, gx*ey-gy*ex fz FROM g3),
p AS (SELECT *, {_plane('e', 'e', 'g4')} xx, {_plane('f', 'f', 'g4')} yy, {_plane('e', 'f', 'g4')} xy FROM g4),
o AS (SELECT *, 0.5*atan2(2*xy, xx-yy) th, ((xx+yy)/2 + sqrt((xx-yy)*(xx-yy)/4+xy*xy))/greatest((xx+yy)/2 - sqrt((xx-yy)*(xx-yy)/4+xy*xy), 1e-12) vr FROM p),
z AS (SELECT o.k, avg(abs(cos(0.5*atan2(2*{_plane('e', 'f', 'y')}, {_plane('e', 'e', 'y')}-{_plane('f', 'f', 'y')}) - th))) dc FROM y JOIN o ON o.k = y.k WHERE y.nd >= 40 GROUP BY 1),
w AS (SELECT o.*, dc, ex*cos(th)+fx*sin(th) wx, ey*cos(th)+fy*sin(th) wy, ez*cos(th)+fz*sin(th) wz FROM o LEFT JOIN z USING (k))
"""


def _axes(spark, sf_dir):
    src = rows(spark, sf_dir).withColumn("year", F.year("d"))
    return src, sensing.alignment(src, "k", "year", ("ax", "ay", "az"), F.col("v") >= 20, least_rows=300, day_rows=40, gravity=(0.7, 1.15), least_ratio=1.05, least_cosine=0.5)


@query(_AXES + """SELECT k, n, nd n_drive, coalesce(nd >= 300 AND gn BETWEEN 0.7 AND 1.15 AND vr >= 1.05 AND coalesce(dc, 1) >= 0.5, false) align_pass, CASE WHEN nd < 300 THEN 'insufficient_rows' END reason, CASE WHEN nd >= 300 THEN round(gn,5) END gravity_norm, CASE WHEN nd >= 300 THEN round(vr,4) END var_ratio, CASE WHEN nd >= 300 THEN round(dc,4) END daily_cosine, CASE WHEN nd >= 300 THEN round(abs(wx),4) END forward_x, CASE WHEN nd >= 300 THEN round(gz,5) END vertical_z FROM w""")
def gravity_alignment(spark, sf_dir):
    _, a = _axes(spark, sf_dir)
    return a.select("k", "n", "n_drive", "align_pass", "reason", F.round("gravity_norm", 5).alias("gravity_norm"), F.round("var_ratio", 4).alias("var_ratio"), F.round("daily_cosine", 4).alias("daily_cosine"), F.round(F.abs(F.col("forward")[0]), 4).alias("forward_x"), F.round(F.col("vertical")[2], 5).alias("vertical_z"))


@query(_AXES + """SELECT r.k, count(*) n, count(vx) rotated, round(avg(r.ax*vx+r.ay*vy+r.az*vz),5) mean_vert, round(stddev_pop(r.ax*vx+r.ay*vy+r.az*vz),5) sd_vert FROM r LEFT JOIN (SELECT k, gx vx, gy vy, gz vz FROM w WHERE nd >= 300 AND gn BETWEEN 0.7 AND 1.15 AND vr >= 1.05 AND coalesce(dc, 1) >= 0.5) q ON q.k = r.k GROUP BY 1""")
def rotated_signals(spark, sf_dir):
    src, a = _axes(spark, sf_dir)
    t = sensing.rotated(src, a, "k", {"a": ("ax", "ay", "az")})
    return t.groupBy("k").agg(F.count("*").alias("n"), F.count("a_vert").alias("rotated"), F.round(F.avg("a_vert"), 5).alias("mean_vert"), F.round(F.stddev_pop("a_vert"), 5).alias("sd_vert"))


@query(_ROWS + """, q AS (SELECT k, quantile_cont(norm,0.5) FILTER (v >= 20) md FROM r GROUP BY 1), sg AS (SELECT r.k, abs(norm - md) residual, az, ax, d, flag FROM r JOIN q USING (k) WHERE v >= 20),
u AS (SELECT k, unnest(['residual','az']) signal, unnest([residual, az]) x, ax, d, flag FROM sg), p AS (SELECT u.*, part FROM u, (VALUES ('all'),('front'),('back'),('night'),('desaturated')) z(part) WHERE part = 'all' OR (part = 'front' AND d < DATE '1998-01-01') OR (part = 'back' AND d >= DATE '1998-01-01') OR (part = 'night' AND flag = 'R') OR (part = 'desaturated' AND ax < 1))
SELECT b.k, b.signal, b.part, count(p.x) n, round(sum(p.x::VARCHAR::DECIMAL(38,18))::DOUBLE / count(p.x),6) mean, round(stddev_pop(p.x),5) sd FROM (SELECT DISTINCT k, signal, z.part FROM u, (VALUES ('all'),('front'),('back'),('night'),('desaturated')) z(part)) b LEFT JOIN p ON p.k = b.k AND p.signal = b.signal AND p.part = b.part GROUP BY 1,2,3""")
def volatility_parts(spark, sf_dir):
    src, driving = rows(spark, sf_dir), F.col("v") >= 20
    early = F.col("d") < F.lit("1998-01-01").cast("date")
    parts = {"front": early, "back": ~early, "night": F.col("flag") == "R", "desaturated": F.col("ax") < 1}
    out = sensing.volatility_parts(sensing.residuals(src, "k", "norm", driving), "k", ["residual", "az"], driving, parts)
    return out.select("k", "signal", "part", "n", r6("mean").alias("mean"), F.round("sd", 5).alias("sd"))


# ---- sources, contracts, reviews, adoption, views

@query("""SELECT c_mktsegment, count(*) n, round(sum(value),4) total FROM events JOIN customer ON c_custkey = user_id WHERE ts >= TIMESTAMP '2024-01-05 06:00:00' AND ts < TIMESTAMP '2024-01-09' GROUP BY 1""")
def window_scan(spark, sf_dir):
    """Events written as headerless shards, a window of which is read back."""
    e, c = table(spark, sf_dir, "events"), table(spark, sf_dir, "customer")
    folder = shared_path(spark, "window")
    e.join(c, F.col("c_custkey") == F.col("user_id")).select("event_id", F.col("ts").cast("string"), "value", "c_mktsegment", "event_type").write.csv(folder, sep="\t", header=False)
    back = files.scan_window(spark, f"{folder}/part-*", ["id", "ts", "value", "c_mktsegment", "kind"], {"ts": "timestamp_ntz", "value": "double", "c_mktsegment": "string", "kind": "string"}, "ts", "2024-01-05 06:00:00", "2024-01-09", {"kind": ["view", "click", "error", "purchase", "signup"]})
    return back.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""SELECT page_id, page_id * 2 twice, regexp_extract(url, '^[a-z]+://([^/]+)', 1) host FROM pages WHERE page_id % 3 <> 0 UNION ALL SELECT page_id, NULL, NULL FROM pages WHERE page_id % 3 = 0""")
def page_payload(spark, sf_dir):
    """Pages, two thirds of which get a line with an object, and what is read from it."""
    p = table(spark, sf_dir, "pages")
    line = F.concat(F.lit("\nwindow.PAGE_DATA = "), F.to_json(F.struct((F.col("page_id") * 2).alias("twice"), F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"))), F.lit(";\n"))
    html = F.concat(F.coalesce("html", F.lit("")), F.when(F.col("page_id") % 3 != 0, line).otherwise(""))
    return p.select("page_id", files.embedded_json(html, "PAGE_DATA", "twice long, host string").alias("d")).select("page_id", "d.twice", "d.host")


@query("""SELECT unnest(['repeated','missing','unknown']) problem, unnest([count(*) - count(DISTINCT event_type), 5 - count(DISTINCT CASE WHEN event_type IN ('click','view','error','login','brake') THEN event_type END), count(*) FILTER (event_type NOT IN ('click','view','error','login','brake'))]) n FROM events""")
def code_violations(spark, sf_dir):
    """The codes of events, as a table of codes, against a list that lacks two of them and has two more."""
    return contract.violations(table(spark, sf_dir, "events"), "event_type", ["click", "view", "error", "login", "brake"])


@query("""WITH m AS (SELECT l_linenumber reviewer, l_suppkey AS "case", CASE l_suppkey % 2 WHEN 0 THEN 'even' ELSE 'odd' END kind, l_quantity/10 q1, 1 + l_discount*40 q2 FROM lineitem WHERE l_orderkey % 5 = 0),
x AS (SELECT *, (q1 BETWEEN 1 AND 5)::INT + (q2 BETWEEN 1 AND 5)::INT fit, CASE WHEN q1 BETWEEN 1 AND 5 THEN q1 ELSE 0 END + CASE WHEN q2 BETWEEN 1 AND 5 THEN q2 ELSE 0 END total FROM m),
a AS (SELECT count(*) n, count(DISTINCT (reviewer, "case")) pairs, count(DISTINCT reviewer) nr, count(DISTINCT "case") nc, sum(fit) fit, sum(total) total, count(DISTINCT "case") FILTER (kind = 'even') ne, min(CASE WHEN q1 BETWEEN 1 AND 5 THEN q1 END) l1, min(CASE WHEN q2 BETWEEN 1 AND 5 THEN q2 END) l2, count(DISTINCT "case") FILTER (kind = 'odd') no FROM x)
SELECT unnest(['empty_id','repeated_pair','reviewers','cases','incomplete','mixed_kind','unknown_kind','quota','rating','mean','least']) "rule", unnest([0, n - pairs, (nr <> 5)::BIGINT, (nc <> 10)::BIGINT, (n <> 50)::BIGINT, 0, (no > 0)::BIGINT, (ne <> 5)::BIGINT + 1, 2*n - fit, (total/fit < 4)::BIGINT, (least(l1,l2) < 3)::BIGINT])::BIGINT violations FROM a""")
def review_violations(spark, sf_dir):
    """Line items as ratings by reviewers of cases: a table that breaks most rules."""
    even = F.when(F.col("l_suppkey") % 2 == 0, "even").otherwise("odd")
    m = table(spark, sf_dir, "lineitem").filter("l_orderkey % 5 = 0").select(F.col("l_linenumber").alias("reviewer"), F.col("l_suppkey").alias("case"), even.alias("kind"), (F.col("l_quantity") / 10).alias("q1"), (1 + F.col("l_discount") * 40).alias("q2"))
    return contract.review_errors(m, "reviewer", "case", "kind", ["q1", "q2"], 5, 10, {"even": 5, "long": 3})


def _recall(s: str) -> str:
    return f"(SELECT sum(y) FROM (SELECT y FROM d ORDER BY {s} DESC, doc_id LIMIT (SELECT ceil(0.2*count(*))::BIGINT FROM d)))/(SELECT sum(y) FROM d)::DOUBLE"


@query(_D + f""", x AS (SELECT {_AUC.format(s='p2', t='d')} - {_AUC.format(s='p', t='d')} da, (SELECT avg((p-y)*(p-y)) - avg((p2-y)*(p2-y)) FROM d) db, {_recall('p2')} - {_recall('p')} dr)
SELECT round(da,6) auc, round(db,6) brier_gain, round(dr,6) recall, (da >= 0.005 OR (da > 0 AND db >= 0.005)) AND dr >= -0.02 AND db >= -0.005 adopted, da > 0 auc_positive, dr >= -0.02 recall_kept, -db <= 0.005 brier_kept FROM x""")
def adoption_tiers(spark, sf_dir):
    x = gains(scored(spark, sf_dir))
    da, db, dr = F.col("da"), F.col("db"), F.col("dr")
    gates = contract.candidate_gates(da, F.lit(0.0), dr, -db)
    return x.select(r6(da).alias("auc"), r6(db).alias("brier_gain"), r6(dr).alias("recall"), contract.adopted(da, db, dr).alias("adopted"), *(gates[k].alias(k) for k in ("auc_positive", "recall_kept", "brier_kept")))


def gains(d):
    """One row: what p2 gains over p in AUC (da), Brier score (db) and recall of the top fifth (dr)."""
    one = lambda s: evaluation.auc(d, s, "y").select(F.col("auc").alias(f"a_{s}"))
    top = lambda s: evaluation.top_k(d, s, "doc_id", 0.2).agg(F.sum("y").alias(f"r_{s}"))
    whole = d.agg(F.sum("y").alias("all"), (evaluation.brier(F.col("p"), F.col("y")) - evaluation.brier(F.col("p2"), F.col("y"))).alias("db"))
    x = one("p").crossJoin(one("p2")).crossJoin(top("p")).crossJoin(top("p2")).crossJoin(whole)  # one row each
    return x.select((F.col("a_p2") - F.col("a_p")).alias("da"), "db", ((F.col("r_p2") - F.col("r_p")) / F.col("all")).alias("dr"))


@query()
def candidate_gates(spark, sf_dir):
    """All gates, the lower bound from a paired bootstrap."""
    d = scored(spark, sf_dir)
    x = gains(d).crossJoin(bootstrap.paired_bootstrap(d, "p2", "p", "y", "doc_id", recall=False).select("low"))  # one row each
    return x.select(*(v.alias(k) for k, v in contract.candidate_gates(F.col("da"), F.col("low"), F.col("dr"), -F.col("db")).items()))


_L = "ln(least(greatest({0},1e-6),1-1e-6)/(1-least(greatest({0},1e-6),1-1e-6)))"


@query(_D + f""", v AS (SELECT doc_id, y, p a, p2 b, least((doc_id % 10)/10.0::DOUBLE,1) c FROM d), w AS (SELECT (SELECT {_AUC.format(s='a', t='v')}) xa, (SELECT {_AUC.format(s='b', t='v')}) xb, (SELECT {_AUC.format(s='c', t='v')}) xc)
SELECT doc_id, round(1/(1+exp(-({_L.format('a')} + {_L.format('c')})/2)),6) f1, round(1/(1+exp(-({_L.format('b')} + {_L.format('c')})/2)),6) f2, xa >= xb one_over_two FROM v, w""")
def view_fusion(spark, sf_dir):
    """Two views with an arm each and a third; every pair fused, whatever the order of their scores."""
    d = scored(spark, sf_dir).select("doc_id", "y", F.col("p").alias("a"), F.col("p2").alias("b"), ((F.col("doc_id") % 10) / 10.0).alias("c"))
    best, out = models.fused_views(d, {"a": "one", "b": "two", "c": "three"}, "y")
    pair = lambda x, y: F.col(f"fuse_{x}__{y}" if f"fuse_{x}__{y}" in out.columns else f"fuse_{y}__{x}")
    order = [v for v, _, _ in best]
    auc = {v: s for v, _, s in best}
    return out.select("doc_id", r6(pair("a", "c")).alias("f1"), r6(pair("b", "c")).alias("f2"), F.lit(auc["one"] >= auc["two"] if len(order) == 3 else None).alias("one_over_two"))


@query()
def risk_clusters(spark, sf_dir):
    """Documents in clusters ranked by their mean label, those under 1000 characters not eligible, and the risk group that follows."""
    d = scored(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    out, k = models.clusters_with_rank(d, range(2, 5), ["p", "p2"], "y", F.col("n_chars") >= 1000)
    return models.risk_group(out).groupBy("cluster", "risk_rank", "risk_group").agg(F.count("*").alias("n")).withColumn("k", F.lit(k))


@query()
def rule_replay(spark, sf_dir):
    """The rule over users, with event types as codes and values as kilometres."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("code"), F.to_date("ts").alias("day"), F.abs("value").alias("km"))
    c = table(spark, sf_dir, "customer").join(e.select(F.col("key").alias("c_custkey")).distinct(), "c_custkey", "left_semi")
    roster = c.select(F.col("c_custkey").alias("key"), (F.col("c_custkey") % 5).alias("fold"), (F.col("c_acctbal") / 10000).alias("teacher"), (60 + F.col("c_custkey") % 40).cast("double").alias("final"), (F.col("c_nationkey") % 2 == 0).alias("equipped"))
    codes = spark.createDataFrame([("click", "g1"), ("view", "g1"), ("error", "g2"), ("purchase", "g3"), ("signup", "g6")], "code string, grp string")
    counts = e.groupBy("key", "code", "day").agg(F.count("*").alias("n"))
    return replay.replay_rules(counts, e.select("key", "day", "km"), roster, codes, "2024-01-01", "2024-01-30", "2024-01-21", blind=("purchase",), unscored=("g6",), top=20)


@query("""SELECT mode, kind, coalesce(o.p90, f.p90, 1.5) p90, 9.0::DOUBLE p95 FROM (SELECT unnest(['A','N','R','Z']) kind) k LEFT JOIN (SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.9), 3) p90 FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1) o ON kind = l_returnflag, (SELECT round(quantile_cont(l_extendedprice, 0.9), 3) p90 FROM lineitem WHERE l_returnflag = 'A') f, (SELECT 'chain' mode)""")
def threshold_fallback(spark, sf_dir):
    """Thresholds of kinds, two of which have none of their own."""
    fitted = exact_quantiles(table(spark, sf_dir, "lineitem").filter("l_returnflag <> 'R'"), "l_extendedprice", {"p90": 0.9, "p95": 0.95}, "l_returnflag").withColumnRenamed("l_returnflag", "kind")
    kinds = spark.createDataFrame([(k, "chain") for k in "ANRZ"], "kind string, mode string")
    out = sensing.thresholds_for(kinds, fitted, "kind", ["p90", "p95"], {"p90": 1.5, "p95": 2.5}, {"p95": 9.0})
    return out.withColumn("p90", F.round("p90", 3))


@query()
def finalized_columns(spark, sf_dir):
    """The fate of each declared column: twins, constants, monotone images."""
    size, price = F.col("p_size"), F.col("p_retailprice")
    p = table(spark, sf_dir, "part").select(price.alias("price"), size.alias("size_per_1000km"), size.alias("size_per_100h"), F.lit(1.0).alias("constant"), F.log(price).alias("log_price"), (-size).alias("minus"))
    kept, dropped = cleaning.finalize_columns(p, p.columns)
    return spark.createDataFrame([*((c, "kept", "") for c in kept), *dropped], "column string, stage string, reason string")


@query()
def grouped_platt(spark, sf_dir):
    """Scores of one fold calibrated by fits of the others, by source and shrunk by the n0 of best AUC."""
    d = scored(spark, sf_dir).withColumn("fold", (F.col("doc_id") % 5).cast("int"))
    sources = [r.source for r in d.groupBy("source").count().orderBy(F.desc("count"), "source").limit(2).collect()]
    train, own, shrunk = d.filter("fold <> 0"), sources[:1], sources[1:]
    n0 = models.best_n0(train, "p", "y", "source", own, shrunk, "fold", [20.0, 80.0])
    at = models.platt_by_group(train, "p", "y", "source", own, shrunk)
    return d.filter("fold = 0").select("doc_id", F.lit(n0).alias("n0"), r6(at(n0)).alias("calibrated"))
