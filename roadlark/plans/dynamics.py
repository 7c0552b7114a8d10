"""Queries over dynamic scores, scenarios without directions, cohort and profile comparison, assembly."""

from __future__ import annotations

import math
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions import extension
from ..operators import aggregates, dynamics, joins
from ..operators.windows import with_share_below
from ..sources.shared import path as shared_path
from ..streaming import events as streams
from ..streaming import history
from .panels import _PANEL, panel
from .registry import big, query, r6, table

AS_OF = "2024-01-30"
POLICY = dynamics.Policy(window_days=14)
_BAND = "CASE WHEN hour(ts) >= 21 OR hour(ts) < 6 THEN 1.2::DOUBLE WHEN hour(ts) < 9 THEN 1.1 WHEN hour(ts) < 18 THEN 1.0 ELSE 1.1 END"
_STATUS = "CASE event_id % 4 WHEN 0 THEN 'valid' WHEN 1 THEN 'pending' WHEN 2 THEN 'exempt' ELSE 'valid' END"


def _evidence(spark, sf_dir):
    status = F.element_at(F.array(*map(F.lit, ("valid", "pending", "exempt", "valid"))), (F.col("event_id") % 4 + 1).cast("int"))
    ev = table(spark, sf_dir, "events").filter(F.col("ts") < "2024-01-31").filter("event_type = 'error'")
    return ev.select("user_id", "event_id", "ts", F.lit(2.0).alias("points"), status.alias("status"))


def _starts(spark, sf_dir):
    return panel(spark, sf_dir).select("user_id").distinct().select("user_id", F.lit(90.0).alias("initial"), (F.col("user_id") % 2 == 0).alias("previous_valid"))


def _history(spark, sf_dir):
    days = panel(spark, sf_dir).select("user_id", "day", F.col("n").cast("double").alias("exposure"))
    return dynamics.score_history(_starts(spark, sf_dir), days, _evidence(spark, sf_dir), "user_id", AS_OF, POLICY)


_HISTORY = _PANEL.replace("WITH u", "WITH RECURSIVE u") + f""", ev AS (SELECT user_id, ts::DATE AS day, {_STATUS} st, 2.0::DOUBLE * {_BAND} w FROM events WHERE event_type='error' AND ts < TIMESTAMP '2024-01-31'),
b AS (SELECT user_id, day, sum(CASE WHEN st = 'exempt' OR (st = 'pending' AND date_diff('day', day, DATE '{AS_OF}') < 3) THEN 0 ELSE w END) base FROM ev GROUP BY 1, 2),
x AS (SELECT p.user_id, p.day, p.d, p.n::DOUBLE exposure, coalesce(base, 0.0::DOUBLE) base FROM p LEFT JOIN b ON p.user_id = b.user_id AND p.day = b.day),
y AS (SELECT *, sum(exposure) OVER (PARTITION BY user_id ORDER BY d) total, sum(CASE WHEN exposure > 0 AND base > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY d RANGE BETWEEN 13 PRECEDING AND CURRENT ROW) act FROM x),
z AS (SELECT *, CASE WHEN exposure > 0 THEN least(1.5, 1 + 0.1::DOUBLE * greatest(act - 1, 0)) ELSE 1.0::DOUBLE END times FROM y),
q AS (SELECT *, CASE WHEN exposure > 0 THEN least(100.0::DOUBLE, base * times) ELSE 0.0::DOUBLE END risk, total / (total + 10.0::DOUBLE) trust FROM z),
r AS (SELECT user_id, -1::BIGINT AS d, NULL::DATE AS day, 0.0::DOUBLE ewma, 90.0::DOUBLE score, ''::VARCHAR status FROM u
 UNION ALL SELECT q.user_id, q.d, q.day, CASE WHEN q.exposure > 0 THEN pow(0.5::DOUBLE, 1/7.0::DOUBLE) * r.ewma + q.risk ELSE r.ewma END,
 CASE WHEN q.exposure = 0 THEN CASE WHEN q.d = 0 AND q.user_id % 2 <> 0 THEN 80.0::DOUBLE ELSE r.score END
  ELSE least(r.score + CASE WHEN q.risk > 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE END, 100.0::DOUBLE, greatest(0.0::DOUBLE, q.trust * greatest(0.0::DOUBLE, 90.0::DOUBLE - (pow(0.5::DOUBLE, 1/7.0::DOUBLE) * r.ewma + q.risk)) + (1 - q.trust) * 80.0::DOUBLE)) END,
 CASE WHEN q.exposure = 0 THEN CASE WHEN q.d = 0 AND q.user_id % 2 <> 0 THEN 'no_exposure_conservative' ELSE 'stopped_frozen' END WHEN q.total >= 5 THEN 'observed' ELSE 'low_exposure' END
 FROM r JOIN q ON q.user_id = r.user_id AND q.d = r.d + 1)
"""


@query(_HISTORY + "SELECT r.user_id, r.day, round(times,6) multiplier, round(risk,6) risk, round(ewma,5) ewma, round(score,5) score, status FROM r JOIN q USING (user_id, d) WHERE r.d >= 0")
def score_history(spark, sf_dir):
    """Every day's published score, with review deadline, persistence, shrinking, freezing and capped recovery."""
    return _history(spark, sf_dir).select("user_id", "day", r6("multiplier").alias("multiplier"), r6("risk").alias("risk"), F.round("ewma", 5).alias("ewma"), F.round("score", 5).alias("score"), "status")


@query(_HISTORY + "SELECT user_id, round(score,5) score, status FROM r WHERE d = 29")
def score_final(spark, sf_dir):
    return dynamics.final_scores(_starts(spark, sf_dir), _history(spark, sf_dir), "user_id", POLICY).withColumn("score", F.round("score", 5))


@query("SELECT unnest(['repeated_day','repeated_event','unknown_status','day_after_as_of','event_after_as_of','event_without_day','risk_without_exposure']) \"rule\", unnest([0,0,0,0,0,0,0])::BIGINT n")
def score_input_violations(spark, sf_dir):
    days = panel(spark, sf_dir).select("user_id", "day", F.col("n").cast("double").alias("exposure"))
    return dynamics.violations(days, dynamics.resolve_evidence(_evidence(spark, sf_dir), AS_OF, POLICY), "user_id", AS_OF)


@query(f"""
WITH e AS (SELECT {_STATUS} st, {_BAND} w, CASE WHEN hour(ts) >= 21 OR hour(ts) < 6 THEN 'night' WHEN hour(ts) < 9 THEN 'morning' WHEN hour(ts) < 18 THEN 'day' ELSE 'dusk' END band, date_diff('day', ts::DATE, DATE '{AS_OF}') age FROM events WHERE event_type='error' AND ts < TIMESTAMP '2024-01-31')
SELECT band, CASE WHEN st='exempt' THEN 'exempt' WHEN st <> 'pending' THEN 'valid' WHEN age < 3 THEN 'pending' ELSE 'auto_valid_after_deadline' END resolved, count(*) n, round(sum(CASE WHEN st='exempt' OR (st='pending' AND age < 3) THEN 0 ELSE 2*w END),6) points FROM e GROUP BY 1,2""")
def evidence_resolution(spark, sf_dir):
    e = dynamics.resolve_evidence(_evidence(spark, sf_dir), AS_OF, POLICY)
    return e.groupBy("band", "resolved").agg(F.count("*").alias("n"), r6(F.sum("adjusted")).alias("points"))


@query(_PANEL + """, r AS (SELECT user_id, d, percent_rank() OVER (PARTITION BY day ORDER BY n) x FROM p), w AS (SELECT user_id, list(x ORDER BY d) xs, (user_id % 10) / 10.0::DOUBLE t FROM r GROUP BY 1),
z AS (SELECT user_id, list_reduce(list_prepend(CASE WHEN t > 0.6 AND xs[1] >= 0.5 THEN 1.0::DOUBLE ELSE -1.0 END, xs[2:]), lambda s, x: CASE WHEN s = 1 AND x < 0.45 THEN 0.0 WHEN s = 0 AND x > 0.55 AND t > 0.6 THEN 1.0 ELSE s END) f FROM w)
SELECT user_id, CASE f WHEN 1 THEN 'in' WHEN 0 THEN 'out' ELSE 'off' END state FROM z""")
def door_states(spark, sf_dir):
    """Hysteresis with a teacher's gate and an absorbing off state."""
    g = with_share_below(panel(spark, sf_dir).select("user_id", "day", "d", "n"), ["day"], "n", "x").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("d", "x"))).alias("days"))  # as many as days
    return g.select("user_id", dynamics.door(F.transform("days", lambda s: s.x), (F.col("user_id") % 10) / 10.0).alias("state"))


@query("""SELECT user_id, CASE WHEN count(DISTINCT event_type) < 5 THEN 50.0::DOUBLE ELSE round(100 - least(max(value), 100), 6) END score, CASE WHEN count(DISTINCT event_type) < 5 THEN 'low_evidence_prior' ELSE 'raw_rule_score' END policy FROM events GROUP BY 1""")
def publication(spark, sf_dir):
    g = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_distinct("event_type").alias("classes"), (100 - F.least(F.max("value"), F.lit(100.0))).alias("raw"))
    score, policy = dynamics.publish(F.col("raw"), F.col("classes"), least=5)
    return g.select("user_id", r6(score).alias("score"), policy.alias("policy"))


@query("""
WITH a AS (SELECT o_custkey c, sum(o_totalprice) FILTER (o_orderdate >= TIMESTAMP '1996-01-01') x, avg(o_totalprice) m FROM orders GROUP BY 1)
SELECT c_custkey, round(CASE WHEN abs(c_acctbal) > 1e-12 THEN (x * (30.44/365) - c_acctbal)/abs(c_acctbal) END, 6) sum_dev, round(CASE WHEN abs(m) > 1e-12 THEN (c_acctbal - m)/abs(m) END, 6) mean_dev FROM customer LEFT JOIN a ON c = c_custkey""")
def profile_deviation(spark, sf_dir):
    a = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum(F.when(F.col("o_orderdate") >= "1996-01-01", F.col("o_totalprice"))).alias("x"), F.avg("o_totalprice").alias("m"))
    j = table(spark, sf_dir, "customer").join(a, "c_custkey", "left")
    return j.select("c_custkey", r6(dynamics.profile_deviation(F.col("x"), F.col("c_acctbal"), 30.44 / 365)).alias("sum_dev"), r6(dynamics.profile_deviation(F.col("c_acctbal"), F.col("m"))).alias("mean_dev"))


@query("""
WITH c AS (SELECT c_custkey, c_acctbal x, c_mktsegment || CASE WHEN c_nationkey % 12 = 0 THEN '/' || c_nationkey ELSE '' END g, c_custkey % 5 <> 0 tr FROM customer),
s AS (SELECT g, count(*) FILTER (tr) n, avg(x) FILTER (tr) m, stddev_pop(x) FILTER (tr) d FROM c GROUP BY 1), a AS (SELECT avg(x) FILTER (tr) m, stddev_pop(x) FILTER (tr) d FROM c),
w AS (SELECT *, sum(tr::INT) OVER (PARTITION BY g ORDER BY x) own, sum(tr::INT) OVER (ORDER BY x) fleet, count(*) FILTER (tr) OVER () tot FROM c)
SELECT c_custkey, round(CASE WHEN s.n < 30 THEN (x - a.m)/a.d ELSE (x - s.m)/s.d END, 6) z, round(CASE WHEN s.n < 30 THEN fleet / tot::DOUBLE ELSE own / s.n::DOUBLE END, 6) pct, (s.n < 30)::INT fallback FROM w JOIN s USING (g), a""")
def cohort_position(spark, sf_dir):
    """z and percentile within a cohort from training rows, of the whole fleet for a small cohort."""
    g = F.when(F.col("c_nationkey") % 12 == 0, F.concat("c_mktsegment", F.lit("/"), F.col("c_nationkey").cast("string"))).otherwise(F.col("c_mktsegment"))
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("x"), g.alias("g"), (F.col("c_custkey") % 5 != 0).alias("tr"))
    out = aggregates.cohort_relative(c, "g", "x", "tr")
    return out.select("c_custkey", r6("z").alias("z"), r6("pct").alias("pct"), "fallback")


@query("""
WITH s AS (SELECT l_orderkey, l_linenumber, l_discount*10 r, l_quantity w, CASE l_returnflag WHEN 'A' THEN 0.5 WHEN 'N' THEN 0.6 ELSE 0.7 END lt FROM lineitem)
SELECT scenario, count(*) n, round(sum("value"),4) total FROM (SELECT 'long_anom' scenario, r::DOUBLE "value" FROM s WHERE r >= lt UNION ALL SELECT 'turn_anom', w::DOUBLE FROM s WHERE w >= 40 UNION ALL SELECT 'collision', r::DOUBLE FROM s WHERE r >= 0.9 UNION ALL SELECT 'rollover', w::DOUBLE FROM s WHERE r >= 0.5 AND w >= 45) GROUP BY 1""")
def direction_free_scenarios(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_discount") * 10).alias("r"), F.col("l_quantity").alias("w"), "l_returnflag")
    at = F.when(F.col("l_returnflag") == "A", 0.5).when(F.col("l_returnflag") == "N", 0.6).otherwise(0.7)
    rows = dynamics.direction_free(s, ["l_orderkey", "l_linenumber"], "r", "w", at, F.lit(40), collision=0.9, tilt=0.5, rollover=45)
    return rows.groupBy("scenario").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""
WITH e AS (SELECT user_id, count(*) FILTER (event_type='error') errors, count(*) FILTER (event_type='click') clicks FROM events GROUP BY 1), d AS (SELECT user_id, count(DISTINCT ts::DATE) AS "days", round(max(value),6) AS "largest" FROM events GROUP BY 1)
SELECT c_custkey user_id, coalesce(errors,0) errors, coalesce(clicks,0) clicks, "days", "largest", round(CASE WHEN "days" >= 3 THEN coalesce(errors,0)*100/"days"::DOUBLE END,6) errors_rate, round(CASE WHEN "days" >= 3 THEN coalesce(clicks,0)*100/"days"::DOUBLE END,6) clicks_rate FROM customer LEFT JOIN e ON e.user_id = c_custkey LEFT JOIN d ON d.user_id = c_custkey""")
def vehicle_assembly(spark, sf_dir):
    """A roster's row with all families' features, counts also as rates by exposure."""
    ev = table(spark, sf_dir, "events")
    e = ev.groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if(F.col("event_type") == "click").alias("clicks"))
    d = ev.groupBy("user_id").agg(F.count_distinct(F.to_date("ts")).alias("days"), r6(F.max("value")).alias("largest"))
    roster = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    out = dynamics.assemble(roster, "user_id", {"events": e, "days": d}, ["errors", "clicks"], "days", 100.0, 3)
    return out.withColumns({"errors_rate": r6("errors_rate"), "clicks_rate": r6("clicks_rate")})


class Moments:
    """Count, mean and largest of a column, mergeable."""

    def __init__(self):
        self.n, self.total, self.largest = 0, 0.0, -np.inf

    def add(self, rows: pd.DataFrame) -> None:
        x = rows["value"]
        self.n, self.total, self.largest = self.n + len(x), self.total + float(x.sum()), max(self.largest, float(x.max()))

    def merge(self, other: Moments) -> None:
        self.n, self.total, self.largest = self.n + other.n, self.total + other.total, max(self.largest, other.largest)

    def finish(self) -> dict:
        mean = self.total / self.n
        if math.isfinite(mean) and abs(self.total) < 1e15:  # halves away from zero, by the sum as it is written
            mean = float((Decimal(repr(round(self.total, 9))) / self.n).quantize(Decimal("0.0001"), ROUND_HALF_UP))
        return {"n": self.n, "mean": mean, "largest": self.largest}


@query('SELECT CASE WHEN user_id % 10 <> 0 THEN user_id + 9007199254740992 END user_id, count(*) n, round(avg("value"),4) mean, max("value") largest FROM events GROUP BY 1')
def accumulator(spark, sf_dir):
    """A user's own mergeable accumulator, by keys over 2**53 and a null one."""
    key = F.when(F.col("user_id") % 10 != 0, F.col("user_id") + (1 << 53))
    return extension.accumulate(table(spark, sf_dir, "events").select(key.alias("user_id"), "value"), "user_id", Moments, "user_id long, n long, mean double, largest double")


@query("SELECT o_orderstatus status, o_orderpriority priority, count(*) n FROM orders GROUP BY 1, 2 UNION ALL SELECT o_orderstatus, 'all', count(*) FROM orders GROUP BY 1")
def expansion(spark, sf_dir):
    """A user's own function from rows to several rows each."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    return extension.expand(o, lambda pdf: (pdf, pdf.assign(priority="all")), "status string, priority string").groupBy("status", "priority").agg(F.count("*").alias("n"))


@query(_PANEL + """, m AS (SELECT p.*, list_position(['BUILDING','MACHINERY'], c_mktsegment) seg FROM p JOIN customer ON c_custkey = user_id)
SELECT user_id, seg::INT segment, sum(n)::BIGINT n FROM m GROUP BY 1, 2""")
def segment_lookup(spark, sf_dir):
    """Counts by user with a code from a look-up table."""
    codes = spark.createDataFrame([("BUILDING", 1), ("MACHINERY", 2)], "c_mktsegment string, segment int")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    p = joins.left_one(panel(spark, sf_dir).groupBy("user_id").agg(big(F.sum("n")).alias("n")), c, ["user_id"]).filter("c_mktsegment is not null")
    return joins.lookup(p, codes, "c_mktsegment", "segment", None).select("user_id", "segment", "n")


@query("""
WITH e AS (SELECT event_id, ts, CASE event_id % 4 WHEN 1 THEN 'pending' WHEN 2 THEN 'exempt' ELSE 'valid' END st, max(ts) OVER () last FROM events WHERE event_type = 'error')
SELECT event_id, CASE WHEN st = 'pending' THEN 'auto_valid_after_deadline' ELSE st END resolved, st <> 'exempt' included FROM e WHERE st <> 'pending' OR ts + INTERVAL 3 DAY <= last - INTERVAL 1 HOUR""")
def stream_evidence(spark, sf_dir):
    """Evidence decided by review, or by the deadline once the watermark has passed it."""
    s = streams.event_stream(spark, sf_dir).filter("event_type = 'error'")
    status = F.element_at(F.array(*map(F.lit, ("valid", "pending", "exempt", "valid"))), (F.col("event_id") % 4 + 1).cast("int"))
    return streams.run(streams.evidence(s.withColumn("status", status)), "update")


@query("""
WITH w AS (SELECT user_id, list(least(value / 100, 1.0) ORDER BY ts) xs, (user_id % 10) / 10.0::DOUBLE t FROM events GROUP BY 1),
z AS (SELECT user_id, list_reduce(list_prepend(CASE WHEN t > 0.6 AND xs[1] >= 0.5 THEN 1.0::DOUBLE ELSE -1.0 END, xs[2:]), lambda s, x: CASE WHEN s = 1 AND x < 0.45 THEN 0.0 WHEN s = 0 AND x > 0.55 AND t > 0.6 THEN 1.0 ELSE s END) f FROM w)
SELECT user_id, CASE f WHEN 1 THEN 'in' WHEN 0 THEN 'out' ELSE 'off' END state FROM z""")
def stream_doors(spark, sf_dir):
    """The last hysteresis state of each user."""
    s = streams.event_stream(spark, sf_dir).select("user_id", "ts", F.least(F.col("value") / 100, F.lit(1.0)).alias("x"), ((F.col("user_id") % 10) / 10.0).alias("teacher"))
    return streams.run(streams.doors(s), "update", ["user_id"])


@query(_HISTORY + "SELECT r.user_id, r.day, round(times,6) multiplier, round(risk,6) risk, round(ewma,5) ewma, round(score,5) score, status FROM r JOIN q USING (user_id, d) WHERE r.d BETWEEN 0 AND 26")
def stream_history(spark, sf_dir):
    """Daily scores from a stream of days and evidence in several files, up to the last day whose evidence is decided."""
    folder, at = shared_path(spark, "facts"), F.col("day").cast("timestamp")
    none = lambda kind: F.lit(None).cast(kind)
    days = panel(spark, sf_dir).select("user_id", at.alias("ts"), F.col("n").cast("double").alias("exposure"), none("long").alias("event_id"), none("double").alias("points"), none("string").alias("status"))
    evidence = _evidence(spark, sf_dir).select("user_id", F.col("ts").cast("timestamp").alias("ts"), none("double").alias("exposure"), "event_id", "points", "status")
    last = spark.createDataFrame([(-1,)], "user_id long").select("user_id", F.expr("timestamp '2024-06-01'").alias("ts"), F.lit(0.0).alias("exposure"), none("long").alias("event_id"), none("double").alias("points"), none("string").alias("status"))
    days.unionByName(evidence).repartition(6).write.parquet(folder)
    last.coalesce(1).write.mode("append").parquet(folder)
    held = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    try:
        s = history.with_state_store(spark).readStream.schema(history.SCHEMA).option("maxFilesPerTrigger", 3).parquet(folder)
        out = streams.run(history.score_stream(s, _starts(spark, sf_dir), POLICY, "60 days"), "append")
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", held)
    return out.filter("day <= '2024-01-27'").select("user_id", "day", *(r6(c).alias(c) for c in ("multiplier", "risk")), F.round("ewma", 5).alias("ewma"), F.round("score", 5).alias("score"), "status")
