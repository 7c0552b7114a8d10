"""Queries over sequential state, learnt rules, streams, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import bin_index, ratio, sha_bucket
from ..operators import rules
from ..operators.windows import with_share_below
from ..sources import files
from ..sources.shared import path as shared_path
from ..streaming import events as streams
from .panels import _PANEL, panel
from .registry import big, query, r6, table


@query(_PANEL + """, r AS (SELECT user_id, d, percent_rank() OVER (PARTITION BY day ORDER BY n) x FROM p),
w AS (SELECT user_id, list(x ORDER BY d) xs FROM r GROUP BY 1),
z AS (SELECT user_id, list_reduce(list_prepend(1.0::DOUBLE, xs), lambda s, x: CASE WHEN s = 1 AND x < 0.2 THEN 0.0 WHEN s = 0 AND x > 0.8 THEN 1.0 ELSE s END) final FROM w)
SELECT user_id, final::INT AS final FROM z""")
def hysteresis_door(spark, sf_dir):
    g = with_share_below(panel(spark, sf_dir).select("user_id", "day", "d", "n"), ["day"], "n", "x").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("d", "x"))).alias("days"))
    return g.select("user_id", rules.hysteresis(F.transform("days", lambda s: s.x), 0.2, 0.8).alias("final"))


@query(_PANEL.replace("WITH u", "WITH RECURSIVE u") + """,
r AS (SELECT user_id, -1::BIGINT AS d, 0.0::DOUBLE risk, 0.0::DOUBLE seen, 80.0::DOUBLE score, false observed FROM u
 UNION ALL SELECT p.user_id, p.d, CASE WHEN p.n > 0 THEN pow(0.5::DOUBLE, 1/7.0::DOUBLE) * r.risk + 2.0 * p.e ELSE r.risk END, r.seen + p.n,
 CASE WHEN p.n > 0 THEN least(r.score + 2.0, (r.seen + p.n) / (r.seen + p.n + 5.0) * greatest(0.0, 100.0 - (pow(0.5::DOUBLE, 1/7.0::DOUBLE) * r.risk + 2.0 * p.e)) + (1 - (r.seen + p.n) / (r.seen + p.n + 5.0)) * 80.0) ELSE r.score END, p.n > 0
 FROM r JOIN p ON p.user_id = r.user_id AND p.d = r.d + 1)
SELECT user_id, d, round(score, 6) score, observed FROM r WHERE d >= 0""")
def score_replay(spark, sf_dir):
    days = panel(spark, sf_dir).select("user_id", "d", (F.col("e") * 2.0).alias("points"), F.col("n").cast("double").alias("exposure"))
    return rules.replay(days, "user_id", "d", "points", "exposure").withColumn("score", r6("score"))


@query("""
WITH e AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'valid' WHEN 1 THEN 'pending' WHEN 2 THEN 'exempt' ELSE 'rejected' END status, date_diff('day', ts::DATE, DATE '2024-01-31') age FROM events)
SELECT status, count(*) n, count(*) FILTER (CASE status WHEN 'valid' THEN true WHEN 'pending' THEN age >= 3 ELSE false END) counted FROM e GROUP BY 1""")
def review_deadline(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, ("valid", "pending", "exempt", "rejected"))), (F.col("event_id") % 4 + 1).cast("int"))
    e = table(spark, sf_dir, "events").select(kind.alias("status"), F.date_diff(F.lit("2024-01-31").cast("date"), F.to_date("ts")).alias("age"))
    return e.groupBy("status").agg(F.count("*").alias("n"), F.count_if(rules.resolve_review(F.col("status"), F.col("age"))).alias("counted"))


def _rates(spark, sf_dir):
    """(user, group, class, events a day) with the label of the later window."""
    ev = table(spark, sf_dir, "events")
    y = ev.groupBy("user_id").agg(F.max((F.col("ts") >= "2024-01-21").cast("int") * (F.col("event_type") == "error").cast("int")).alias("y"))
    x = ev.filter("ts < '2024-01-21'").groupBy("user_id", F.col("event_type").alias("cls")).agg((F.count("*") / 20.0).alias("x"))
    return x.join(y, "user_id").withColumn("grp", F.when(F.col("cls").isin("click", "view"), "attention").otherwise(F.col("cls")))


def _ruleset(spark, sf_dir):
    rates = _rates(spark, sf_dir).filter(F.col("user_id") % 5 != 0)
    out = None
    for cls in ("click", "error", "purchase", "signup", "view"):  # the contract's classes
        part = rules.fit_bins(rates.filter(F.col("cls") == cls), "x", "y").withColumn("cls", F.lit(cls))
        out = part if out is None else out.unionByName(part)
    return out


_RULES = """
WITH y AS (SELECT user_id, max((ts >= TIMESTAMP '2024-01-21' AND event_type = 'error')::INT) y FROM events GROUP BY 1),
x AS (SELECT user_id, event_type cls, count(*) / 20.0::DOUBLE x, CASE WHEN event_type IN ('click', 'view') THEN 'attention' ELSE event_type END grp FROM events WHERE ts < TIMESTAMP '2024-01-21' GROUP BY 1, 2),
t AS (SELECT x.*, y FROM x JOIN y USING (user_id) WHERE user_id % 5 <> 0 AND cls IN ('click', 'error', 'purchase', 'signup', 'view')),
q AS (SELECT cls, list_distinct(quantile_cont(x, [0.25, 0.5, 0.75])) e FROM t GROUP BY 1),
b AS (SELECT cls, len(list_filter(e, lambda v: v <= x)) bin, min(x) low, count(*) n, avg(y) m FROM t JOIN q USING (cls) GROUP BY 1, 2),
s AS (SELECT i.cls, i.bin i, k.bin k, sum(l.n * l.m) / sum(l.n) w FROM b i JOIN b k ON k.cls = i.cls AND k.bin >= i.bin JOIN b l ON l.cls = i.cls AND l.bin BETWEEN i.bin AND k.bin GROUP BY 1, 2, 3),
r AS (SELECT cls, bin, max(w) risk FROM (SELECT b.cls, b.bin, s.i, min(w) w FROM b JOIN s ON s.cls = b.cls AND s.i <= b.bin AND s.k >= b.bin GROUP BY 1, 2, 3) GROUP BY 1, 2)"""


@query(_RULES + " SELECT cls, bin::INT bin, round(low, 6) low, n, round(risk, 6) risk FROM b JOIN r USING (cls, bin)")
def monotone_rules(spark, sf_dir):
    return _ruleset(spark, sf_dir).select("cls", "bin", r6("low").alias("low"), "n", r6("risk").alias("risk"))


@query()
def compressed_rules(spark, sf_dir):
    """The bins of the click rate with neighbours of equal risk made one, by the rule as documented and as in use."""
    rates = _rates(spark, sf_dir).filter(F.col("cls") == "click")
    out = [rules.fit_bins(rates, "x", "y", 8, compress=True, compat=c).withColumn("compat", F.lit(c)) for c in (False, True)]
    return out[0].unionByName(out[1]).select("compat", "bin", r6("low").alias("low"), "n", r6("risk").alias("risk"))


@query(_RULES + """, p AS (SELECT cls, bin, low, lead(low) OVER (PARTITION BY cls ORDER BY low) high, risk, max(risk) OVER (PARTITION BY cls) top FROM b JOIN r USING (cls, bin)),
l AS (SELECT user_id, grp, 100.0::DOUBLE / (SELECT count(DISTINCT cls) FROM b) * coalesce(risk / nullif(top, 0), 0) pts FROM x JOIN p ON p.cls = x.cls AND (x >= low OR bin = 0) AND (high IS NULL OR x < high)),
g AS (SELECT user_id, max(pts) + 0.25::DOUBLE * CASE WHEN count(*) > 1 THEN (sum(pts) - max(pts)) / (count(*) - 1) ELSE 0 END d FROM l GROUP BY user_id, grp)
SELECT user_id, round(greatest(0, least(100, 100 - sum(d))), 6) score, round(greatest(0, least(100, 100 - sum(d))), 6) recomputed FROM g GROUP BY 1""")
def rule_scores(spark, sf_dir):
    """Scores, and the score made again from the ledger: both columns agree."""
    scores, ledger = rules.score_with_ledger(_rates(spark, sf_dir), _ruleset(spark, sf_dir), "user_id")
    again = ledger.groupBy("user_id", "grp").agg(rules.diminishing("points").alias("d")).groupBy("user_id").agg(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 - F.sum("d"))).alias("again"))
    return scores.join(again, "user_id").select("user_id", r6("score").alias("score"), r6("again").alias("recomputed"))


@query()
def distilled_weights(spark, sf_dir):
    """Non-negative weights that explain a user's mean value by event counts."""
    ev = table(spark, sf_dir, "events")
    kinds = ["click", "error", "purchase"]
    x = ev.groupBy("user_id").agg(*(F.count_if(F.col("event_type") == k).cast("double").alias(k) for k in kinds), F.sum("value").alias("y"))
    w = rules.nonnegative_ridge(x, kinds, "y")
    return spark.createDataFrame(list(zip([*kinds, "intercept"], w)), "term string, weight double")


@query("""
SELECT c_custkey, (('0x' || substr(sha256('42:' || c_custkey::VARCHAR), 1, 16))::UBIGINT % 10)::INT bucket, len(list_filter([0.0, 1000, 5000], lambda e: e <= c_acctbal))::INT band FROM customer""")
def hash_buckets(spark, sf_dir):
    edges = F.array(F.lit(0.0), F.lit(1000.0), F.lit(5000.0))
    return table(spark, sf_dir, "customer").select("c_custkey", sha_bucket(F.col("c_custkey"), 10).alias("bucket"), bin_index(F.col("c_acctbal"), edges).alias("band"))


@query("SELECT c_nationkey, count(*) n, sha256(string_agg(c_custkey::VARCHAR, ',' ORDER BY c_custkey)) sha256 FROM customer GROUP BY 1")
def id_fingerprints(spark, sf_dir):
    return files.fingerprint(table(spark, sf_dir, "customer"), "c_nationkey", "c_custkey")


@query("""
SELECT c_mktsegment, count(*) n, count(*) FILTER (c_custkey % 7 = 0) missing, round(sum(CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END),2) balance FROM customer GROUP BY 1""")
def tsv_shards(spark, sf_dir):
    """Customers written as headerless TSV shards with null tokens, read back by declared order."""
    folder = shared_path(spark, "tsv")
    c = table(spark, sf_dir, "customer")
    raw = c.select("c_custkey", F.when(F.col("c_custkey") % 7 == 0, F.when(F.col("c_custkey") % 2 == 0, "NULL").otherwise("null")).otherwise(F.col("c_acctbal").cast("string")), "c_mktsegment")
    raw.write.csv(folder, sep="\t", header=False)
    back = files.read_shards(spark, f"{folder}/part-*", ["id", "bal", "segment"], {"id": "long", "balance": "double", "c_mktsegment": "string", "speed": "double"}, ["id"], {"balance": "bal", "c_mktsegment": "segment"})
    return back.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.count_if(F.col("balance").isNull()).alias("missing"), F.round(F.sum("balance"), 2).alias("balance"))


@query("""
SELECT n_name, count(*) customers, round(avg(c_acctbal),4) mean_balance, round(count(*)/(SELECT count(*) FROM customer)::DOUBLE,6) share FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def lookup_join(spark, sf_dir):
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    g = c.groupBy("c_nationkey").agg(F.count("*").alias("customers"), F.avg("c_acctbal").alias("m"))
    total = g.agg(F.sum("customers").alias("all"))
    return g.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(total)).select("n_name", "customers", F.round("m", 4).alias("mean_balance"), r6(ratio(F.col("customers"), F.col("all"))).alias("share"))  # total: one row


@query("SELECT ts::DATE AS day, event_type, count(*) n, round(sum(value),4) \"value\" FROM events GROUP BY 1,2")
def stream_daily_counts(spark, sf_dir):
    return streams.run(streams.daily_counts(streams.event_stream(spark, sf_dir)), "update", ["day", "event_type"]).withColumn("value", F.round("value", 4))


@query("""
WITH d AS (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-02-25', INTERVAL 1 DAY))::DATE AS as_of)
SELECT as_of, event_type, count(*) n FROM d JOIN events ON ts < as_of AND ts >= as_of - INTERVAL 20 DAY GROUP BY 1,2""")
def stream_sliding_counts(spark, sf_dir):
    return streams.run(streams.sliding_counts(streams.event_stream(spark, sf_dir)), "update", ["as_of", "event_type"])


@query("""
WITH b AS (SELECT user_id, event_type, ts, event_id, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > (CASE WHEN event_type='error' THEN INTERVAL 12 HOUR ELSE INTERVAL 6 HOUR END) THEN 1 ELSE 0 END b FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)),
c AS (SELECT *, sum(b) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) s FROM b)
SELECT user_id, event_type, epoch_us(min(ts)) start_us, count(*) n FROM c GROUP BY user_id, event_type, s""")
def stream_sessions(spark, sf_dir):
    """Chains as the watermark closes them, in append mode; a last row, long after the others, lets the last ones close."""
    folder = shared_path(spark, "session-events")
    ev = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).select("event_id", "ts", "user_id", "event_type", "value", "props")
    ev.write.parquet(f"{folder}/0")
    last = ev.groupBy().agg(F.max("ts").alias("ts")).select(F.lit(-1).cast("long").alias("event_id"), (F.col("ts") + F.expr("interval 30 days")).alias("ts"), F.lit(-1).cast("long").alias("user_id"), F.lit("end").alias("event_type"), F.lit(0.0).alias("value"), F.lit(None).cast("string").alias("props"))
    last.write.parquet(f"{folder}/1")
    stream = spark.readStream.schema(streams.SCHEMA).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 8).parquet(folder)
    s = streams.run(streams.sessions(stream, {"error": "12 hours"}), "append").filter("user_id <> -1")
    return s.select("user_id", "event_type", F.unix_micros("start").alias("start_us"), "n")


@query("SELECT event_type, count(*) n FROM (SELECT DISTINCT user_id, event_type, ts, value FROM events) GROUP BY 1")
def stream_dedup(spark, sf_dir):
    return streams.run(streams.without_duplicates(streams.event_stream(spark, sf_dir)), "append").groupBy("event_type").agg(F.count("*").alias("n"))


@query("""
WITH w AS (SELECT user_id, count(*) n, list(CASE WHEN event_type='error' THEN 1.0::DOUBLE ELSE 0.0 END ORDER BY ts, event_id) xs FROM events GROUP BY 1), r AS (SELECT user_id, n, list_reduce(list_prepend(0.0::DOUBLE, xs), lambda s, x: 0.9*s + x) risk FROM w)
SELECT user_id, n AS "events", round(n/(n+10.0::DOUBLE)*greatest(100-5*risk,0) + (1-n/(n+10.0::DOUBLE))*80,5) score FROM r""")
def stream_scores(spark, sf_dir):
    return streams.run(streams.scores(streams.event_stream(spark, sf_dir)), "update").groupBy("user_id").agg(F.max("events").alias("events"), F.round(F.max_by("score", "events"), 5).alias("score"))
