"""Queries over locked inputs, ledgers, manifests, views, recomputed results and whole model fits."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler
from pyspark.sql import functions as F

from ..functions.scalars import clip, logit
from ..operators import evaluation, models, protocol
from ..operators.rules import nonnegative_ridge
from ..sources.shared import path as shared_path
from .evaluation import _AUC, _D, scored
from .registry import query, r6, table


@query("SELECT c_mktsegment, count(*) n, round(sum(c_acctbal),2) balance FROM customer GROUP BY 1")
def locked_input(spark, sf_dir):
    """Customers written by segment, hashed, and read again only as the hashes and the column ledger say."""
    folder, c = shared_path(spark, "locked"), table(spark, sf_dir, "customer")
    c.write.partitionBy("c_mktsegment").parquet(folder)
    back = protocol.read_locked(spark, folder, protocol.tree_hash(protocol.file_hashes(spark, folder)), c.columns)
    return back.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("SELECT 'v1' AS \"version\", c_mktsegment, count(*) n FROM customer GROUP BY 2 UNION ALL SELECT 'v2', c_mktsegment, count(*) FROM customer WHERE c_acctbal > 0 GROUP BY 2")
def ledger_append(spark, sf_dir):
    folder, c = shared_path(spark, "ledger"), table(spark, sf_dir, "customer")
    count = lambda df: df.groupBy("c_mktsegment").agg(F.count("*").alias("n"))
    protocol.append_ledger(count(c), folder, "v1")
    protocol.append_ledger(count(c.filter("c_acctbal > 0")), folder, "v2")
    return spark.read.parquet(folder).select("version", "c_mktsegment", "n")


@query("SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS \"position\", c_custkey, c_acctbal, c_mktsegment, c_nationkey FROM customer")
def aligned_tables(spark, sf_dir):
    """Tables joined in one order, with keys and the shared label checked; nothing is joined by place."""
    c = table(spark, sf_dir, "customer")
    return protocol.align(c.select("c_custkey", "c_acctbal"), [c.select("c_custkey", "c_acctbal", "c_mktsegment").repartition(3), c.select("c_custkey", "c_nationkey")], "c_custkey", "c_acctbal").select("position", "c_custkey", "c_acctbal", "c_mktsegment", "c_nationkey")


@query("""
SELECT CASE WHEN regexp_matches(c, 'key$') THEN 'keys' WHEN regexp_matches(c, 'date|price') THEN 'facts' ELSE 'slim' END "view", c AS "column" FROM (SELECT unnest(['o_orderkey','o_custkey','o_orderstatus','o_totalprice','o_orderdate','o_orderpriority']) c)""")
def feature_views(spark, sf_dir):
    v = protocol.views(table(spark, sf_dir, "orders").columns, {"keys": "key$", "facts": "date|price"})
    return spark.createDataFrame([(name, c) for name, cols in v.items() for c in cols], "view string, column string")


@query("""SELECT c AS "column", s AS source, u AS "until", coalesce(u::DATE <= DATE '2024-01-20', false) visible FROM (VALUES ('evt_20d','events','2024-01-20'), ('evt_next','events','2024-02-01'), ('profile','profile',NULL)) t(c, s, u)""")
def visibility_ledger(spark, sf_dir):
    return protocol.visibility(spark, {"evt_20d": ("events", "2024-01-20"), "evt_next": ("events", "2024-02-01"), "profile": ("profile", None)}, "2024-01-20")


_GOOD = {"as_of": "2024-01-21", "feature_window": ["2024-01-01", "2024-01-21"], "label_window": ["2024-01-21", "2024-01-31"], "label_version": "l1", "split_version": "s1", "target_count": 500}


@query("""SELECT * FROM (VALUES ('good', 0::BIGINT), ('late features', 1), ('early labels', 1), ('leak', 1), ('no version', 1), ('bad hash', 1)) t(manifest, errors)""")
def manifest_checks(spark, sf_dir):
    """How many errors are found in a good manifest and in ones with a fault each."""
    cases = {"good": {}, "late features": {"feature_window": ["2024-01-01", "2024-01-25"]}, "early labels": {"label_window": ["2024-01-20", "2024-01-31"]}, "leak": {"test_used_in_fit": True}, "no version": {"label_version": ""}, "bad hash": {"hashes": {"a": "xyz"}}}
    return spark.createDataFrame([(name, len(protocol.manifest_errors(_GOOD | change))) for name, change in cases.items()], "manifest string, errors long")


@query("""SELECT unnest(['positive_key','balance_in_range','has_segment','known_nation']) "rule", unnest([count(*) FILTER (NOT coalesce(c_custkey > 0, false)), count(*) FILTER (NOT coalesce(c_acctbal BETWEEN 0 AND 5000, false)), count(*) FILTER (c_mktsegment IS NULL), count(*) FILTER (NOT coalesce(c_nationkey < 20, false))]) violations FROM customer""")
def result_assertions(spark, sf_dir):
    rules = {"positive_key": F.col("c_custkey") > 0, "balance_in_range": F.col("c_acctbal").between(0, 5000), "has_segment": F.col("c_mktsegment").isNotNull(), "known_nation": F.col("c_nationkey") < 20}
    return protocol.assertions(table(spark, sf_dir, "customer"), rules)


@query("SELECT unnest(['label_rate is named like a label', 'evt_next has seen 2024-02-01', 'unknown has seen None']) error")
def window_validity(spark, sf_dir):
    columns = {"evt_20d": "2024-01-20", "label_rate": "2024-01-02", "evt_next": "2024-02-01", "unknown": None}
    return spark.createDataFrame([(e,) for e in protocol.window_errors(columns, "2024-01-20")], "error string")


@query("""SELECT 'sum_price' AS "column", count(*) compared, 0::BIGINT only_old, 0::BIGINT only_new, count(*) FILTER (o_custkey % 10 = 0) apart, max(CASE WHEN o_custkey % 10 = 0 THEN 1.0 ELSE 0.0 END)::DOUBLE largest FROM (SELECT o_custkey FROM orders GROUP BY 1)
UNION ALL SELECT 'orders', count(*), 0, 0, 0, 0.0::DOUBLE FROM (SELECT o_custkey FROM orders GROUP BY 1)""")
def recomputation(spark, sf_dir):
    """A result against its recomputation, which is off by 1 for every tenth key."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("sum_price"))
    new = o.withColumn("sum_price", F.col("sum_price") + F.when(F.col("o_custkey") % 10 == 0, 1.0).otherwise(0.0))
    return protocol.recomputed(o, new, ["o_custkey"], ["orders", "sum_price"], 1e-6).withColumn("largest", F.round("largest", 6))


@query("""SELECT * FROM (VALUES ('good', ''), ('out of range', 'probability out of range'), ('missing', 'missing probability'), ('repeated', 'repeated id'), ('label', 'label'), ('one class', 'a single class')) t("case", refused)""")
def negative_tests(spark, sf_dir):
    """Faulty predictions that the checker must refuse, and good ones that it must not."""
    d = scored(spark, sf_dir).select("doc_id", "p", "y")
    first = d.agg(F.min("doc_id").alias("first"))
    d = d.join(F.broadcast(first))  # one row
    here = F.col("doc_id") == F.col("first")
    cases = {"good": d, "out of range": d.withColumn("p", F.when(here, 1.5).otherwise(F.col("p"))), "missing": d.withColumn("p", F.when(~here, F.col("p"))), "repeated": d.unionAll(d.filter(here)), "label": d.withColumn("y", F.when(here, 2).otherwise(F.col("y"))), "one class": d.withColumn("y", F.lit(0))}
    return spark.createDataFrame([(name, ";".join(protocol.prediction_errors(df, "doc_id", "p", "y"))) for name, df in cases.items()], "case string, refused string")


@query(_D + f"""SELECT round((a + b + c) / 3, 5) "mean", round(sqrt(((a - (a+b+c)/3)**2 + (b - (a+b+c)/3)**2 + (c - (a+b+c)/3)**2) / 3), 5) std, round(greatest(a, b, c) - least(a, b, c), 5) "range" FROM (SELECT {_AUC.format(s='p', t='(SELECT * FROM d WHERE doc_id % 3 <> 0)')} a, {_AUC.format(s='p', t='(SELECT * FROM d WHERE doc_id % 3 <> 1)')} b, {_AUC.format(s='p', t='(SELECT * FROM d WHERE doc_id % 3 <> 2)')} c)""")
def seed_jitter(spark, sf_dir):
    """The spread of a metric over seeds; a seed here leaves out one third of the rows."""
    d = scored(spark, sf_dir)
    j = protocol.jitter(lambda seed: evaluation.auc(d.filter(F.col("doc_id") % 3 != seed), "p", "y").first().auc, range(3))
    return spark.createDataFrame([tuple(round(j[k], 5) for k in ("mean", "std", "range"))], "mean double, std double, range double")


@query()
def cluster_drivers(spark, sf_dir):
    """The ten features that move each cluster's centre most."""
    e = models.to_vector(table(spark, sf_dir, "embeddings"), "embedding", "raw")
    scaled = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(e).transform(e)
    fitted = KMeans(k=3, seed=42).fit(scaled)
    return spark.createDataFrame(models.cluster_drivers(fitted, [f"x{i}" for i in range(len(fitted.clusterCenters()[0]))]), "cluster int, rank int, feature string, centre double")


@query()
def full_fit(spark, sf_dir):
    """Members fitted to all labelled rows for several seeds, fused by weighted logits."""
    d = scored(spark, sf_dir).withColumnRenamed("p", "p1")
    out = models.full_fit(d, d.select("doc_id", "p1", "p2"), ["p1", "p2"], "y", {"linear": "logistic", "trees": "forest"}, {"linear": 0.6, "trees": 0.4}, seeds=(42, 7))
    return out.select("doc_id", r6("p").alias("p"))


@query()
def model_sink(spark, sf_dir):
    """A fitted model saved and loaded again gives the same clusters."""
    from pyspark.ml.clustering import KMeansModel

    e = models.to_vector(table(spark, sf_dir, "embeddings"), "embedding")
    fitted, path = KMeans(k=3, seed=42).fit(e), shared_path(spark, "model")
    models.save_model(fitted, path)
    both = KMeansModel.load(path).setPredictionCol("again").transform(fitted.transform(e))
    return both.agg(F.count("*").alias("n"), F.count_if(F.col("prediction") != F.col("again")).alias("differ"))


@query()
def distillation_fidelity(spark, sf_dir):
    """A non-negative ridge fitted out of fold to a teacher's score, and how well it stands for it."""
    d = scored(spark, sf_dir).withColumn("fold", (F.col("doc_id") % 3).cast("int")).withColumn("teacher", 0.7 * F.col("p") + 0.3 * F.col("p2"))
    out = models.cross_fit(d, ["p", "p2"], "teacher", "fold", [0, 1, 2])
    return models.fidelity(out, "distilled", "teacher").select(*(F.round(c, 4).alias(c) for c in ("pearson", "distance", "penalty_mae", "same_side")))


@query()
def curve_fidelity(spark, sf_dir):
    """The same over monotone curves of the features, each fitted out of fold with the ridge."""
    d = scored(spark, sf_dir).withColumn("fold", (F.col("doc_id") % 3).cast("int")).withColumn("teacher", F.sqrt("p") * 0.7 + 0.3 * F.col("p2"))
    out = models.cross_fit(d, ["p", "p2"], "teacher", "fold", [0, 1, 2], bins=8)
    return models.fidelity(out, "distilled", "teacher").select(*(F.round(c, 4).alias(c) for c in ("pearson", "distance", "penalty_mae", "same_side")))


@query()
def model_jitter(spark, sf_dir):
    """The spread of the out-of-fold AUC over a model's own seeds, and whether the difference to another score is more than three times it."""
    d = scored(spark, sf_dir).withColumn("fold", (F.col("doc_id") % 2).cast("int")).withColumnRenamed("p", "p1")
    at = lambda seed: evaluation.auc(models.out_of_fold(d, ["p1", "p2"], "y", "fold", [0, 1], "forest", seed), "p", "y").first().auc
    j = protocol.jitter(at, (42, 7, 2024))
    other = evaluation.auc(d, "p1", "y").first().auc
    return spark.createDataFrame([(*(round(j[k], 5) for k in ("mean", "std", "range")), round(other, 5), abs(j["mean"] - other) > 3 * j["range"])], "mean double, std double, range double, other double, apart boolean")


@query()
def platt_calibration(spark, sf_dir):
    """Scores by fold through a logistic fit of the other folds, and by group shrunk to the whole."""
    d = scored(spark, sf_dir).withColumn("fold", (F.col("doc_id") % 2).cast("int"))
    out = None
    for f in (0, 1):
        slope, intercept = models.platt(d.filter(F.col("fold") != f), "p", "y")
        part = d.filter(F.col("fold") == f).withColumn("platt", 1 / (1 + F.exp(-(slope * logit(F.col("p")) + intercept))))
        out = part if out is None else out.unionByName(part)
    out = models.group_calibration(out, "platt", "y", "source")
    return out.select("doc_id", "fold", r6(clip(F.col("platt"), 0.0, 1.0)).alias("platt"), r6("calibrated").alias("calibrated"))


@query("""SELECT 'a' term, 1.0::DOUBLE weight UNION ALL SELECT 'intercept', 0.0::DOUBLE""")
def ridge_identity(spark, sf_dir):
    """A column explained by itself and by its negative: all weight on the first, none on the second."""
    d = table(spark, sf_dir, "customer").select(F.col("c_acctbal").alias("a"), F.col("c_acctbal").alias("y"))
    w = nonnegative_ridge(d, ["a"], "y", penalty=0.0)
    return spark.createDataFrame([("a", round(w[0], 6)), ("intercept", round(w[1], 4) + 0.0)], "term string, weight double")


@query("""SELECT unnest(['evt_20d', 'evt_active', 'evt_all', 'orders_sum', 'clicks']) AS "column", unnest(['past', 'past', 'events', 'orders', 'none']) source, unnest([
 (SELECT max(ts)::DATE FROM events WHERE ts < TIMESTAMP '2024-01-21'), (SELECT max(ts)::DATE FROM events WHERE ts < TIMESTAMP '2024-01-21'), (SELECT max(ts)::DATE FROM events), (SELECT max(o_orderdate)::DATE FROM orders), NULL]) AS "until",
 unnest([(SELECT max(ts)::DATE FROM events WHERE ts < TIMESTAMP '2024-01-21') < DATE '2024-01-21', (SELECT max(ts)::DATE FROM events WHERE ts < TIMESTAMP '2024-01-21') < DATE '2024-01-21', (SELECT max(ts)::DATE FROM events) < DATE '2024-01-21', (SELECT max(o_orderdate)::DATE FROM orders) < DATE '2024-01-21', false]) visible""")
def column_visibility(spark, sf_dir):
    """Columns made from the events before a day, from all events, from orders and from nothing: which may be used on the day."""
    ev, orders = table(spark, sf_dir, "events"), table(spark, sf_dir, "orders")
    past = ev.filter("ts < '2024-01-21'")
    return protocol.data_visibility({"past": (past, "ts", ["evt_20d", "evt_active"]), "events": (ev, "ts", ["evt_all"]), "orders": (orders, "o_orderdate", ["orders_sum"]), "none": (ev.filter("event_type = 'never'"), "ts", ["clicks"])}, "2024-01-21")


@query("""
WITH c AS (SELECT 'error_20d' AS "column", ts FROM events WHERE event_type = 'error' AND ts < TIMESTAMP '2024-01-21' AND ts >= TIMESTAMP '2024-01-01' UNION ALL SELECT 'error_30d', ts FROM events WHERE event_type = 'error' AND ts < TIMESTAMP '2024-01-31' UNION ALL SELECT 'label_rate', ts FROM events WHERE ts < TIMESTAMP '2024-01-05'),
n AS (SELECT unnest(['error_20d', 'error_30d', 'label_rate', 'never']) AS "column"), g AS (SELECT n."column", count(ts) "rows", min(ts) f, max(ts) l FROM n LEFT JOIN c USING ("column") GROUP BY 1)
SELECT "column", "rows", f::DATE AS "first", l::DATE AS "last", CASE WHEN "column" = 'label_rate' THEN 'named like a label' WHEN "rows" = 0 THEN 'made of nothing' WHEN l >= TIMESTAMP '2024-01-21' THEN 'a row from the label''s time' END error FROM g""")
def column_evidence(spark, sf_dir):
    """The rows that candidate columns are made of, and why some may not be used."""
    error, ts = F.col("event_type") == "error", F.col("ts")
    columns = {"error_20d": error & (ts < "2024-01-21") & (ts >= "2024-01-01"), "error_30d": error & (ts < "2024-01-31"), "label_rate": ts < "2024-01-05", "never": F.col("event_type") == "never"}
    return protocol.window_evidence(table(spark, sf_dir, "events"), "ts", columns, "2024-01-21")


@query("""
WITH m AS (SELECT o_custkey, min(o_orderdate)::DATE f0, max(o_orderdate)::DATE l1, DATE '1996-01-01' cut, min(o_orderdate)::DATE + (o_custkey % 700)::INTEGER f1, CASE WHEN o_custkey % 3 = 0 THEN '' ELSE 'v1' END v, count(*) - 5 n, o_custkey % 11 = 0 leak FROM orders GROUP BY 1)
SELECT unnest(['feature window before as_of', 'label window after as_of', 'label version', 'split version', 'target count', 'no label in features', 'no test in the fit']) AS "rule",
 unnest([count(*) FILTER (NOT (f0 < f1 AND f1 <= cut)), count(*) FILTER (NOT (cut < l1)), count(*) FILTER (v = ''), 0, count(*) FILTER (n <= 0), count(*) FILTER (leak), 0]) violations FROM m""")
def protocol_manifests(spark, sf_dir):
    """A manifest for each customer's orders: how many break which rule."""
    first, key = F.to_date(F.min("o_orderdate")), F.col("o_custkey")
    m = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(first.alias("feature_from"), F.to_date(F.max("o_orderdate")).alias("label_to"), F.count("*").alias("orders"))
    at = F.lit("1996-01-01").cast("date")
    m = m.withColumns({"feature_to": F.date_add("feature_from", (key % 700).cast("int")), "as_of": at, "label_from": at, "label_version": F.when(key % 3 == 0, "").otherwise("v1"), "split_version": F.lit("s1"), "target_count": F.col("orders") - 5, "label_used_in_features": key % 11 == 0, "test_used_in_fit": F.lit(False)})
    return protocol.manifest_faults(m)


@query("""SELECT unnest(['keys','keys','slim','facts','facts','slim']) AS "view", unnest(['o_orderkey','o_custkey','o_orderstatus','o_totalprice','o_orderdate','o_orderpriority']) AS "column",
 unnest([count(o_orderkey), count(o_custkey), count(o_orderstatus), count(o_totalprice), count(o_orderdate), count(o_orderpriority)]) present, unnest([count(DISTINCT o_orderkey), count(DISTINCT o_custkey), count(DISTINCT o_orderstatus), count(DISTINCT o_totalprice), count(DISTINCT o_orderdate), count(DISTINCT o_orderpriority)]) "different" FROM orders""")
def view_contents(spark, sf_dir):
    """What each view of the orders' columns holds."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    return protocol.view_contents(o, {"keys": "key$", "facts": "date|price"})


_DRAWN = "('0x' || substr(md5('42:{c}:' || c_custkey::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE * 20"


@query(f"""
WITH q AS (SELECT quantile_cont(c_acctbal::DOUBLE, [{', '.join(repr(i / 20) for i in range(21))}]) a, quantile_cont(c_nationkey::DOUBLE, [{', '.join(repr(i / 20) for i in range(21))}]) n FROM customer), u AS (SELECT c_custkey, {_DRAWN.format(c='c_acctbal')} x, {_DRAWN.format(c='c_nationkey')} y FROM customer)
SELECT c_custkey, round(a[floor(x)::INT + 1] + (x - floor(x)) * (a[floor(x)::INT + 2] - a[floor(x)::INT + 1]), 6) c_acctbal, round(n[floor(y)::INT + 1] + (y - floor(y)) * (n[floor(y)::INT + 2] - n[floor(y)::INT + 1]), 6) c_nationkey FROM u, q""")
def synthetic_customers(spark, sf_dir):
    """A made-up row for each customer, with balances and nations as they are distributed."""
    made = protocol.synthetic_like(table(spark, sf_dir, "customer"), "c_custkey", ["c_acctbal", "c_nationkey"])
    return made.select("c_custkey", r6("c_acctbal").alias("c_acctbal"), r6("c_nationkey").alias("c_nationkey"))
