"""The event contract: codes with chain, group, role and denominator, and checks of tables against it."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import ratio
from ..sources.files import ContractError

#: Event code, semantic group, chain ('' for none), role, denominator.
CODES = [
    ("11401", "speed", "", "behaviour", "junction passes"),
    ("11402", "speed", "", "behaviour", "bend passes"),
    ("11403", "speed", "", "behaviour", "dangerous section passes"),
    ("11405", "speed", "", "behaviour", "ramp passes"),
    ("11406", "speed", "", "behaviour", "long descent passes"),
    ("11803", "space", "", "outcome", "observed days"),
    ("11804", "space", "", "outcome", "observed days"),
    ("30000", "space", "space", "warning", "driving hours or km"),
    ("30002", "lane", "lane", "behaviour", "lane-observed km"),
    ("30003", "lane", "lane", "behaviour", "lane-observed km"),
    ("30005", "space", "space", "behaviour", "following hours"),
    ("30017", "lane", "lane", "behaviour", "lane-observed km"),
    ("41001", "fatigue", "fatigue", "behaviour", "camera hours"),
    ("41002", "fatigue", "fatigue", "behaviour", "camera hours"),
    ("41003", "distraction", "distraction", "behaviour", "camera hours"),
    ("41004", "distraction", "distraction", "behaviour", "camera hours"),
    ("41005", "distraction", "distraction", "behaviour", "camera hours"),
    ("41006", "device", "device", "evidence", "planned hours"),
    ("41009", "distraction", "distraction", "behaviour", "camera hours"),
    ("41021", "device", "device", "evidence", "planned hours"),
    ("41023", "distraction", "distraction", "behaviour", "camera hours"),
    ("41029", "fatigue", "fatigue", "behaviour", "camera hours"),
    ("60292", "space", "space", "warning", "observed lane changes"),
    ("60294", "space", "space", "warning", "observed lane changes"),
]
#: Merge windows of the chains in seconds; speed events merge by code.
MERGE_S = {"fatigue": 120, "distraction": 120, "lane": 120, "space": 120, "device": 600}
SPEED_MERGE_S = 60


def contract(spark: SparkSession) -> DataFrame:
    rows = [(c, g, chain or (f"speed:{c}" if g == "speed" else g), MERGE_S.get(chain, SPEED_MERGE_S), role, d) for c, g, chain, role, d in CODES]
    return spark.createDataFrame(rows, "code string, semantic_group string, chain string, merge_s long, role string, denominator string")


def load_contract(spark: SparkSession, text: str) -> DataFrame:
    """A contract from JSON, in the columns of ``contract``: ``event_mappings`` (code, semantic_group, scoring_role, exposure_denominator)
    and ``risk_chains`` (id, merge_window_seconds, codes). A code outside all chains merges by its own within
    ``SPEED_MERGE_S`` in the group 'speed', by group else. Repeated codes and chains of unknown codes are refused."""
    raw = json.loads(text)
    if missing := [k for k in ("event_mappings", "risk_chains") if k not in raw]:
        raise ContractError(f"the contract has no {missing}")
    codes = [str(m["code"]) for m in raw["event_mappings"]]
    if twice := sorted({c for c in codes if codes.count(c) > 1}):
        raise ContractError(f"codes listed twice: {twice}")
    chains = {str(c): (x["id"], int(x["merge_window_seconds"])) for x in raw["risk_chains"] for c in x["codes"]}
    if unknown := sorted(set(chains) - set(codes)):
        raise ContractError(f"chains of unknown codes: {unknown}")
    rows = []
    for m in raw["event_mappings"]:
        code, group = str(m["code"]), m["semantic_group"]
        chain, window = chains.get(code, (f"speed:{code}" if group == "speed" else group, SPEED_MERGE_S))
        rows.append((code, group, chain, window, m["scoring_role"], m["exposure_denominator"]))
    return spark.createDataFrame(rows, "code string, semantic_group string, chain string, merge_s long, role string, denominator string")


def violations(table: DataFrame, code: str = "code", known: list[str] | None = None) -> DataFrame:
    """(problem, n) of a contract table: repeated codes, codes missing from it and unknown ones."""
    known = known or [c for c, *_ in CODES]
    return table.agg(
        (F.count("*") - F.count_distinct(code)).alias("repeated"),
        (F.lit(len(known)) - F.count_distinct(F.when(F.col(code).isin(*known), F.col(code)))).alias("missing"),
        F.count_if(~F.coalesce(F.col(code).isin(*known), F.lit(False))).alias("unknown"),
    ).select(F.inline(F.array(*(F.struct(F.lit(p).alias("problem"), F.col(p).alias("n")) for p in ("repeated", "missing", "unknown")))))


#: Name rules by family, the first match counts: the column dictionary follows from a column's name.
FAMILIES = [("score", r"^score_"), ("rate", r"_per_\d+\w*$"), ("window", r"_\d+d$"), ("share", r"_share$"), ("flag", r"^(is|never|low)_"), ("day", r"^days_")]


def column_dictionary(df: DataFrame) -> list[tuple[str, str, str]]:
    """(column, family, type) of every column; a name that no rule knows is 'other'."""
    return [(f.name, next((n for n, p in FAMILIES if re.search(p, f.name)), "other"), f.dataType.simpleString()) for f in df.schema.fields]


def run_duration_kind(df: DataFrame, key: str, seconds: str, duration: str, tie: str, gap_s: int = 180 * 60, tolerance_s: float = 1.0, share: float = 0.2, near_zero_s: float = 60.0) -> DataFrame:
    """'trip' for keys whose duration field counts within trips: it resets, each restart is small beside
    its trip's end, and every long gap comes with a reset; else 'gap'."""
    w = Window.partitionBy(key).orderBy(seconds, tie)
    d = df.filter(F.col(seconds).isNotNull()).withColumns({"__reset": F.coalesce(F.col(duration) - F.lag(duration).over(w) < -tolerance_s, F.lit(False)), "__long": F.coalesce(F.col(seconds) - F.lag(seconds).over(w) > gap_s, F.lit(False))})
    d = d.withColumn("__trip", F.sum(F.col("__reset").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    trips = d.groupBy(key, "__trip").agg(F.min_by(duration, F.struct(seconds, tie)).alias("first"), F.max_by(duration, F.struct(seconds, tie)).alias("last"), F.count_if(F.col(duration).isNull()).alias("missing"), F.count_if(F.col("__long") & ~F.col("__reset")).alias("unreset"))
    bad = (F.col("__trip") > 0) & (F.col("first") > share * F.col("last") + near_zero_s)
    ok = (F.max("__trip") > 0) & (F.count_if(bad) == 0) & (F.sum("missing") == 0) & (F.sum("unreset") == 0)
    return trips.groupBy(key).agg(F.when(ok, "trip").otherwise("gap").alias("kind"), (F.count("*")).alias("trips"))


def weighted_rollup(days: DataFrame, by: list[str], weight: str, means: list[str], sums: list[str]) -> DataFrame:
    """Partial day rows of one key together: weighted means and sums."""
    return days.groupBy(*by).agg(F.sum(weight).alias(weight), *(ratio(F.sum(F.col(m) * F.col(weight)), F.sum(weight)).alias(m) for m in means), *(F.sum(s).alias(s) for s in sums))


def gate(value: Column, least: float) -> Column:
    return F.coalesce(value >= least, F.lit(False))


#: The least gains and the tolerances of an adoption, and of a candidate.
ADOPT = {"auc": 0.005, "brier_gain": 0.005, "recall": 0.02, "brier": 0.005}


def adopted(auc: Column, brier_gain: Column, recall: Column, limits: dict[str, float] = ADOPT, check_brier: bool = True) -> Column:
    """Whether gains (AUC, Brier score as old minus new, top recall) suffice: AUC by its least gain, or by any with a
    clear gain in Brier score; recall and Brier score must not lose more than their tolerances. Null is no gain."""
    ok = ((auc >= limits["auc"]) | ((auc > 0) & (brier_gain >= limits["brier_gain"]))) & (recall >= -limits["recall"])
    return F.coalesce(ok & (brier_gain >= -limits["brier"]) if check_brier else ok, F.lit(False))


def candidate_gates(auc: Column, auc_low: Column, recall: Column, brier: Column, limits: dict[str, float] = ADOPT, least_low: float = 0.01) -> dict[str, Column]:
    """Gates of a candidate by its differences from a reference and the lower bound of that of the AUC."""
    gates = {"auc_positive": auc > 0, "interval_above_zero": auc_low > 0, "bound_meaningful": auc_low >= least_low, "recall_kept": recall >= -limits["recall"], "brier_kept": brier <= limits["brier"]}
    return {k: F.coalesce(v, F.lit(False)) for k, v in gates.items()}


def review_errors(df: DataFrame, reviewer: str, case: str, kind: str, questions: list[str], reviewers: int, cases: int, quotas: dict[str, int], least_mean: float = 4.0, least: float = 3.0) -> DataFrame:
    """(rule, violations) of a review table, a row for each reviewer and case with ratings from 1 to 5: ids, repeated
    pairs, counts, completeness, kinds and their quotas, ratings out of range, the mean and the least rating."""
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (reviewer, case, kind)]
    src = df.select(named[0].alias("r"), named[1].alias("c"), named[2].alias("k"), F.array(*(F.col(q).cast("double") for q in questions)).alias("q"))
    good = F.filter("q", lambda x: x.isNotNull() & x.between(1, 5))
    flat = src.select("*", F.size(good).alias("fit"), F.aggregate(good, F.lit(0.0), lambda s, x: s + x).alias("sum"), F.array_min(good).alias("low"))
    pairs = flat.groupBy("r", "c").agg(F.count("*").alias("n"), F.sum("fit").alias("fit"), F.sum("sum").alias("sum"), F.min("low").alias("low"))
    whole = pairs.agg(F.count_if((F.col("r") == "") | (F.col("c") == "")).alias("empty_id"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated_pair"), F.count_distinct("r").alias("nr"), F.count_distinct("c").alias("nc"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum("fit"), F.lit(0)).alias("fit"), F.sum("sum").alias("sum"), F.min("low").alias("low"))
    kinds = flat.select("c", "k").distinct()
    expected = F.create_map(*(F.lit(x) for pair in quotas.items() for x in pair))
    by_case = kinds.groupBy("c").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("mixed_kind"))
    by_kind = kinds.groupBy("k").agg(F.count_distinct("c").alias("n")).withColumn("want", F.try_element_at(expected, F.col("k")))
    quota = by_kind.agg(F.count_if(F.col("want").isNull()).alias("unknown_kind"), (F.lit(len(quotas)) - F.count_if(F.col("n") == F.col("want"))).alias("quota"))
    one = whole.join(F.broadcast(by_case)).join(F.broadcast(quota))  # one row each
    bad = lambda c: F.coalesce(c, F.lit(True)).cast("long")
    rules = {"empty_id": F.col("empty_id"), "repeated_pair": F.col("repeated_pair"), "reviewers": bad(F.col("nr") != reviewers), "cases": bad(F.col("nc") != cases), "incomplete": bad(F.col("rows") != reviewers * cases), "mixed_kind": F.col("mixed_kind"), "unknown_kind": F.col("unknown_kind"), "quota": F.col("quota"),
             "rating": F.col("rows") * len(questions) - F.col("fit"), "mean": bad(ratio(F.col("sum"), F.col("fit")) < least_mean), "least": bad(F.col("low") < least)}
    return one.select(F.inline(F.array(*(F.struct(F.lit(k).alias("rule"), v.cast("long").alias("violations")) for k, v in rules.items()))))
