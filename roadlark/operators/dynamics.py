"""Dynamic scores: evidence with a review deadline, decayed risk, shrinking, freezing and capped recovery."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ratio, time_band
from ..sources.files import ContractError


@dataclass(frozen=True)
class Policy:
    """What a score history depends on; the coefficients weigh a time band's points."""

    half_life: float = 7.0
    pending_days: int = 3
    window_days: int = 7
    step: float = 0.1
    cap: float = 1.5
    prior: float = 80.0
    prior_strength: float = 10.0
    least_exposure: float = 5.0
    recovery: float = 2.0
    coefficients: dict[str, float] = field(default_factory=lambda: {"night": 1.2, "morning": 1.1, "day": 1.0, "dusk": 1.1})


def resolve_evidence(events: DataFrame, as_of: str, policy: Policy) -> DataFrame:
    """Events (ts, points, status) with ``band``, ``resolved``, ``included`` and ``adjusted`` points.

    Pending evidence counts once it is ``pending_days`` old; exempt never does.
    """
    age = F.date_diff(F.lit(as_of).cast("date"), F.to_date("ts"))
    resolved = (F.when(F.col("status") == "exempt", "exempt").when(F.col("status") != "pending", "valid")
                .when(age < policy.pending_days, "pending").otherwise("auto_valid_after_deadline"))
    out = events.withColumns({"band": time_band(F.col("ts")), "resolved": resolved})
    out = out.withColumn("included", F.col("resolved").isin("valid", "auto_valid_after_deadline"))
    weight = F.coalesce(*(F.when(F.col("band") == k, F.lit(v)) for k, v in policy.coefficients.items()))
    return out.withColumn("adjusted", F.when(F.col("included"), F.col("points") * weight).otherwise(0.0))


def violations(days: DataFrame, evidence: DataFrame, key: str, as_of: str) -> DataFrame:
    """(rule, n) of what makes a history impossible: every n must be 0."""
    end = F.lit(as_of).cast("date")
    parts = {
        "repeated_day": days.groupBy(key, "day").count().filter("count > 1"),
        "repeated_event": evidence.groupBy("event_id").count().filter("count > 1"),
        "unknown_status": evidence.filter(~F.col("status").isin("valid", "pending", "exempt") | F.col("status").isNull()),
        "day_after_as_of": days.filter(F.col("day") > end),
        "event_after_as_of": evidence.filter(F.to_date("ts") > end),
        "event_without_day": evidence.select(key, F.to_date("ts").alias("day")).distinct().join(days.select(key, "day"), [key, "day"], "left_anti"),
        "risk_without_exposure": evidence.filter("adjusted > 0").groupBy(key, F.to_date("ts").alias("day")).agg(F.sum("adjusted").alias("x")).join(days.filter("exposure = 0").select(key, "day"), [key, "day"], "left_semi"),
    }
    out = None
    for rule, bad in parts.items():
        n = bad.agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "n")
        out = n if out is None else out.unionByName(n)
    return out


def daily_risk(days: DataFrame, evidence: DataFrame, key: str, policy: Policy) -> DataFrame:
    """Each day with its points, the multiplier of repeated risk days and cumulative exposure: windows over calendar days."""
    base = evidence.groupBy(key, F.to_date("ts").alias("day")).agg(F.sum("adjusted").alias("base"))
    d = days.select(key, "day", "exposure").join(base, [key, "day"], "left").withColumns({"base": F.coalesce("base", F.lit(0.0)), "__d": F.unix_date("day")})
    active = ((F.col("exposure") > 0) & (F.col("base") > 0)).cast("int")
    by = Window.partitionBy(key).orderBy("__d")
    d = d.withColumns({"__n": F.sum(active).over(by.rangeBetween(1 - policy.window_days, 0)), "cumulative": F.sum("exposure").over(by.rowsBetween(Window.unboundedPreceding, 0))})
    times = F.when(F.col("exposure") > 0, F.least(F.lit(policy.cap), 1 + policy.step * F.greatest(F.col("__n") - 1, F.lit(0)))).otherwise(1.0)
    d = d.withColumn("multiplier", times)
    return d.withColumn("risk", F.when(F.col("exposure") > 0, F.least(F.lit(100.0), F.col("base") * F.col("multiplier"))).otherwise(0.0)).drop("__n", "__d")


def score_history(starts: DataFrame, days: DataFrame, events: DataFrame, key: str, as_of: str, policy: Policy = Policy(), check: bool = True) -> DataFrame:
    """Published scores of every day: (key, day, exposure, cumulative, base, multiplier, risk, ewma, raw, score, change, status).

    ``starts`` has (key, initial, previous_valid). A day with exposure decays the risk and adds its own, shrinks
    the score to the prior by cumulative exposure, can't rise on a risk day and rises by at most
    ``recovery`` on another; a day without exposure freezes the score, or, as the first of a key whose
    initial score isn't a former valid one, sets it to the prior. Raises ContractError on ``violations``.

    The published score depends on the one before, so sorted partitions are read once with one key's
    state in memory; all else is windows.
    """
    evidence = resolve_evidence(events, as_of, policy)
    if check and (bad := violations(days, evidence, key, as_of).filter("n > 0").collect()):
        raise ContractError("; ".join(f"{r.rule}: {r.n}" for r in bad))
    src = daily_risk(days, evidence, key, policy).join(starts.select(key, "initial", "previous_valid"), key)
    cols = [key, "day", "exposure", "cumulative", "base", "multiplier", "risk", "initial", "previous_valid"]
    decay = 0.5 ** (1 / policy.half_life)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, ewma, score, first = object(), 0.0, 0.0, True
        for pdf in batches:
            out = []
            for who, day, exposure, total, base, times, risk, initial, valid in pdf.itertuples(index=False, name=None):
                if who != now:
                    now, ewma, score, first = who, 0.0, initial, True
                before = score
                if exposure == 0:
                    restart = first and not valid
                    score = raw = policy.prior if restart else score
                    status = "no_exposure_conservative" if restart else "stopped_frozen"
                else:
                    ewma = decay * ewma + risk
                    trust = total / (total + policy.prior_strength)
                    raw = trust * max(0.0, initial - ewma) + (1 - trust) * policy.prior
                    score = min(100.0, max(0.0, raw))
                    score = min(score, before) if risk > 0 else min(score, before + policy.recovery)
                    status = "observed" if total >= policy.least_exposure else "low_exposure"
                first = False
                out.append((who, day, exposure, total, base, times, risk, ewma, raw, score, score - before, status))
            yield pd.DataFrame(out, columns=[*cols[:7], "ewma", "raw", "score", "change", "status"])

    kinds = dict(src.dtypes)
    schema = ", ".join([f"{c} {kinds[c]}" for c in cols[:7]] + [f"{c} double" for c in ("ewma", "raw", "score", "change")] + ["status string"])
    return src.select(*cols).repartition(key).sortWithinPartitions(key, "day").mapInPandas(scan, schema)


def final_scores(starts: DataFrame, history: DataFrame, key: str, policy: Policy = Policy()) -> DataFrame:
    """(key, score, status): the last day's, or for a key without days its former valid score or the prior."""
    last = history.groupBy(key).agg(F.max_by(F.struct("score", "status"), "day").alias("l"))
    none = F.when(F.col("previous_valid"), F.col("initial")).otherwise(policy.prior)
    return starts.join(last, key, "left").select(key, F.coalesce("l.score", none).alias("score"), F.coalesce("l.status", F.lit("no_observation")).alias("status"))


def publish(score: Column, classes: Column, least: int = 3, prior: float = 50.0) -> tuple[Column, Column]:
    """(published score, policy): with fewer than ``least`` event classes of evidence the prior."""
    weak = F.coalesce(classes, F.lit(0)) < least
    return F.when(weak, prior).otherwise(score), F.when(weak, "low_evidence_prior").otherwise("raw_rule_score")


def door(values: Column, teacher: Column, leave: float = 0.45, again: float = 0.55, gate: float = 0.6, start: float = 0.5) -> Column:
    """The state after an array of values: at first 'in' where the teacher is over ``gate`` and the value at least
    ``start``, else 'off' for good; 'in' goes 'out' under ``leave``, 'out' goes 'in' over ``again`` under an open gate."""
    step = lambda s, x: (F.when(s.isNull(), F.when((teacher > gate) & (x >= start), "in").otherwise("off"))
                         .when((s == "in") & (x < leave), "out").when((s == "out") & (x > again) & (teacher > gate), "in").otherwise(s))
    return F.aggregate(values, F.lit(None).cast("string"), step)


def profile_deviation(actual: Column, base: Column, scale: float = 1.0, eps: float = 1e-12) -> Column:
    """(actual * scale - base) / |base|; null where the base is 0 or either is missing."""
    return F.when(F.abs(base) > eps, ratio(actual * scale - base, F.abs(base)))


def direction_free(df: DataFrame, keep: list[str], residual: str, turn: str, long_at: Column, turn_at: Column, collision: float = 1.5, tilt: float = 0.5, rollover: float = 60.0) -> DataFrame:
    """A row for each scenario that a sensor row fulfils without knowing the sensor's directions: (keep, scenario, value)."""
    r, w = F.col(residual), F.col(turn)
    cases = {"long_anom": (r >= long_at, r), "turn_anom": (w >= turn_at, w), "collision": (r >= collision, r), "rollover": ((r >= tilt) & (w >= rollover), w)}
    rows = F.array(*(F.when(c, F.struct(F.lit(name).alias("scenario"), v.cast("double").alias("value"))) for name, (c, v) in cases.items()))
    return df.select(*keep, F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("__s")).select(*keep, "__s.scenario", "__s.value")


def assemble(roster: DataFrame, key: str, families: dict[str, DataFrame], counts: list[str], exposure: str | None = None, per: float = 100.0, least: float = 1.0) -> DataFrame:
    """One row for each of the roster with every family's columns (a clash is prefixed by the family's name);
    with ``exposure`` each of ``counts`` also as a rate, null under the least exposure."""
    out = roster
    for name, f in families.items():
        clash = {c: f"{name}_{c}" for c in f.columns if c != key and c in out.columns}
        out = out.join(f.withColumnsRenamed(clash), key, "left")
    out = out.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in counts})
    if exposure:
        out = out.withColumns({f"{c}_rate": F.when(F.col(exposure) >= least, ratio(F.col(c) * per, F.col(exposure))) for c in counts})
    return out
