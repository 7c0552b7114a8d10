"""Structured Streaming forms of the event operators.

Each takes a streaming DataFrame with a ``ts`` timestamp; ``run`` processes what is there (availableNow)
with its checkpoint and results in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.shared import path as shared_path

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, files_per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("pathGlobFilter", "events*.parquet").option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def daily_counts(s: DataFrame) -> DataFrame:
    w = s.withWatermark("ts", "3 days").groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return w.select(F.to_date("window.start").alias("day"), "event_type", "n", "value")


def sliding_counts(s: DataFrame, length: str = "20 days", step: str = "1 day") -> DataFrame:
    w = s.withWatermark("ts", "3 days").groupBy(F.window("ts", length, step), "event_type").agg(F.count("*").alias("n"))
    return w.select(F.to_date("window.end").alias("as_of"), "event_type", "n")


def sessions(s: DataFrame, gaps: dict[str, str], default: str = "6 hours") -> DataFrame:
    """Chains by (user, type) whose gap depends on the type."""
    gap = F.lit(default)
    for kind, g in gaps.items():
        gap = F.when(F.col("event_type") == kind, g).otherwise(gap)
    w = s.withWatermark("ts", "3 days").groupBy(F.session_window("ts", gap), "user_id", "event_type").agg(F.count("*").alias("n"))
    return w.select("user_id", "event_type", F.col("session_window.start").alias("start"), "n")


def without_duplicates(s: DataFrame) -> DataFrame:
    return s.withWatermark("ts", "3 days").dropDuplicatesWithinWatermark(["user_id", "event_type", "ts", "value"])


def scores(s: DataFrame, decay: float = 0.9, prior: float = 80.0, k: float = 10.0) -> DataFrame:
    """A running score by user: errors add decayed risk, exposure moves it from the prior; state is three numbers."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        risk, seen = state.get if state.exists else (0.0, 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for kind in rows["event_type"]:
            risk, seen = decay * risk + (kind == "error"), seen + 1
        state.update((risk, seen))
        trust = seen / (seen + k)
        yield pd.DataFrame({"user_id": [key[0]], "events": [seen], "score": [trust * max(0.0, 100 - 5 * risk) + (1 - trust) * prior]})

    return s.groupBy("user_id").applyInPandasWithState(update, "user_id long, events long, score double", "risk double, seen long", "update", GroupStateTimeout.NoTimeout)


#: Open evidence as it is held: event, whether its id is null, deadline, whether it is decided.
_OPEN = np.dtype([("id", "i8"), ("null", "?"), ("at", "i8"), ("over", "?")])


def evidence(s: DataFrame, deadline_days: int = 3, buckets: int = 4096) -> DataFrame:
    """Review states as they come, (event_id, ts, status) rows -> (event_id, resolved, included) when evidence is decided.

    'valid' and 'exempt' decide at once; pending evidence is held until the watermark is ``deadline_days`` past its
    time and then counts. A decision after the deadline is too late and changes nothing. State is kept by hash of the event, in
    ``buckets`` values that hold what is within its deadline, so that Python is called once for each bucket and batch.
    """
    wait = deadline_days * 86_400_000

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame(np.frombuffer(state.get[0], _OPEN) if state.exists else np.empty(0, _OPEN)).set_index(["id", "null"])
        now = state.getCurrentWatermarkMs()
        rows = [] if state.hasTimedOut else list(batches)
        if rows:
            pdf = pd.concat(rows).sort_values("ts", kind="stable")
            pdf["ms"] = pdf["ts"].astype("datetime64[ns]").astype("int64") // 1_000_000
            pdf["final"] = pdf["status"].where(pdf["status"].isin(["valid", "exempt"]))
            seen = pdf.groupby(["id", "null"]).agg(first=("ms", "first"), last=("ms", "last"), final=("final", "first"))
            met = seen.join(held)
        else:
            met = pd.DataFrame({"first": [], "last": [], "final": [], "at": [], "over": []}, index=held.index[:0])
        old = met["at"].notna().to_numpy()
        at = met["at"].where(old, met["first"] + wait).astype("int64").to_numpy()
        over, passed, final = met["over"].eq(True).to_numpy(), at <= now, met["final"].notna().to_numpy()
        decide = ~over & final & ~(old & passed)  # pending evidence whose deadline passes before this batch has counted already
        late = ~over & ~decide & passed
        rest = held[~held.index.isin(met.index)]
        due = (rest["at"] <= now).to_numpy()
        silent = rest.index[due & ~rest["over"].to_numpy()]
        resolved = np.concatenate([np.where(decide, met["final"], "auto_valid_after_deadline")[decide | late], np.full(len(silent), "auto_valid_after_deadline", object)])
        ids = [*met.index[decide | late], *silent]
        # decided again by nothing that comes within another deadline
        met = pd.DataFrame({"at": np.where(passed, met["last"].astype("int64") + wait, at), "over": over | decide | late}, index=met.index)
        left = pd.concat([rest[~due], met[(met["at"] > now).to_numpy()]])
        if len(left):
            made = np.empty(len(left), _OPEN)
            made["id"], made["null"] = left.index.get_level_values(0), left.index.get_level_values(1)
            made["at"], made["over"] = left["at"], left["over"].astype(bool)
            state.update((made.tobytes(),))
            state.setTimeoutTimestamp(int(made["at"].min()))
        elif state.exists:
            state.remove()
        if ids:
            yield pd.DataFrame({"event_id": pd.array([None if null else i for i, null in ids], "Int64"), "resolved": resolved, "included": resolved != "exempt"})

    w = s.withWatermark("ts", "1 hour").select(F.pmod(F.xxhash64("event_id"), F.lit(buckets)).alias("bucket"), F.coalesce(F.col("event_id").cast("long"), F.lit(0)).alias("id"), F.col("event_id").isNull().alias("null"), "ts", "status")
    return w.groupBy("bucket").applyInPandasWithState(update, "event_id long, resolved string, included boolean", "open binary", "update", GroupStateTimeout.EventTimeTimeout)


def doors(s: DataFrame, leave: float = 0.45, again: float = 0.55, gate: float = 0.6, start: float = 0.5) -> DataFrame:
    """Hysteresis state by user over (user_id, ts, x, teacher) rows: (user_id, state) after each batch.

    'in' at first where the teacher is over ``gate`` and x at least ``start``, else 'off' for good; 'out' under ``leave``,
    'in' again over ``again`` under an open gate. Rows that come after a later one of their user are not counted.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, last = state.get if state.exists else (None, -1)
        for at, x, teacher in pd.concat(list(batches)).sort_values("ts")[["ts", "x", "teacher"]].itertuples(index=False, name=None):
            if (at := int(at.timestamp() * 1000)) < last:
                continue
            last = at
            if now is None:
                now = "in" if teacher > gate and x >= start else "off"
            elif now == "in" and x < leave:
                now = "out"
            elif now == "out" and x > again and teacher > gate:
                now = "in"
        state.update((now, last))
        yield pd.DataFrame({"user_id": [key[0]], "state": [now]})

    return s.select("user_id", "ts", "x", "teacher").groupBy("user_id").applyInPandasWithState(update, "user_id long, state string", "now string, last long", "update", GroupStateTimeout.NoTimeout)


def run(out: DataFrame, mode: str, keys: list[str] | None = None) -> DataFrame:
    """Process all available input; the table that results: of 'complete' the last state, of others every row, or with
    ``keys`` each key's last one. Only 'complete' keeps all state for ever; 'update' and 'append' drop what the watermark passes."""
    spark = out.sparkSession
    result, state = shared_path(spark, "stream"), shared_path(spark, "stream-state")

    def keep(batch: DataFrame, number: int) -> None:
        folder = result if mode == "complete" else f"{result}/batch={number}"
        batch.write.mode("overwrite").parquet(folder)

    out.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    found = spark.read.schema(out.schema if mode == "complete" else T.StructType([*out.schema.fields, T.StructField("batch", T.LongType())])).parquet(result)
    if keys:
        rest = [c for c in out.columns if c not in keys]
        return found.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("__last")).select(*keys, *(F.col(f"__last.{c}").alias(c) for c in rest)).select(*out.columns)
    return found.select(*out.columns)
