"""The dynamic score as a stream: what ``operators.dynamics.score_history`` makes of a table, made as rows arrive.

Rows may come in any order within the lateness of the watermark. A day is held open until its evidence is decided:
``policy.pending_days`` after it an event timer closes it, counts what is still pending, and publishes its score.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.scalars import time_band
from ..operators.dynamics import Policy

DAY_MS = 86_400_000
#: Rows that ``score_stream`` reads: a day's exposure (event_id null), or evidence with points and a review status.
SCHEMA = "user_id long, ts timestamp, exposure double, event_id long, points double, status string"
_STATE = (
    "initial double, previous_valid boolean, first boolean, ewma double, score double, total double, closed long, active array<long>, "
    "days array<long>, exposures array<double>, event_ids array<long>, event_days array<long>, points array<double>, statuses array<string>"
)


class DailyScore(StatefulProcessor):
    """A key's open days and evidence, its risk and its last score, in one value."""

    def __init__(self, policy: Policy, idle_days: int):
        self.policy, self.idle_days = policy, idle_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", _STATE)

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N803
        self.held.update(self._fresh(float(initialState["initial"].iloc[0]), bool(initialState["previous_valid"].iloc[0])))

    def _fresh(self, initial: float, valid: bool) -> tuple:
        return (initial, valid, True, 0.0, initial, 0.0, -1, [], [], [], [], [], [], [])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N803
        state = list(self.held.get() or self._fresh(self.policy.prior, False))
        days = dict(zip(state[8], state[9]))
        events = {i: (d, p, s) for i, d, p, s in zip(*state[10:14])}
        closed, open_from = state[6], min(days, default=None)
        for pdf in rows:
            for day, exposure, event, points, status in zip(pdf["day"], pdf["exposure"], pdf["event_id"], pdf["adjusted"], pdf["status"]):
                day = int(day)
                if day <= closed:
                    continue  # its score is published
                if event == "":
                    days[day] = max(float(exposure), days.get(day, 0.0))
                elif int(event) not in events or events[int(event)][2] == "pending":
                    events[int(event)] = (day, float(points), status)
        state[8:] = list(days), list(days.values()), list(events), *([e[i] for e in events.values()] for i in range(3))
        self.held.update(tuple(state))
        # one timer at a time, that of the first open day; the others follow as it closes
        if days and (open_from is None or min(days) < open_from):
            self.handle.registerTimer((min(days) + self.policy.pending_days) * DAY_MS)
        return iter([])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N803
        at = expiredTimerInfo.getExpiryTimeInMs()
        if (held := self.held.get()) is None:
            return
        initial, valid, first, ewma, score, total, closed, active, *rest = held
        days, events = dict(zip(*rest[:2])), list(zip(*rest[2:]))
        passed = timerValues.getCurrentWatermarkInMs()  # a timer closes all days that are due, those after it find none
        due = sorted(d for d in days if (d + self.policy.pending_days) * DAY_MS <= passed)
        if not due:
            if not days and at >= (closed + self.idle_days) * DAY_MS:
                self.held.clear()
            return
        p, decay, out = self.policy, 0.5 ** (1 / self.policy.half_life), []
        for day in due:
            if 0 <= closed < day - self.idle_days:  # forgotten since, whether or not its timer came first
                initial, valid, first, ewma, score, total, _, active, *_ = self._fresh(p.prior, False)
            closed = day
            exposure, before = days.pop(day), score
            base = sum(x for _, d, x, s in sorted(events) if d == day and s != "exempt")
            if exposure == 0:
                restart = first and not valid
                score = p.prior if restart else score
                times, risk, status = 1.0, 0.0, "no_exposure_conservative" if restart else "stopped_frozen"
            else:
                total += exposure
                active = [d for d in active if d > day - p.window_days] + [day] * (base > 0)
                times = min(p.cap, 1 + p.step * max(len(active) - 1, 0))
                risk = min(100.0, base * times)
                ewma = decay * ewma + risk
                trust = total / (total + p.prior_strength)
                score = min(100.0, max(0.0, trust * max(0.0, initial - ewma) + (1 - trust) * p.prior))
                score = min(score, before + (0.0 if risk > 0 else p.recovery))
                status = "observed" if total >= p.least_exposure else "low_exposure"
            first = False
            out.append((*key, datetime.date(1970, 1, 1) + datetime.timedelta(days=day), exposure, base, times, risk, ewma, score, score - before, status))
        left = [e for e in events if e[1] > closed]
        self.held.update((initial, valid, first, ewma, score, total, closed, active, list(days), list(days.values()), *([e[i] for e in left] for i in range(4))))
        self.handle.registerTimer((min(days) + self.policy.pending_days if days else closed + self.idle_days) * DAY_MS)
        yield pd.DataFrame(out, columns=["user_id", "day", "exposure", "base", "multiplier", "risk", "ewma", "score", "change", "status"])

    def close(self) -> None:
        pass


def score_stream(s: DataFrame, starts: DataFrame, policy: Policy = Policy(), lateness: str = "2 days", idle_days: int = 365) -> DataFrame:
    """Every closed day's published score, once: (user_id, day, exposure, base, multiplier, risk, ewma, score, change, status).

    ``s`` has rows of ``SCHEMA``, ``starts`` (user_id, initial, previous_valid) is the state to begin with; a key that it lacks begins at the
    prior. A day closes when the watermark, ``lateness`` behind the latest row, is ``pending_days`` after it; what comes later for it changes
    nothing. Evidence given twice keeps its first decision. Of two rows of one day the larger exposure counts; evidence on a day
    without a row doesn't. A key without open days is forgotten ``idle_days`` after its last one. Null keys are left out.
    The session must name the RocksDB state store (``with_state_store``).
    """
    weight = F.coalesce(*(F.when(time_band(F.col("ts")) == k, F.lit(v)) for k, v in policy.coefficients.items()))
    w = s.filter(F.col("user_id").isNotNull()).withWatermark("ts", lateness)
    # ids as text: pandas would turn a column with nulls into doubles
    rows = w.select("user_id", "ts", F.unix_date(F.to_date("ts")).alias("day"), F.coalesce("exposure", F.lit(0.0)).alias("exposure"), F.coalesce(F.col("event_id").cast("string"), F.lit("")).alias("event_id"), F.coalesce(F.col("points") * weight, F.lit(0.0)).alias("adjusted"), F.coalesce("status", F.lit("valid")).alias("status"))
    made = "user_id long, day date, exposure double, base double, multiplier double, risk double, ewma double, score double, change double, status string"
    begin = starts.select("user_id", F.col("initial").cast("double").alias("initial"), "previous_valid").groupBy("user_id")
    return rows.groupBy("user_id").transformWithStateInPandas(DailyScore(policy, idle_days), made, "append", "EventTime", begin)


def with_state_store(spark):
    """The session with the state store that ``score_stream`` needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark
