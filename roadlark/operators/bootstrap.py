"""Paired stratified bootstrap of AUC and top recall, for tables of any size.

A draw takes as many rows of each class as there are. How many of them fall to each part of the table is one multinomial
number by (seed, draw, class), which every task makes for itself; which rows of a part they are is another, by (seed, draw, class, part). So
class sizes are exact in every draw, the result depends on the rows and the seed alone. Of a part a task makes the weights of ``STEP`` draws, so what
it holds follows from the constants, whatever the table; no row leaves it but as the weight of its score. The two orders, by either score, are read range by range: what a range adds to the area under the curve needs only the weight
of negatives in the ranges below it.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import checkpoint

#: Rows of a part, bytes of weights that all rows hold at once (draws beyond that follow in another round), and draws of one row's weights: a
#: task makes those of one part for so many draws at a time.
PART_ROWS, WEIGHT_BYTES, STEP = 1 << 18, 1 << 31, 64


def _shares(seed: int, draws: range, kind: int, counts: np.ndarray) -> np.ndarray:
    """(draw, part): how many rows of a class, or of all (kind 2), each draw takes from each part."""
    n = int(counts.sum())
    return np.array([np.random.default_rng([seed, t, kind]).multinomial(n, counts / n) if n else np.zeros(len(counts), np.int64) for t in draws])


def _each(seed: int, draws: range, kind: int, counts: np.ndarray, part: int) -> Iterator[np.ndarray]:
    """Draw by draw, how often it takes each row of this part."""
    n = int(counts[part])
    taken = _shares(seed, draws, kind, counts)[:, part]
    even = np.full(n, 1 / n) if n else None
    for t, m in zip(draws, taken):
        yield np.random.default_rng([seed, t, kind, part]).multinomial(m, even) if n else np.zeros(0, np.int64)


def _weights(seed: int, draws: range, kind: int, counts: np.ndarray, part: int) -> np.ndarray:
    """(row, draw): how often each draw takes each row of this part."""
    out = np.zeros((len(draws), int(counts[part])), np.int32)
    for i, w in enumerate(_each(seed, draws, kind, counts, part)):
        out[i] = w
    return out.T


def _packed(weights: np.ndarray) -> pa.Array:
    """Rows as bytes, one for each number where it is enough, else four."""
    w = np.ascontiguousarray(weights.astype(np.uint8 if weights.size and weights.max() < 256 else np.int32))
    return pa.array([r.tobytes() for r in w], pa.binary())


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    rows = column.to_pylist()
    if all(len(r) == width for r in rows):
        return np.frombuffer(b"".join(rows), np.uint8).reshape(-1, width).astype(np.int64)
    return np.stack([np.frombuffer(r, np.uint8 if len(r) == width else np.int32) for r in rows]).astype(np.int64)


def _drawn(batches: Iterator[pa.RecordBatch], seed: int, draws: range, counts: np.ndarray, step: int, recall: bool) -> Iterator[pa.RecordBatch]:
    """(side, score, id, positive, first, second) from rows (step, part, id, a, b, y) in this order. The sides of a step are four: under 0 and 1 the
    weights of positives and negatives by value of either score, each value of a part once; under 2 and 3 each row's weight among all rows."""
    held, now = [], None

    def made() -> Iterator[pa.RecordBatch]:
        if held:
            k, part = now
            own = draws[k * step : (k + 1) * step]
            yield from _of_part(k, part, *(c.combine_chunks() for c in pa.Table.from_batches(held).columns[2:]), seed, own, counts, recall)

    for batch in batches:
        steps, parts = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cuts = [0, *(np.flatnonzero((np.diff(steps) != 0) | (np.diff(parts) != 0)) + 1), batch.num_rows] if batch.num_rows else []
        for s, e in zip(cuts, cuts[1:]):
            if now != (int(steps[s]), int(parts[s])):
                yield from made()
                held, now = [], (int(steps[s]), int(parts[s]))
            held.append(batch.slice(s, e - s))
    yield from made()


def _of_part(k: int, part: int, ids: pa.Array, a: pa.Array, b: pa.Array, y: pa.Array, seed: int, draws: range, counts: np.ndarray, recall: bool) -> Iterator[pa.RecordBatch]:
    positive, names = y.to_numpy() == 1, ["side", "score", "id", "positive", "first", "second"]
    scores = (a.to_numpy(), b.to_numpy())
    met = [np.unique(score, return_inverse=True) for score in scores]
    sums = [[np.zeros((len(values), len(draws)), np.int32) for _ in range(2)] for values, _ in met]
    for c, (kind, own) in enumerate(((1, positive), (0, ~positive))):
        for t, w in enumerate(_each(seed, draws, kind, counts[kind], part)):
            for total, (values, at) in zip(sums, met):
                total[c][:, t] = np.bincount(at[own], w, len(values))
    for side, ((values, _), totals) in enumerate(zip(met, sums)):
        for s in range(0, len(values), 1024):
            v = values[s : s + 1024]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), 4 * k + side)), pa.array(v), pa.nulls(len(v), ids.type), pa.nulls(len(v), pa.bool_()), *(_packed(t[s : s + 1024]) for t in totals)], names=names)
    if not recall:
        return
    pooled = _weights(seed, draws, 2, counts[0] + counts[1], part)
    for side, score in enumerate(scores):
        for s in range(0, len(score), 1024):
            v = score[s : s + 1024]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), 4 * k + side + 2)), pa.array(-v), ids.slice(s, len(v)), pa.array(positive[s : s + 1024]), _packed(pooled[s : s + 1024]), pa.nulls(len(v), pa.binary())], names=names)


def _by_side(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Stretches of rows of one side."""
    for batch in batches:
        if batch.num_rows:
            sides = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(sides)) + 1), batch.num_rows]
            yield from ((int(sides[s]), batch.slice(s, e - s)) for s, e in zip(cuts, cuts[1:]))


def _ranges(batches: Iterator[pa.RecordBatch], n: int, step: int) -> Iterator[pa.RecordBatch]:
    """(range, side, first, second, third) of each side in a range of rows in the order of (side, score, id): of scores twice the pairs won within the
    range, the weight of positives and of negatives; of ranks the weight of positives, of all, and nothing."""
    now, sums, tie = None, None, None

    def add(pos: np.ndarray, neg: np.ndarray) -> None:
        below = sums[2] + np.cumsum(neg, 0) - neg
        sums[0] += (pos * (2 * below + neg)).sum(0)
        sums[1] += pos.sum(0)
        sums[2] += neg.sum(0)

    def done() -> pa.RecordBatch:
        if tie:
            add(tie[1], tie[2])
        return pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([now], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in sums)], names=["range", "side", "first", "second", "third"])

    for side, rows in _by_side(batches):
        width = min(step, n - side // 4 * step)
        if side != now:
            if now is not None:
                yield done()
            now, sums, tie = side, [np.zeros(width, np.int64) for _ in range(3)], None
        first = _matrix(rows.column(4), width)
        if side % 4 > 1:
            sums[0] += first[rows.column(3).to_numpy(zero_copy_only=False).astype(bool)].sum(0)
            sums[1] += first.sum(0)
            continue
        score = rows.column(1).to_numpy()
        starts = np.concatenate([[0], np.flatnonzero(np.diff(score)) + 1])
        pos, neg = np.add.reduceat(first, starts, 0), np.add.reduceat(_matrix(rows.column(5), width), starts, 0)
        if tie and tie[0] == score[0]:
            pos[0] += tie[1][0]
            neg[0] += tie[2][0]
        elif tie:
            add(tie[1], tie[2])
        add(pos[:-1], neg[:-1])
        tie = (score[-1], pos[-1:], neg[-1:])
    if now is not None:
        yield done()


def _at_the_end(batches: Iterator[pa.RecordBatch], rooms: dict[tuple[int, int], np.ndarray]) -> Iterator[pa.RecordBatch]:
    """(side, found): the positives among the first rows of a range, as far as each draw has room left there."""
    here = TaskContext.get().partitionId()
    left = {side: room.copy() for (part, side), room in rooms.items() if part == here}
    found = {side: np.zeros(len(room), np.int64) for side, room in left.items()}
    for side, rows in _by_side(batches):
        if side in left:
            every = _matrix(rows.column(4), len(left[side]))
            take = np.minimum(every, np.clip(left[side] - (np.cumsum(every, 0) - every), 0, None))
            left[side] -= take.sum(0)
            found[side] += take[rows.column(3).to_numpy(zero_copy_only=False).astype(bool)].sum(0)
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array([x.tobytes() for x in found.values()], pa.binary())], names=["side", "found"])


def _round(src: DataFrame, kind: str, seed: int, draws: range, counts: np.ndarray, quota: float, recall: bool) -> tuple[np.ndarray, np.ndarray]:
    """Of each draw the difference of the two AUCs, and of the two recalls; NaN without both classes."""
    n, parts = len(draws), counts.shape[1]
    steps = math.ceil(n / STEP)
    each = src.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))).select("step", *src.columns)
    each = each.repartition(parts * steps, "step", "part").sortWithinPartitions("step", "part", "id", "a", "b", "y")
    rows = each.mapInArrow(functools.partial(_drawn, seed=seed, draws=draws, counts=counts, step=STEP, recall=recall), f"side long, score double, id {kind}, positive boolean, first binary, second binary")
    dealt = checkpoint(rows.repartitionByRange(4 * parts * steps, "side", "score", "id").sortWithinPartitions("side", "score", "id"))
    held = dealt.mapInArrow(functools.partial(_ranges, n=n, step=STEP), "range long, side long, first binary, second binary, third binary").orderBy("range").collect()  # a row for each range and side
    number = lambda x: np.frombuffer(x, np.int64)
    of = {}
    for r in held:
        of.setdefault(r.side, []).append(r)
    total = int(counts.sum())
    want, rooms, areas, seen, ones = max(1, math.ceil(quota * total)), {}, [], {}, {}
    for k in range(steps):
        width, area = min(STEP, n - k * STEP), []
        for side in (4 * k, 4 * k + 1):
            won, pos, neg = (np.zeros(width, np.int64) for _ in range(3))
            for r in of.get(side, []):
                won = won + number(r.first) + 2 * number(r.second) * neg
                pos, neg = pos + number(r.second), neg + number(r.third)
            area.append(np.where(pos * neg > 0, won / np.maximum(2.0 * pos * neg, 1), np.nan))
        areas.append(area[0] - area[1])
        for side in (4 * k + 2, 4 * k + 3):
            before, seen[side], ones[side] = (np.zeros(width, np.int64) for _ in range(3))
            for r in of.get(side, []):
                size, room = number(r.second), np.clip(want - before, 0, None)
                whole = size <= room
                seen[side] += np.where(whole, number(r.first), 0)
                if ((room > 0) & ~whole).any():
                    rooms[r.range, side] = np.where(whole, 0, room)
                ones[side] += number(r.first)
                before = before + size
    if rooms:
        last = dealt.filter(F.spark_partition_id().isin(sorted({part for part, _ in rooms})))
        for r in last.mapInArrow(functools.partial(_at_the_end, rooms=rooms), "side long, found binary").collect():
            seen[r.side] += number(r.found)
    share = lambda side: np.where(ones[side] > 0, seen[side] / np.maximum(ones[side], 1), np.nan)
    return np.concatenate(areas), np.concatenate([share(4 * k + 2) - share(4 * k + 3) for k in range(steps)])


def paired_bootstrap(df: DataFrame, a: str, b: str, label: str, id_col: str, quota: float = 0.2, draws: int = 2000, seed: int = 42, recall: bool = True) -> DataFrame:
    """Of auc(a) - auc(b) the point and, over draws, mean, 95 % interval and share above 0; of the recall in the top
    ceil(quota N), ranked by (-score, id), the median difference and its interval.

    For the AUC positives and negatives are drawn each on their own, for the recall all rows together. Rows without a score or with a label
    that isn't 0 or 1 are left out. Without rows, or with one class, the differences that need both are null; without ``recall`` its three columns.
    """
    from .evaluation import auc

    kind = dict(df.dtypes)[id_col]
    known = df.select(F.col(id_col).alias("id"), F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"), F.col(label).cast("int").alias("y")).filter("a IS NOT NULL AND b IS NOT NULL AND NOT isnan(a) AND NOT isnan(b) AND y IN (0, 1)")
    n = known.count()
    parts = max(1, math.ceil(n / PART_ROWS))
    place = F.pmod(F.xxhash64("id", "a", "b", "y"), F.lit(parts)) if parts > 1 else F.lit(0).cast("long")
    src = checkpoint(known.select(place.alias("part"), "id", "a", "b", "y"))
    counts = np.zeros((2, parts), np.int64)
    for r in src.groupBy("y", "part").agg(F.count("*").alias("n")).collect():  # two rows for each part
        counts[r.y, r.part] = r.n
    block = max(1, min(draws, WEIGHT_BYTES // (12 * max(n, 1))))
    d, r = (np.concatenate(x) for x in zip(*(_round(src, kind, seed, range(t, min(t + block, draws)), counts, quota, recall) for t in range(0, draws, block)))) if n else (np.empty(0), np.empty(0))
    d, r = d[~np.isnan(d)], r[~np.isnan(r)]
    one = lambda s: auc(known, s, "y").first().auc
    point = one("a") - one("b") if len(d) else None
    at = lambda x, q: float(np.quantile(x, q)) if len(x) else None
    row = (len(d), point, float(d.mean()) if len(d) else None, at(d, 0.025), at(d, 0.975), float((d > 0).mean()) if len(d) else None, at(r, 0.5), at(r, 0.025), at(r, 0.975))
    return df.sparkSession.createDataFrame([row], "draws long, point double, mean double, low double, high double, improved double, recall_median double, recall_low double, recall_high double")
