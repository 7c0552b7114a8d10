"""Nearest places of one set in another, for sets of any size: blocks along a space-filling order, pruned by their boxes.

A place is a point of the unit sphere, so that straight distances order as those along the ground do. Places are put in
the order of a curve that passes through neighbouring cells one after another, and each stretch of it is a block with the box
of its points. A block looks into the other set's blocks, nearest box first, and passes over every box, large or
small, that can't hold anything nearer than what each of its points has already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import EARTH_M
from ..sources.shared import checkpoint

#: Places of a block and of the small boxes inside one; bits of a coordinate on the curve.
BLOCK, SMALL, BITS = 4096, 64, 20

_BLOCKS = "k {k}, d long, block long, lo array<double>, hi array<double>, places binary"


def _sphere(lat: Column, lon: Column) -> list[Column]:
    la, lo = F.radians(lat), F.radians(lon)
    return [F.cos(la) * F.cos(lo), F.cos(la) * F.sin(lo), F.sin(la)]


def _curve(x: list[Column]) -> Column:
    """The bits of three whole numbers, one of each in turn."""
    spread = lambda v, i: sum((F.shiftleft(F.shiftrightunsigned(v, b).bitwiseAND(F.lit(1).cast("long")), 3 * b + i) for b in range(BITS)), F.lit(0).cast("long"))
    return spread(x[0], 0) + spread(x[1], 1) + spread(x[2], 2)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of one (k, d) each from rows (k, d, x, y, z, la, lo, times) in the order of (k, d, place on the curve)."""
    held: list[tuple] = []
    number, key = 0, None

    def done() -> pa.RecordBatch:
        nonlocal number
        table = np.array([r[2:] for r in held], np.float64)
        number += 1
        out = pa.RecordBatch.from_arrays([pa.array([held[0][0]], kind), pa.array([held[0][1]], pa.int64()), pa.array([number], pa.int64()), pa.array([table[:, :3].min(0).tolist()]), pa.array([table[:, :3].max(0).tolist()]), pa.array([table.tobytes()], pa.binary())], names=["k", "d", "block", "lo", "hi", "places"])
        held.clear()
        return out

    for batch in batches:
        kind = batch.schema.field(0).type
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and (row[:2] != key or len(held) >= BLOCK):
                yield done()
            key = row[:2]
            held.append(row)
    if held:
        yield done()


def _places(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.float64).reshape(-1, 6)


def _to_box(points: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Least squared distance of each point to each box."""
    out = np.zeros((len(points), len(lo)))
    for i in range(3):
        gap = np.maximum(np.maximum(lo[None, :, i] - points[:, None, i], points[:, None, i] - hi[None, :, i]), 0)
        out += gap * gap
    return out


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k, d, block, other, target, apart): the other set's blocks that may hold a nearest place of each block's."""
    for batch in batches:
        out: list[list] = [[] for _ in range(6)]
        for k, d, block, lo, hi, other, boxes in zip(*(c.to_pylist() for c in batch.columns)):
            lo, hi = np.array(lo), np.array(hi)
            blo, bhi = (np.array([b[c] for b in boxes]) for c in ("lo", "hi"))
            gap = np.maximum(np.maximum(blo - hi, lo - bhi), 0)
            reach = np.maximum(bhi - lo, hi - blo)
            near, far = (gap**2).sum(1), (reach**2).sum(1)
            for t in np.flatnonzero(near <= far.min()):
                for o, v in zip(out, (k, d, block, other, boxes[t]["block"], float(near[t]))):
                    o.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], batch.schema.field(0).type), *(pa.array(o, t) for o, t in zip(out[1:], [pa.int64()] * 4 + [pa.float64()]))], names=["k", "d", "block", "other", "target", "apart"])


def _nearer(points: np.ndarray, best: np.ndarray, which: np.ndarray, there: np.ndarray) -> None:
    """Bring ``best`` (squared distance) and ``which`` of each point up to date with the places of another block."""
    cuts = np.arange(0, len(there), SMALL)
    lo, hi = (f.reduceat(there[:, :3], cuts, axis=0) for f in (np.minimum, np.maximum))
    for s in range(0, len(points), 512):
        own = slice(s, min(s + 512, len(points)))
        least = _to_box(points[own], lo, hi)
        order = least.argsort(1)
        for rank in range(len(cuts)):
            box = order[:, rank]
            go = np.flatnonzero(least[np.arange(len(box)), box] < best[own])
            if not len(go):
                break
            for b in np.unique(box[go]):
                q = go[box[go] == b]
                held = there[cuts[b] : cuts[b] + SMALL, :3]
                apart = ((points[own][q, None, :] - held[None]) ** 2).sum(2)
                j = apart.argmin(1)
                d = apart[np.arange(len(q)), j]
                closer = d < best[own][q]
                best[own.start + q[closer]] = d[closer]
                which[own.start + q[closer]] = there[cuts[b] + j[closer], 3:5]


def _ground(la: np.ndarray, lo: np.ndarray, la2: np.ndarray, lo2: np.ndarray) -> np.ndarray:
    a, b = np.radians(la), np.radians(la2)
    h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(lo2 - lo) / 2) ** 2
    return 2 * EARTH_M * np.arcsin(np.sqrt(np.minimum(h, 1)))


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k, metres, times): sums over each block's places, from rows (k, d, block, other, apart, own, places) of a
    block one after another, the nearest box first."""
    now, own, best, which = None, None, None, None

    def done() -> pa.RecordBatch:
        m = _ground(own[:, 3], own[:, 4], which[:, 0], which[:, 1])
        return pa.RecordBatch.from_arrays([pa.array([now[0]], kind), pa.array([float((m * own[:, 5]).sum())]), pa.array([float(own[:, 5].sum())])], names=["k", "metres", "times"])

    for batch in batches:
        kind = batch.schema.field(0).type
        for k, d, block, other, apart, mine, there in zip(*(c.to_pylist() for c in batch.columns)):
            if now != (k, d, block, other):
                if now:
                    yield done()
                now, own = (k, d, block, other), _places(mine)
                best, which = np.full(len(own), np.inf), np.zeros((len(own), 2))
            if apart <= best.max():
                _nearer(own[:, :3], best, which, _places(there))
    if now:
        yield done()


def nearest_sums(place: DataFrame, asks: DataFrame) -> DataFrame:
    """(k, metres, times): for sets (k, d) and the sets ``other`` that ``asks`` (k, d, other) names for them, sums over the places of
    d of the distance to the nearest place of other, weighted by ``times``.

    ``place`` has (k, d, la, lo, times) with different places in each set. A set's blocks are listed in one row of boxes, 1 / BLOCK of
    its places; the places themselves are only read block by block.
    """
    kind = dict(place.dtypes)["k"]
    xyz = _sphere(F.col("la"), F.col("lo"))
    grid = [F.floor((c + 1) / 2 * ((1 << BITS) - 1)).cast("long") for c in xyz]
    ordered = place.select("k", F.col("d").cast("long").alias("d"), *(c.alias(n) for c, n in zip(xyz, "xyz")), "la", "lo", F.col("times").cast("double").alias("times"), _curve(grid).alias("at"))
    dealt = ordered.repartitionByRange("k", "d", "at", "la", "lo").sortWithinPartitions("k", "d", "at", "la", "lo")
    blocks = dealt.drop("at").mapInArrow(_blocks, _BLOCKS.format(k=kind))
    blocks = checkpoint(blocks.withColumn("block", F.spark_partition_id().cast("long") * (1 << 32) + F.col("block")))
    listed = blocks.groupBy("k", F.col("d").alias("other")).agg(F.collect_list(F.struct("block", "lo", "hi")).alias("boxes"))
    asked = blocks.select("k", "d", "block", "lo", "hi").join(asks, ["k", "d"]).join(listed, ["k", "other"]).select("k", "d", "block", "lo", "hi", "other", "boxes")
    pairs = checkpoint(asked.mapInArrow(_asked, f"k {kind}, d long, block long, other long, target long, apart double"))
    mine = blocks.select("k", "d", "block", F.col("places").alias("mine"))
    there = blocks.select("k", F.col("d").alias("other"), F.col("block").alias("target"), F.col("places").alias("there"))
    met = pairs.join(there, ["k", "other", "target"]).join(mine, ["k", "d", "block"]).select("k", "d", "block", "other", "apart", "mine", "there")
    return met.repartition("k", "d", "block", "other").sortWithinPartitions("k", "d", "block", "other", "apart").mapInArrow(_measured, f"k {kind}, metres double, times double")
