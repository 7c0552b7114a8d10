"""SimHash near-duplicates by the generalised pigeonhole principle.

64-bit fingerprints link at ``RADIUS`` = 4 or fewer differing bits. The bits are grouped into m
partitions so that correlated bits stand together; each fingerprint, as a query, gets its own
thresholds t_1..t_m (-1: the partition isn't probed) with sum RADIUS - m + 1, chosen by dynamic
programming over candidate counts estimated from the partitions' value histograms. If two
fingerprints differ in at most RADIUS bits, then some partition differs in at most its t bits,
so probing all values within t of the query's value in each partition finds every link; what
is found is verified on all 64 bits.

Equal fingerprints are one node, so copies never meet in pairs. Probes and index entries meet
by partition value; values with more than ``GROUP`` entries are dealt into blocks, each pair of
blocks once, so no task holds an unbounded group. Inside a group links are found in arrays and
only a spanning part of them leaves it. m follows from the number of fingerprints by the same
cost estimate and never changes the result.

Defined results: null and empty texts have fingerprint zero, linked like any other; repeated
rows share a component; an empty table gives an empty table; input columns named as an output
column are replaced. An id that is null counts in no minimum.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import as_bytes, with_columns
from .common import cut, table
from .components import components, dealt_again

BITS, RADIUS, SHINGLE, SEED = 64, 4, 4, 42
#: Entries of one partition value that may meet in one place.
GROUP = 8192
#: Comparisons that one probe row costs about as much as.
PROBE_COST = 20.0
_PREFIX = 16


def fingerprint(text: bytes, n: int = SHINGLE) -> int:
    """SimHash over all n-word shingles of the text, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= n:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    first = np.concatenate([[0], ends[: len(words) - n]]).tolist()
    last = (ends[n - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    counts, total = np.zeros(BITS, np.int64), len(first)
    for k in range(0, total, 1 << 16):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(first[k : k + (1 << 16)], last[k : k + (1 << 16)])], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << j for j in range(BITS) if 2 * int(counts[j]) > total)


def _fingerprints(batches: Iterator[pa.RecordBatch], column: str, keep: list[str], n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = as_bytes(batch.column(batch.schema.names.index(column)))
        fps = np.array([fingerprint(t, n) for t in texts], np.uint64).view(np.int64)
        yield with_columns(batch, keep, {"fp": pa.array(fps)})


def with_fingerprints(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` (or its columns ``keep``) with the fingerprint as a long ``fp``."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != "fp"]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("fp", T.LongType())])
    return docs.select(*dict.fromkeys([*keep, text_col])).mapInArrow(functools.partial(_fingerprints, column=text_col, keep=keep, n=shingle), schema)


# ---- planning: partitions of correlated bits, thresholds by dynamic programming


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each bit is set together with each other one, a row of 64 counts for each bit."""
    total = np.zeros((BITS, BITS), np.int64)
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False)
        for k in range(0, len(fps), 1 << 16):
            bits = np.unpackbits(np.ascontiguousarray(fps[k : k + (1 << 16)]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += (bits.T @ bits).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(range(BITS), pa.int32()), pa.array(total.tolist(), pa.list_(pa.int64()))], names=["bit", "counts"])


def correlated_partitions(together: np.ndarray, n: int, m: int) -> list[list[int]]:
    """m groups of bits, as equal as can be, each grown around a seed by mean absolute correlation."""
    p = together.diagonal() / max(n, 1)
    var = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((together / max(n, 1) - np.outer(p, p)) / np.outer(var, var))
    np.fill_diagonal(corr, 0)
    free, groups = list(range(BITS)), []
    for k in range(m):
        size = BITS // m + (k < BITS % m)
        seed = max(free, key=lambda i: (corr[i, free].sum(), -i))
        group = [seed]
        free.remove(seed)
        while len(group) < size:
            group.append(best := max(free, key=lambda i: (corr[i, group].sum(), -i)))
            free.remove(best)
        groups.append(sorted(group))
    return groups


def partition_count(n: int) -> int:
    """The m of least estimated cost for n fingerprints: probes, and candidates that share a value."""

    def cost(m: int) -> float:
        width = BITS / m
        extra, out = RADIUS - m + 1, 0.0
        for k in range(m):
            t = extra // m + (k < extra % m)
            probes = sum(math.comb(round(width), j) for j in range(t + 1))
            out += probes * (PROBE_COST + n / 2**width)
        return out

    return min((2, 3, 4, 5), key=cost)


def gather(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    """The named bits of each fingerprint, packed."""
    out = np.zeros(len(fps), np.uint64)
    for k, b in enumerate(bits):
        out |= ((fps >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)
    return out


class Plan:
    """Partitions, the estimated candidates of each prefix value and threshold, and block counts.

    Its size is fixed: m partitions, 2^16 prefix values, a few thresholds.
    """

    def __init__(self, groups: list[list[int]], prefix_counts: list[np.ndarray]):
        self.groups = groups
        self.m = len(groups)
        self.total = RADIUS - self.m + 1
        self.most = min(self.total + self.m - 1, 2 if self.m > 2 else 3)
        self.costs, self.held = [], []
        for bits, hist in zip(groups, prefix_counts):
            wide = len(bits)
            high = min(_PREFIX, wide)
            shell, near = hist.astype(np.float64), [hist.astype(np.float64)]
            for j in range(1, self.most + 1):
                at, out = np.arange(len(hist)), np.zeros(len(hist))
                for flips in itertools.combinations(range(high), j):
                    out += hist[at ^ sum(1 << f for f in flips)]
                near.append(out)
            shell = [sum(near[j] * sum(math.comb(wide - high, i) for i in range(t - j + 1)) for j in range(t + 1)) / 2 ** (wide - high) for t in range(self.most + 1)]
            self.costs.append([shell[t] + PROBE_COST * sum(math.comb(wide, i) for i in range(t + 1)) for t in range(self.most + 1)])
            self.held.append(np.maximum(1, np.ceil(sum(near[: 2]) / GROUP)).astype(np.int64))

    def prefix(self, k: int, values: np.ndarray) -> np.ndarray:
        return (values & np.uint64((1 << _PREFIX) - 1)).astype(np.int64)

    def thresholds(self, values: list[np.ndarray]) -> np.ndarray:
        """For each query the thresholds of least estimated candidates; their sum is RADIUS - m + 1."""
        n = len(values[0])
        low, high = -self.m, self.total + self.m
        best = np.full((n, high - low + 1), np.inf)
        best[:, -low] = 0
        chosen = []
        for k in range(self.m):
            at = self.prefix(k, values[k])
            options = [np.zeros(n)] + [c[at] for c in self.costs[k]]
            new, pick = np.full_like(best, np.inf), np.zeros(best.shape, np.int8)
            for t, cost in zip(range(-1, self.most + 1), options):
                moved = np.full_like(best, np.inf)
                if t < 0:
                    moved[:, :-1] = best[:, 1:]
                else:
                    moved[:, t:] = best[:, : best.shape[1] - t]
                moved = moved + cost[:, None]
                better = moved < new
                new[better] = moved[better]
                pick[better] = t
            best = new
            chosen.append(pick)
        out, r = np.empty((n, self.m), np.int8), np.full(n, self.total - low)
        for k in reversed(range(self.m)):
            out[:, k] = chosen[k][np.arange(n), r]
            r = r - out[:, k]
        return out


def _plan(nodes: DataFrame) -> Plan:
    counted = nodes.select("fp").mapInArrow(_together, "bit int, counts array<bigint>").groupBy("bit").agg(F.array(*(F.sum(F.get("counts", F.lit(j))) for j in range(BITS))).alias("counts"))
    together = np.zeros((BITS, BITS), np.int64)
    for r in counted.collect():  # 64 rows of 64 counts
        together[r.bit] = r.counts
    n = nodes.count()
    groups = correlated_partitions(together, n, partition_count(n))
    hists = []
    bit = lambda b, k: F.shiftleft(F.shiftrightunsigned("fp", b).bitwiseAND(F.lit(1).cast("long")), k)
    values = [functools.reduce(lambda a, x: a.bitwiseOR(x), [bit(b, k) for k, b in enumerate(bits[:_PREFIX])]) for bits in groups]
    keyed = nodes.select(F.explode(F.array(*(F.lit(k << _PREFIX).cast("long") + v for k, v in enumerate(values)))).alias("v"))
    hists = np.zeros((len(groups), 1 << _PREFIX), np.int64)
    for r in keyed.groupBy("v").count().toLocalIterator():  # at most m * 2^16 rows
        hists[r.v >> _PREFIX, r.v & ((1 << _PREFIX) - 1)] = r["count"]
    return Plan(groups, [h[: 1 << min(_PREFIX, len(g))] for h, g in zip(hists, groups)])


# ---- probing and verification


def _signatures(batches: Iterator[pa.RecordBatch], plan) -> Iterator[pa.RecordBatch]:
    """Index entries and probes: (key, probe, fp)."""
    plan = plan.value
    for batch in batches:
        all_fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for s in range(0, len(all_fps), 1 << 14):
            fps = all_fps[s : s + (1 << 14)]
            values = [gather(fps, bits) for bits in plan.groups]
            thresholds = plan.thresholds(values)
            mixed = (fps * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
            for k, v in enumerate(values):
                yield from _entries(plan, k, v, np.arange(len(fps)), mixed, False, fps)
                width = len(plan.groups[k])
                for j in range(int(thresholds[:, k].max(initial=-1)) + 1):
                    who = np.flatnonzero(thresholds[:, k] >= j)
                    for flips in itertools.combinations(range(width), j):
                        yield from _entries(plan, k, v[who] ^ np.uint64(sum(1 << f for f in flips)), who, mixed, True, fps)


def _entries(plan: Plan, k: int, values: np.ndarray, who: np.ndarray, mixed: np.ndarray, probe: bool, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row for each value, or in values with many entries one for each block of the other side."""
    blocks = plan.held[k][plan.prefix(k, values)]
    for n in np.unique(blocks).tolist():
        at = np.flatnonzero(blocks == n)
        own = mixed[who[at]] % np.uint64(n)
        for other in range(n):
            pair = (own * np.uint64(n) + np.uint64(other)) if not probe else (np.uint64(other) * np.uint64(n) + own)
            key = ((values[at] * np.uint64(8) + np.uint64(k)) * np.uint64(0xD6E8FEB86659FD93)) ^ (pair * np.uint64(0xC2B2AE3D27D4EB4F))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.full(len(at), probe)), pa.array(fps[who[at]].view(np.int64))], names=["key", "probe", "fp"])


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verified links of each key's probes and entries; rows come in the order of key and probe."""
    held: list[tuple] = []
    rows = 0
    for batch in batches:
        held.append(tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)))
        rows += batch.num_rows
        if rows >= 1 << 18:
            key, probe, fp = (np.concatenate(x) for x in zip(*held))
            done = int(np.searchsorted(key, key[-1]))  # the last key may go on
            if done:
                yield from _verify(key[:done], probe[:done], fp[:done])
            held, rows = [(key[done:], probe[done:], fp[done:])], len(key) - done
    if rows:
        yield from _verify(*(np.concatenate(x) for x in zip(*held)))


def _out(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], names=["u", "v"])


def _verify(key: np.ndarray, probe: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
    split = cuts[:-1] + np.add.reduceat(~probe, cuts[:-1])  # entries come first
    entries, probes = split - cuts[:-1], cuts[1:] - split
    pairs = entries * probes
    small = np.flatnonzero((pairs > 0) & (pairs <= 2048))
    for k in range(0, len(small), 4096):
        g = small[k : k + 4096]
        which = np.repeat(np.arange(len(g)), pairs[g])
        at = np.arange(len(which)) - np.repeat(np.cumsum(pairs[g]) - pairs[g], pairs[g])
        a = cuts[g][which] + at // probes[g][which]
        b = split[g][which] + at % probes[g][which]
        near = (_apart(fp[a], fp[b]) <= RADIUS) & (fp[a] != fp[b])
        if near.any():
            yield _out(fp[a[near]], fp[b[near]])
    for g in np.flatnonzero(pairs > 2048):
        yield from _spanning(fp[cuts[g] : split[g]], fp[split[g] : cuts[g + 1]])


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64))


def _spanning(fa: np.ndarray, fb: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Links that connect what the full bipartite set of links between a and b connects: each
    member to the least of its part, found by passing on the least label until nothing changes."""
    la, lb = fa.copy(), fb.copy()
    step = max(1, (1 << 21) // max(1, len(fb)))
    while True:
        before = la.copy(), lb.copy()
        for k in range(0, len(fa), step):
            near = _apart(fa[k : k + step, None], fb[None, :]) <= RADIUS
            i, j = np.nonzero(near)
            np.minimum.at(la, i + k, lb[j])
            np.minimum.at(lb, j, la[i + k])
        if np.array_equal(before[0], la) and np.array_equal(before[1], lb):
            break
    u, v = np.concatenate([fa, fb]), np.concatenate([la, lb])
    moved = u != v
    if moved.any():
        yield _out(u[moved], v[moved])


def links(nodes: DataFrame) -> DataFrame:
    """Distinct fingerprints ``fp`` -> (u, v) pairs of them that connect what links within RADIUS
    bits connect."""
    plan = nodes.sparkSession.sparkContext.broadcast(_plan(nodes))
    rows = nodes.select("fp").mapInArrow(functools.partial(_signatures, plan=plan), "key long, probe boolean, fp long")
    dealt = rows.repartition("key").sortWithinPartitions("key", "probe")
    return dealt.mapInArrow(_links, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id): the least id reachable over links, for every row of ``docs``."""
    fps = cut(with_fingerprints(docs, text_col, [id_col], shingle).select(F.col(id_col).alias("doc_id"), "fp"))
    nodes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(nodes))
    parts = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = dealt_again(parts.groupBy("root").agg(F.min("least").alias("component_id")), "root")
    return fps.join(parts.select("fp", "root").join(least, "root").drop("root"), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without near-duplicates: of each class the row with the least id stays, of rows with
    that id one. Rows without an id can't be told apart by it, link to nothing and stay."""
    named = docs.filter(F.col(id_col).isNotNull())
    return keep_firsts(docs, cut(near_duplicates(named, id_col, text_col).select("doc_id", (F.col("doc_id") == F.col("component_id")).alias("first"))), id_col)


def keep_firsts(docs: DataFrame, found: DataFrame, id_col: str) -> DataFrame:
    """``docs`` without the ids that ``found`` (doc_id, first), a checkpoint, says aren't first."""
    dropped = found.filter(~F.col("first")).select(F.col("doc_id").alias("__rl_dropped")).distinct()
    out = docs.join(dropped, docs[id_col] == F.col("__rl_dropped"), "left_anti")
    firsts = found.filter("first")
    if firsts.groupBy("doc_id").count().filter("count > 1").isEmpty():
        return out
    kept = out.filter(F.col(id_col).isNotNull()).dropDuplicates([id_col])
    return kept.unionByName(out.filter(F.col(id_col).isNull()))


def op4_simhash(spark, sf_dir):
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
