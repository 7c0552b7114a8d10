"""Near copies by SimHash and the similarity of word shingles: candidates, all of them verified.

A text is the set of its ``SHINGLE``-word shingles (64-bit hashes); two texts are near copies if the
Jaccard similarity of their sets is ``SIMILARITY`` or more. In the order of ids a document is dropped
if it is a near copy of one that is kept, so no two kept near copies remain among the candidates and
every dropped one has a kept near copy.

Equal sets are one node. Candidates are first the links of the SimHash operator: fingerprints within
its ``RADIUS`` bits, found by the generalised pigeonhole. At similarity 0.8 fingerprints differ in 9.7 of 64 bits
on average (the angle's share, acos(8/9) / pi = 0.15), and a radius that covers that costs more probes and
random candidates than the data have rows, so pairs further apart than RADIUS are found by MinHash: nodes that
agree in one of ``BANDS`` bands of ``ROWS`` least hashes are linked to the least of the band's value. The
components of all links are candidate groups: a pair of similarity s is missed with probability
(1 - s^ROWS)^BANDS at most, 6e-5 at 0.8.

Groups of more than ``LARGE`` nodes are held against their first members in the order of ids, in as many parts as
they need: of these some are kept, what is like a kept one is gone, and so on with more members each round, from
``HEADS`` up to ``MOST_HEADS``, until no group is larger. So neither a large group of near copies nor what is left of one is a
single task's. In a group of LARGE or less each node, in the order of ids, meets the kept ones that share one of its
least hashes (prefix filter, exact); a task holds the kept sets of one group, never the dropped ones. The texts of
all candidates are gathered once.

Defined results: null and empty texts are copies of each other; texts of fewer words than a shingle
are one shingle; rows without an id stay; an empty table stays empty.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import Words, as_bytes
from .common import cut
from .components import components
from .simhash import fingerprint, keep_firsts, links

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 32, 6
#: Members of a group that one task takes; first members that a large group is held against, at first and at most.
LARGE, HEADS, MOST_HEADS = 256, 16, 1024
#: Rows of two numbers that may be sent to all workers; more are joined by shuffle.
MAX_SENT = 500_000
_RNG = np.random.default_rng(20)
_XOR, _TIMES = _RNG.integers(0, 1 << 64, (2, BANDS * ROWS, 1), np.uint64, endpoint=False)
_TIMES |= np.uint64(1)
_M = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def shingles(text: bytes, n: int, seen: Words) -> np.ndarray:
    """The sorted different hashes of the text's n-word shingles."""
    words = text.lower().split()
    w = np.fromiter((seen[x] for x in words), np.uint64, len(words))
    size = min(n, len(w))
    out = np.full(max(1, len(w) - n + 1), size, np.uint64)
    for k in range(size):
        out = _mix(out * _M + w[k : k + len(out)])
    return np.unique(out)


def set_hash(x: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(x.tobytes())).view(np.int64))


def bands(x: np.ndarray) -> np.ndarray:
    """A key for each band: that of its number and its least hashes."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for k in range(0, len(x), 2048):
        np.minimum(least, ((x[None, k : k + 2048] ^ _XOR) * _TIMES).min(axis=1), out=least)
    key = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        key = _mix(key * _M + row)
    return key.view(np.int64)


def similar(x: np.ndarray, y: np.ndarray, thousandths: int) -> bool:
    a, b = len(x), len(y)
    if 1000 * min(a, b) < thousandths * max(a, b):
        return False
    both = a + b - len(np.unique(np.concatenate([x, y])))
    return 1000 * both >= thousandths * (a + b - both)


def _nodes(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """(id, text) -> (id, h, fp, bands)."""
    seen = Words()
    for batch in batches:
        texts = as_bytes(batch.column(1))
        sets = [shingles(t, n, seen) for t in texts]
        fps = np.array([fingerprint(t, n) for t in texts], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([set_hash(x) for x in sets], pa.int64()), pa.array(fps), pa.array([bands(x) for x in sets], pa.list_(pa.int64()))], names=["doc_id", "h", "fp", "bands"])


def _to_least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, h) in this order -> links of each h to the first of its key."""
    last, first = None, None
    for batch in batches:
        key, h = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
        if not len(key):
            continue
        new = np.concatenate([[last is None or key[0] != last], key[1:] != key[:-1]])
        at = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
        to = np.where(at >= 0, h[np.maximum(at, 0)], h[0] if first is None else first)
        last, first = key[-1], to[-1]
        apart = h != to
        yield pa.RecordBatch.from_arrays([pa.array(h[apart]), pa.array(to[apart])], names=["u", "v"])


class Kept:
    """Kept sets, by the least hashes that a set similar to one of them shares with it."""

    def __init__(self, thousandths: int):
        self.thousandths = thousandths
        self.sets: list[np.ndarray] = []
        self.index: dict[int, list[int]] = {}

    def _prefix(self, x: np.ndarray) -> list[int]:
        return x[: len(x) + 1 + -self.thousandths * len(x) // 1000].tolist()

    def like(self, x: np.ndarray) -> bool:
        return any(similar(x, self.sets[k], self.thousandths) for k in sorted({k for p in self._prefix(x) for k in self.index.get(p, ())}))

    def add(self, x: np.ndarray) -> None:
        for p in self._prefix(x):
            self.index.setdefault(p, []).append(len(self.sets))
        self.sets.append(x)


def _copies(batches: Iterator[pa.RecordBatch], n: int, thousandths: int) -> Iterator[pa.RecordBatch]:
    """(root, salt, member, h, text), by root and salt, members last, each in the order of ids -> the h that are
    near copies of one kept before. A member is kept by none but itself: it is compared and forgotten."""
    seen, now, last, kept = Words(), None, None, Kept(thousandths)
    for batch in batches:
        out = []
        for root, salt, member, h, text in zip(*(batch.column(i).to_pylist() for i in range(4)), as_bytes(batch.column(4))):
            if (root, salt) != now:
                now, last, kept = (root, salt), None, Kept(thousandths)
            x = shingles(text, n, seen)
            if h == last or set_hash(x) != h:  # the row again, or another text under the same id
                continue
            last = h
            if kept.like(x):
                out.append(h)
            elif not member:
                kept.add(x)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], names=["h"])


def candidates(nodes: DataFrame) -> DataFrame:
    """(u, v) links of nodes (h, fp, bands): those of the SimHash operator and those of the bands."""
    same = nodes.groupBy("fp").agg(F.min("h").alias("at"))
    equal = nodes.select("h", "fp").join(same, "fp").filter("h <> at").select(F.col("h").alias("u"), F.col("at").alias("v"))
    near = links(same).join(same.select(F.col("fp").alias("u"), F.col("at").alias("a")), "u").join(same.select(F.col("fp").alias("v"), F.col("at").alias("b")), "v").select(F.col("a").alias("u"), F.col("b").alias("v"))
    keyed = nodes.select(F.explode("bands").alias("key"), "h").repartition("key").sortWithinPartitions("key", "h")
    return keyed.mapInArrow(_to_least, "u long, v long").unionAll(equal).unionAll(near)


def _sent(keys: DataFrame) -> DataFrame:
    """A checkpointed table of keys, to be broadcast if it is small."""
    return F.broadcast(keys) if keys.count() <= MAX_SENT else keys


def _against_heads(texts: DataFrame, heads: int, n: int, thousandths: int) -> tuple[DataFrame, DataFrame]:
    """Of the nodes (root, h, least, text) of large groups those that are near copies of a kept head, and the heads: about
    ``heads`` of each group, all that come before some place in the order of ids."""
    large = cut(texts.groupBy("root").agg(F.count("*").alias("n")).filter(F.col("n") > LARGE).select("root", F.ceil(F.col("n") / LARGE).cast("int").alias("parts")))
    own = texts.join(_sent(large), "root")
    salt = lambda parts: F.pmod(F.xxhash64("h"), parts).cast("int")
    # the first of each part, as far as no part hides one that comes before them
    first = own.select("root", salt(F.col("parts")).alias("salt"), F.struct("least", "h").alias("at"), F.greatest(F.lit(1), F.ceil(F.lit(4 * heads) / F.col("parts"))).alias("most")).distinct()
    place = F.row_number().over(Window.partitionBy("root", "salt").orderBy("at"))
    shown = cut(first.withColumn("place", place).filter(F.col("place") <= F.col("most")))
    full = shown.groupBy("root", "salt").agg(F.max("at").alias("end"), (F.count("*") == F.max("most")).alias("full")).filter("full")
    ends = full.groupBy("root").agg(F.min("end").alias("end"))
    chosen = shown.join(_sent(cut(ends)), "root", "left").filter(F.col("end").isNull() | (F.col("at") <= F.col("end"))).select("root", F.col("at.h").alias("h"))
    chosen = cut(chosen)
    sizes = chosen.groupBy("root").agg(F.count("*").alias("k"))
    parts = cut(large.join(sizes, "root").select("root", F.ceil(F.col("parts") * LARGE / F.greatest(F.lit(LARGE), F.col("k"))).cast("int").alias("parts")))
    members = texts.join(_sent(parts), "root").join(_sent(chosen.select("h")), "h", "left_anti").select("root", salt(F.col("parts")).alias("salt"), F.lit(True).alias("member"), "least", "h", "text")
    first = texts.join(_sent(chosen.select("h")), "h").join(_sent(parts), "root").select("root", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), F.lit(False).alias("member"), "least", "h", "text")
    dealt = members.unionAll(first).repartition("root", "salt").sortWithinPartitions("root", "salt", "member", "least", "h").select("root", "salt", "member", "h", "text")
    gone = cut(dealt.mapInArrow(functools.partial(_copies, n=n, thousandths=thousandths), "h long").distinct())
    return gone, chosen.select("h")


def keep_distinct(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` without near copies of documents with a lesser id that are kept."""
    thousandths = round(1000 * similarity)
    named = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("h", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])
    rows = cut(named.mapInArrow(functools.partial(_nodes, n=shingle), schema))
    # Texts of one set have one fingerprint unless they repeat shingles differently; any of them will do.
    nodes = cut(rows.groupBy("h").agg(F.min("doc_id").alias("least"), F.first("bands").alias("bands"), F.min("fp").alias("fp")))
    roots = components(candidates(nodes))
    members = roots.select(F.col("node").alias("h"), "root").unionAll(roots.select(F.col("root").alias("h"), "root").distinct())
    asked = members.join(nodes.select("h", "least"), "h")
    all_texts = cut(named.join(asked, F.col("doc_id") == F.col("least")).select("root", "h", "least", "text"))
    texts, gone, decided, heads = all_texts, None, None, HEADS
    while not texts.groupBy("root").count().filter(F.col("count") > LARGE).isEmpty():
        like, first = _against_heads(texts, heads, shingle, thousandths)
        gone = like if gone is None else gone.unionAll(like)
        decided = like.unionAll(first) if decided is None else decided.unionAll(like).unionAll(first)
        texts = all_texts.join(_sent(decided), "h", "left_anti")
        heads = min(MOST_HEADS, 4 * heads)
    copies = texts.repartition("root").sortWithinPartitions("root", "least", "h").select("root", F.lit(0).alias("salt"), F.lit(False).alias("member"), "h", "text")
    last = copies.mapInArrow(functools.partial(_copies, n=shingle, thousandths=thousandths), "h long")
    gone = (last if gone is None else last.unionAll(gone)).select(F.col("h").alias("__rl_gone"))
    found = rows.select("doc_id", "h").join(nodes.select("h", "least"), "h").join(gone, F.col("h") == F.col("__rl_gone"), "left")
    return keep_firsts(docs, cut(found.select("doc_id", ((F.col("doc_id") == F.col("least")) & F.col("__rl_gone").isNull()).alias("first"))), id_col)
