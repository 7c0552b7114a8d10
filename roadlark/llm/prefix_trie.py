"""The trie of shared conversation beginnings, by an external mergesort that carries common prefixes.

A conversation is the sequence of its turns, each turn 16 bytes of a hash. Sequences are dealt by
ranges, so that equal beginnings lie together and a beginning that very many share is split. In a
range, runs of bounded size are sorted and keep, with each sequence, the number of turns it shares
with the one before (LCP). A loser tree merges the runs: the sequence that shares more with the last
one out is the smaller, without a look at its turns, and equal ones are compared only from there on.
The merged stream with its LCPs opens and finishes nodes on a stack of the current path.

A range's first and last paths may go on in other ranges. Their nodes come out in parts, two paths a
range, and are put together afterwards: the part sums along a path and over the ranges that a node
spans give its subtree, without walking any tree.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.windows import running
from .common import SPACES, cut, table, whole_number

#: Sequences of a run, and bytes of them; bytes of the sequences of a range.
RUN_ROWS, RUN_BYTES, RANGE_BYTES = 4096, 8 << 20, 16 << 20
#: Bytes of a turn.
TURN = 16

_PARTS = "edge boolean, range long, path binary, parent binary, depth long, first_path long, last_path long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, words long, ends string"


# ---- sorting


def shared_turns(a: bytes, b: bytes, turns: int) -> int:
    """Turns that two sequences share, given that they share the first ``turns``."""
    at, end = turns * TURN, min(len(a), len(b))
    while at < end and a[at : at + TURN] == b[at : at + TURN]:
        at += TURN
    return at // TURN


def sorted_run(items: list[tuple]) -> list[tuple]:
    """(sequence, id, words, lcp) in order from (sequence, id, words)."""
    items.sort(key=lambda x: x[:2])
    out, before = [], b""
    for key, conv, words in items:
        out.append((key, conv, words, shared_turns(before, key, 0)))
        before = key
    return out


def merged(runs: list[list[tuple]]) -> Iterator[tuple]:
    """(sequence, id, words, lcp with the one before) of all runs in order, by a loser tree over LCPs."""
    k = 1 << max(0, (len(runs) - 1).bit_length())
    streams = [iter(r) for r in runs] + [iter(())] * (k - len(runs))
    heads = [next(s, None) for s in streams]
    shared = [0] * k  # with the last one out
    losers = [0] * k

    def wins(a: int, b: int) -> bool:
        """Whether a comes first; the other then knows what it shares with it."""
        x, y = heads[a], heads[b]
        if x is None or y is None:
            return y is None
        if shared[a] != shared[b]:
            return shared[a] > shared[b]
        n = shared_turns(x[0], y[0], shared[a])
        first = (x[0][n * TURN : (n + 1) * TURN], x[1]) <= (y[0][n * TURN : (n + 1) * TURN], y[1])
        shared[b if first else a] = n
        return first

    def play(node: int) -> int:
        if node >= k:
            return node - k
        a, b = play(2 * node), play(2 * node + 1)
        if not wins(a, b):
            a, b = b, a
        losers[node] = b
        return a

    winner = play(1) if k > 1 else 0
    while heads[winner] is not None:
        key, conv, words, _ = heads[winner]
        yield key, conv, words, shared[winner]
        heads[winner] = next(streams[winner], None)
        shared[winner] = heads[winner][3] if heads[winner] else 0
        node = (winner + k) // 2
        while node:
            if not wins(winner, losers[node]):
                winner, losers[node] = losers[node], winner
            node //= 2


# ---- the path


class _Node:
    __slots__ = ("path", "words", "first", "convs", "least", "children", "leaves", "saved", "ends", "waiting")

    def __init__(self, path: bytes, words: int, first: bool):
        self.path, self.words, self.first = path, words, first
        self.convs = self.children = self.leaves = self.saved = 0
        self.least: int | None = None
        self.ends: list[str] = []
        self.waiting: list[list] = []  # finished children, which still miss this node's least id


def nodes_of(stream: Iterator[tuple], place: int) -> Iterator[list]:
    """Rows of ``_PARTS`` from a range's merged sequences: whole nodes, and the parts of the first and last paths' nodes."""
    stack: list[_Node] = []

    def finish(last: bool) -> Iterator[list]:
        node, parent = stack.pop(), stack[-1] if stack else None
        edge, depth = node.first or last, len(stack)
        above = parent.path if parent else None
        if not edge:
            node.saved += (node.convs - 1) * node.words
            node.leaves += not node.children
        for row in node.waiting:
            if edge:
                row[3] = node.path
            else:
                row[8] = node.least
            yield row
        ends = ",".join(node.ends)
        if edge:
            yield [True, place, node.path, above, depth, 2 * place + (not node.first), 2 * place + last, node.least, None, node.convs, node.children, node.leaves, node.saved, node.words, ends or None]
        if parent:
            parent.convs += node.convs
            parent.least = node.least if parent.least is None else min(parent.least, node.least)
            if not edge:
                parent.children += 1
                parent.leaves += node.leaves
                parent.saved += node.saved
                parent.waiting.append([False, place, None, None, depth, None, None, node.least, None, node.convs, node.children, node.leaves, node.saved, None, hashlib.sha256(ends.encode()).hexdigest()])

    for key, conv, words, lcp in stream:
        first = not stack
        if first:
            stack.append(_Node(hashlib.md5(b"").digest(), 0, True))
        while len(stack) > lcp + 1:
            yield from finish(False)
        for d in range(lcp, len(key) // TURN):
            stack.append(_Node(hashlib.md5(stack[-1].path + key[d * TURN : (d + 1) * TURN]).digest(), words[d], first))
        top = stack[-1]
        top.convs += 1
        top.least = conv if top.least is None else min(top.least, conv)
        top.ends.append(str(conv))
    while stack:
        yield from finish(True)


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    runs, items, size = [], [], 0
    for batch in batches:
        for item in zip(*(c.to_pylist() for c in batch.columns)):
            items.append(item)
            size += len(item[0])
            if len(items) >= RUN_ROWS or size >= RUN_BYTES:
                runs.append(sorted_run(items))
                items, size = [], 0
    if items:
        runs.append(sorted_run(items))
    types = [pa.bool_(), pa.int64(), pa.binary(), pa.binary(), *[pa.int64()] * 10, pa.string()]
    names = [x.split()[0] for x in _PARTS.split(", ")]
    out: list[list] = []

    def batch_of(rows: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    for row in nodes_of(merged(runs), TaskContext.get().partitionId()):
        out.append(row)
        if len(out) >= 8192:
            yield batch_of(out)
            out = []
    if out:
        yield batch_of(out)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, digest) of the ids that end at each path, whose parts come in order."""
    path, digest = None, None
    for batch in batches:
        paths, out = [], []
        for p, ends in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if p != path:
                if digest:
                    paths.append(path)
                    out.append(digest.hexdigest())
                path, digest = p, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ends.encode())
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.binary()), pa.array(out, pa.string())], names=["path", "digest"])
    if digest:
        yield pa.RecordBatch.from_arrays([pa.array([path], pa.binary()), pa.array([digest.hexdigest()])], names=["path", "digest"])


# ---- whole operator


def sequences(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turns) with turns an array of (hash, words), in the order of the turn column, nulls
    first; turns of one number come in the order of role and text. Null role or text is empty. Rows
    without a conversation's id belong to none."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    named = turns.filter(F.col(conv_col).isNotNull()).select(whole_number(turns, conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
    one = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))
    placed = named.select("conv_id", place.alias("place"), one.alias("hash"), F.regexp_count("text", F.lit(f"[^{SPACES}]+")).alias("words"))
    held = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("place", "hash", "words"))).alias("turns"))
    return held.select("conv_id", F.transform("turns", lambda t: F.struct(t["hash"].alias("hash"), t["words"].alias("words"))).alias("turns"))


def grafted(held: DataFrame, base: Column, depth: Column, most: int) -> DataFrame:
    """Sequences whose first ``depth`` turns, ``most`` at most, are those of conversation ``base``; an
    absent one gives none. Both columns are made of ``conv_id``."""
    first = held.select(F.col("conv_id").alias("base"), F.slice("turns", 1, most).alias("beginning"))
    told = held.withColumn("base", base).withColumn("depth", depth)
    empty = F.slice("turns", 1, 0)
    own = F.slice("turns", F.col("depth") + 1, F.greatest(F.size("turns"), F.lit(1)))
    taken = F.coalesce(F.slice("beginning", F.lit(1), F.col("depth")), empty)
    return told.join(first, "base", "left").select("conv_id", F.concat(taken, own).alias("turns"))


def trie(held: DataFrame) -> DataFrame:
    """A row for each node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens and ends_sha256, from the sequences ``held`` (conv_id, turns).

    Every conversation id must occur once. A conversation without turns is a member of the root
    alone; no conversations at all give no node. Turns are told apart by 128 bits of a hash of role
    and text. One conversation is worked on by one task, 16 bytes a turn; a beginning or a whole
    conversation that many share is split over tasks, with its ids joined up in order at the end.
    """
    keyed = cut(held.select(F.unhex(F.array_join(F.transform("turns", lambda t: t["hash"]), "")).alias("key"), "conv_id", F.col("turns.words").alias("words")))
    size = keyed.agg(F.sum(F.length("key") + 32)).first()[0] or 0
    parts = cut(keyed.repartitionByRange(max(1, math.ceil(size / RANGE_BYTES)), "key", "conv_id").mapInArrow(_ranges, _PARTS))
    edges, whole = parts.filter("edge"), parts.filter("NOT edge")

    joined = edges.groupBy("path").agg(
        F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.min("first_path").alias("from"), F.max("last_path").alias("to"), F.min("conv_id").alias("conv_id"), F.max("words").alias("words"),
        *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")),
    )
    kids = joined.groupBy("parent").agg(F.count("*").alias("kids")).filter(F.col("parent").isNotNull())
    joined = joined.join(kids.withColumnRenamed("parent", "path"), "path", "left").withColumn("n_children", F.col("n_children") + F.coalesce("kids", F.lit(0))).drop("kids")
    own = cut(joined.withColumn("n_leaves", F.col("n_leaves") + (F.col("n_children") == 0).cast("long")).withColumn("saved_tokens", F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("words")))

    # a node first met on a path holds the nodes after it on that path, and all first met on later paths up to its last
    firsts = own.groupBy("from").agg(F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))
    paths = edges.select(F.explode(F.array("first_path", "last_path")).alias("from")).distinct().join(firsts, "from", "left").na.fill(0)
    before = running(paths, ["from"], {"l_before": "l", "s_before": "s"})
    up_to = before.select("from", (F.col("l") + F.col("l_before")).alias("l"), (F.col("s") + F.col("s_before")).alias("s"))
    below = Window.partitionBy("from").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    sums = own.select("*", F.sum("n_leaves").over(below).alias("ln"), F.sum("saved_tokens").over(below).alias("sn"))
    begin, end = up_to.select("from", F.col("l").alias("l0"), F.col("s").alias("s0")), up_to.select(F.col("from").alias("to"), F.col("l").alias("l1"), F.col("s").alias("s1"))
    digests = edges.filter("ends IS NOT NULL").select("path", "first_path", "ends").repartition("path").sortWithinPartitions("path", "first_path").mapInArrow(_digests, "path binary, digest string")
    above = own.select(F.col("path").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    spread = sums.join(begin, "from").join(end, "to").join(above, "parent", "left").join(digests, "path", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("l1") - F.col("l0") + F.col("ln")).alias("n_leaves"), (F.col("s1") - F.col("s0") + F.col("sn")).alias("saved_tokens"),
        F.coalesce("digest", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )
    # a whole node under a path's node takes that node's least id from its own range's copy
    told = edges.select("range", "path").join(own.select("path", F.col("conv_id").alias("__least")), "path").select("range", F.col("path").alias("parent"), "__least")
    inner = whole.join(told, ["range", "parent"], "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "__least"))
    return inner.select(*spread.columns[:-1], F.col("ends").alias("ends_sha256")).unionByName(spread)


def op11_prefix_trie(spark, sf_dir):
    held = cut(sequences(table(spark, sf_dir, "conversations")))
    conv = F.col("conv_id")
    return trie(grafted(held, conv - conv % 20, (F.crc32(conv.cast("string").cast("binary")) % 4).cast("int"), 3))
