"""Hard negatives by branch and bound over ball trees.

Rows are dealt by label into blocks; each block is a forest of ball trees, one root for each label in
it, so that a leaf holds one label. For an anchor q and a ball with centre c and radius R, the inner
products of q with the ball's rows lie within q.c - |q|R and q.c + |q|R. A search passes over balls of
labels that it doesn't want, balls outside its window of scores, and balls that end strictly beneath
its current k-th score (a tie may still win by its id).

Anchors are sent in rounds of a fixed size in bytes; each round searches all trees twice, for the
positives and then, with the windows that those give, for the negatives.
"""

from __future__ import annotations

import functools
import io
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, shared_path, table, whole_number

#: Rows of a block of trees, and of a leaf.
TREE_ROWS, LEAF_ROWS = 8192, 128
#: Bytes of vectors of the anchors that are sent at once.
SENT_BYTES = 32 << 20
#: A null id takes this place in the order.
LAST = (1 << 63) - 1
#: Factor by which components are multiplied before they are rounded down.
SCALE = 256


# ---- trees


@dataclass
class Forest:
    """Rows in the order of the leaves, and the balls: a leaf has no children and covers rows [begin, end)."""

    ids: np.ndarray
    vectors: np.ndarray
    roots: np.ndarray
    labels: np.ndarray
    centres: np.ndarray
    radii: np.ndarray
    left: np.ndarray
    right: np.ndarray
    begin: np.ndarray
    end: np.ndarray

    def pack(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **self.__dict__)
        return out.getvalue()

    @classmethod
    def unpack(cls, data: bytes) -> Forest:
        with np.load(io.BytesIO(data)) as held:
            return cls(**held)


def as_matrix(column: pa.Array) -> np.ndarray:
    """Lists of whole numbers as the rows of a matrix; shorter ones end in zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def padded(matrix: np.ndarray, width: int) -> np.ndarray:
    return matrix if matrix.shape[1] == width else np.pad(matrix, ((0, 0), (0, width - matrix.shape[1])))


def build(ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> Forest:
    """A forest with one root for each label; balls are halved across their longest extent."""
    order: list[np.ndarray] = []
    balls: list[list] = []  # label, centre, radius, left, right, begin, end
    filled = 0

    def ball(rows: np.ndarray, label: int) -> int:
        nonlocal filled
        x = vectors[rows].astype(np.float64)
        centre = x.mean(0)
        apart = np.sqrt(((x - centre) ** 2).sum(1))
        at = len(balls)
        balls.append([label, centre, apart.max(), -1, -1, filled, filled])
        if len(rows) <= LEAF_ROWS:
            order.append(rows)
            filled += len(rows)
            balls[at][6] = filled
            return at
        one = x[apart.argmax()]
        other = x[((x - one) ** 2).sum(1).argmax()]
        along = np.argsort(x @ (other - one), kind="stable")
        half = len(rows) // 2
        balls[at][3] = ball(rows[along[:half]], label)
        balls[at][4] = ball(rows[along[half:]], label)
        balls[at][6] = filled
        return at

    roots = [ball(np.flatnonzero(labels == v), int(v)) for v in np.unique(labels)]
    rows = np.concatenate(order)
    label, centre, radius, left, right, begin, end = (np.array(x) for x in zip(*balls))
    small = np.int16 if np.abs(vectors).max(initial=0) < 1 << 15 else np.int64
    return Forest(ids[rows], vectors[rows].astype(small), np.array(roots), label, centre, radius, left, right, begin, end)


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(forest) of TREE_ROWS rows each from (id, label, vector)."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def done() -> pa.RecordBatch:
        width = max(v.shape[1] for _, _, v in held)
        ids, labels, vectors = np.concatenate([i for i, _, _ in held]), np.concatenate([n for _, n, _ in held]), np.concatenate([padded(v, width) for _, _, v in held])
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([build(ids, labels, vectors).pack()], pa.binary())], names=["forest"])

    for batch in batches:
        for s in range(0, batch.num_rows, TREE_ROWS):
            part = batch.slice(s, TREE_ROWS)
            held.append((part.column(0).to_numpy(zero_copy_only=False), part.column(1).to_numpy(zero_copy_only=False), as_matrix(part.column(2))))
            if sum(len(i) for i, _, _ in held) >= TREE_ROWS:
                yield done()
    if held:
        yield done()


# ---- search


class Search:
    """The best ``k`` (score, id) of each query, over any number of forests."""

    def __init__(self, vectors: np.ndarray, labels: np.ndarray, lo: np.ndarray, hi: np.ndarray, k: int, same: bool):
        self.vectors, self.labels, self.lo, self.hi, self.k, self.same = vectors, labels, lo.astype(np.float64), hi.astype(np.float64), k, same
        self.scores = np.full((len(vectors), k), -np.inf)
        self.ids = np.full((len(vectors), k), LAST)
        self.balls = 0

    def over(self, forest: Forest) -> None:
        width = max(self.vectors.shape[1], forest.vectors.shape[1])
        queries, rows = padded(self.vectors, width), padded(forest.vectors, width)
        if float(np.abs(queries).max(initial=0)) * float(np.abs(rows.astype(np.int64)).max(initial=0)) * width >= 1 << 53:
            raise OverflowError("scores of 2**53 or more: components are too large")
        self.queries, self.rows = queries.astype(np.float64), rows.astype(np.float64)
        self.norms = np.sqrt((self.queries**2).sum(1))
        self.centres = np.pad(forest.centres, ((0, 0), (0, width - forest.centres.shape[1])))
        self.slack = 1e-9 * (1 + self.norms * float(np.sqrt((self.centres**2).sum(1)).max(initial=0) + forest.radii.max(initial=0)))
        self.forest = forest
        self.seeded = np.full(len(queries), -1)
        self._seed()
        for root in forest.roots.tolist():
            self._visit(root, np.arange(len(queries)))

    def _wanted(self, ball: int, who: np.ndarray) -> np.ndarray:
        own = self.labels[who] == self.forest.labels[ball]
        return who[own if self.same else ~own]

    def _seed(self) -> None:
        """Each query's most promising leaf first, so that its k-th score is high early."""
        leaves = np.flatnonzero(self.forest.left < 0)
        for s in range(0, len(self.queries), 4096):
            who = np.arange(s, min(s + 4096, len(self.queries)))
            top = self.queries[who] @ self.centres[leaves].T + self.norms[who, None] * self.forest.radii[leaves]
            top[(self.labels[who, None] == self.forest.labels[leaves]) != self.same] = -np.inf
            best = top.argmax(1)
            best = np.where(np.isfinite(top.max(1)), leaves[best], -1)
            self.seeded[who] = best
            for leaf in np.unique(best[best >= 0]).tolist():
                self._leaf(leaf, who[best == leaf])

    def _visit(self, ball: int, who: np.ndarray) -> None:
        who = self._wanted(ball, who)
        if not len(who):
            return
        self.balls += 1
        middle = self.queries[who] @ self.centres[ball]
        reach = self.norms[who] * self.forest.radii[ball] + self.slack[who]
        who = who[(middle + reach >= np.maximum(self.lo[who], self.scores[who, -1])) & (middle - reach <= self.hi[who])]
        if not len(who):
            return
        left, right = int(self.forest.left[ball]), int(self.forest.right[ball])
        if left < 0:
            self._leaf(ball, who[self.seeded[who] != ball])
            return
        mean = self.queries[who].mean(0)
        for child in (left, right) if mean @ self.centres[left] >= mean @ self.centres[right] else (right, left):
            self._visit(child, who)

    def _leaf(self, leaf: int, who: np.ndarray) -> None:
        rows = slice(int(self.forest.begin[leaf]), int(self.forest.end[leaf]))
        for s in range(0, len(who), 4096):
            w = who[s : s + 4096]
            score = self.queries[w] @ self.rows[rows].T
            ok = (score >= np.maximum(self.lo[w], self.scores[w, -1])[:, None]) & (score <= self.hi[w, None])
            some = ok.any(1)
            if not some.any():
                continue
            w, score = w[some], np.where(ok[some], score[some], -np.inf)
            scores = np.concatenate([self.scores[w], score], 1)
            ids = np.concatenate([self.ids[w], np.broadcast_to(self.forest.ids[rows], score.shape)], 1)
            best = np.lexsort((ids, -scores), axis=1)[:, : self.k]
            self.scores[w], self.ids[w] = np.take_along_axis(scores, best, 1), np.take_along_axis(ids, best, 1)


def _searched(batches: Iterator[pa.RecordBatch], sent, k: int, same: bool) -> Iterator[pa.RecordBatch]:
    """(query, score, id): the best k of this task's forests for each query that is sent."""
    vectors, of, labels, lo, hi = sent.value
    search = Search(vectors[of], labels[of], lo, hi, k, same)
    for batch in batches:
        for data in batch.column(0).to_pylist():
            search.over(Forest.unpack(data))
    query, at = np.nonzero(np.isfinite(search.scores))
    yield pa.RecordBatch.from_arrays([pa.array(query.astype(np.int64)), pa.array(search.scores[query, at].astype(np.int64)), pa.array(search.ids[query, at])], names=["query", "score", "id"])


def _best(forests: DataFrame, sent, k: int, same: bool) -> DataFrame:
    """(query, score, id, rank) of the best k over all forests."""
    found = forests.mapInArrow(functools.partial(_searched, sent=sent, k=k, same=same), "query long, score long, id long")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


# ---- whole operator


def quantised(vectors: DataFrame, id_col: str, vector_col: str, label: Column) -> DataFrame:
    """(id, label, vector) of the rows that take part, components as whole numbers."""
    whole = F.transform(vector_col, lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    part = vectors.filter(label.isNotNull() & F.col(vector_col).isNotNull() & F.coalesce(finite, F.lit(False)))
    return part.select(F.coalesce(whole_number(vectors, id_col), F.lit(LAST)).alias("id"), label.cast("long").alias("label"), whole.alias("vector"))


def hard_negatives(vectors: DataFrame, anchor: Column, label: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchor`` and ``label`` are columns of ``vectors``. A negative's score lies within ``low`` and
    ``high`` hundredths of its positive's. Rows with a null label, a null vector or a component
    that is null or not finite take no part; a null id is never an anchor's unless ``anchor`` says
    so, and comes last among ties. Vectors of unequal length are compared as if the shorter ended
    in zeros. Repeated rows are rows of their own: equal anchors give their rows as often as they
    occur, and another row equal to the anchor is a positive. A table without anchors gives no
    rows. Scores of 2**53 or more are refused. Other columns aren't looked at.
    """
    spark = vectors.sparkSession
    rows = quantised(vectors, id_col, vector_col, label)
    total = rows.count()
    spread = rows.withColumn("spread", F.xxhash64("id", F.monotonically_increasing_id()))
    path = shared_path(spark, "negatives")
    spread.repartitionByRange(max(1, math.ceil(total / TREE_ROWS)), "label", "spread").select("id", "label", "vector").mapInArrow(_forests, "forest binary").write.parquet(f"{path}/forests")
    forests = spark.read.schema("forest binary").parquet(f"{path}/forests")
    chosen = cut(quantised(vectors.filter(anchor), id_col, vector_col, label).groupBy("id", "label", "vector").agg(F.count("*").alias("copies")))
    size = chosen.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("width")).first()
    rounds = math.ceil(size.n * 8 * (size.width or 0) / SENT_BYTES)
    for k in range(max(1, rounds)):
        part = chosen.filter(F.pmod(F.xxhash64("id", "vector"), F.lit(max(1, rounds))) == k)
        _round(forests, part, positives, negatives, low, high).write.parquet(f"{path}/found/{k}")
    return spark.read.schema("anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long").parquet(*(f"{path}/found/{k}" for k in range(max(1, rounds))))


def _round(forests: DataFrame, anchors: DataFrame, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    spark = forests.sparkSession
    held = anchors.toArrow().combine_chunks()
    n = held.num_rows
    ids, labels, copies = (held.column(c).to_numpy() for c in ("id", "label", "copies"))
    matrix = as_matrix(held.column("vector").combine_chunks()) if n else np.zeros((0, 0), np.int64)
    open_ = np.full(n, np.inf)
    sent = spark.sparkContext.broadcast((matrix, np.arange(n), labels, -open_, open_))
    found = _best(forests, sent, positives + 1, True).toArrow()  # at most positives + 1 rows for each anchor sent
    sent.unpersist()
    query, score, id_, rank = (found.column(c).to_numpy() for c in ("query", "score", "id", "rank"))
    order = np.lexsort((rank, query))
    query, score, id_ = query[order], score[order], id_[order]
    own = (id_ == ids[query]) & (score == (matrix**2).sum(1)[query])
    first = np.concatenate([[True], query[1:] != query[:-1]]) if len(query) else np.zeros(0, bool)
    begin = np.flatnonzero(first)[np.cumsum(first) - 1] if len(query) else np.zeros(0, np.int64)
    seen = np.cumsum(own)
    itself = own & (seen - seen[begin] + own[begin] == 1)  # one row is the anchor; another equal one is not
    kept = np.flatnonzero(~itself)
    place = np.concatenate([[0], np.cumsum(~itself)])
    kept = kept[place[kept] - place[begin[kept]] < positives]
    of, ps = query[kept], score[kept]
    sent = spark.sparkContext.broadcast((matrix, of, labels, -(-low * ps // 100), high * ps // 100))
    best = _best(forests, sent, negatives, False)
    pairs = pa.table({"query": np.arange(len(kept)), "anchor_id": ids[of], "positive_id": id_[kept], "positive_score": ps, "copies": copies[of]})
    told = spark.createDataFrame(pairs.cast(pa.schema([(c, pa.int64()) for c in pairs.column_names])))
    out = best.join(told, "query").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    back = lambda c: F.nullif(c, F.lit(LAST))
    return out.select(back(F.col("anchor_id")).alias("anchor_id"), back(F.col("positive_id")).alias("positive_id"), F.col("rank").cast("int").alias("rank"), back(F.col("id")).alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_negatives(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows, F.col("vec_id") % 50 == 0, label)
