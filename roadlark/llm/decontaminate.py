"""Benchmark decontamination by winnowing.

Both sides keep the minimum hash of each ``WINDOW`` consecutive ``GRAM``-word grams, so any
shared span of ``GRAM + WINDOW - 1`` = 10 words has a fingerprint in common. The join of the
fingerprints gives aligned positions; each is extended word by word to the whole shared run,
which counts if it has at least ``SPAN`` words. Items shorter than a span are one window of
their own, found by grams of their own length and verified the same way.

Items are hashed in tasks and dealt into blocks of ``BLOCK_WORDS`` words (and one item more at most).
Documents stay where they are: a block is sent to them, a broadcast of bounded size, and they are
read once for each block; a benchmark of one block needs no more. Of several blocks each leaves what it has found in the shared
folder before the next is sent, and the finds are united by text at the end, so neither the driver nor a worker
ever holds more than one block.

Defined results: null and empty texts have no words, no hits and are not contaminated; null
or wordless items occur nowhere; items with one id count once, an item without an id has the
id ""; repeated documents give equal rows; an empty table on either side gives no hits.
Output columns replace input columns of the same name.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import Words, as_bytes, in_pieces, with_columns
from ..operators.windows import running
from .common import cut, shared_path, table

SPAN, GRAM = 10, 5
WINDOW = SPAN - GRAM + 1
BLOCK_WORDS = 4_000_000
_MUL = np.uint64(0x9E3779B97F4A7C15)
#: ASCII letters in lower case, digits and all bytes of longer characters stay; the rest separates.
_KEEP = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

MADE = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("n_items", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
    T.StructField("contaminated", T.BooleanType()),
])


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_KEEP).split()


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n words."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    out = words[: len(words) - n + 1].copy()
    for k in range(1, n):
        out *= _MUL
        out += words[k : len(words) - n + 1 + k]
    out ^= out >> np.uint64(29)
    out *= _MUL
    out ^= out >> np.uint64(32)
    return out


def winnow(hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions of the rightmost minimum of each window, ascending."""
    n = len(hashes) - window + 1
    if n < 1:
        return np.empty(0, np.int64)
    least, at = hashes[:n].copy(), np.zeros(n, np.int8)
    for k in range(1, window):
        here = hashes[k : n + k]
        better = here <= least
        np.copyto(least, here, where=better)
        at[better] = k
    chosen = np.zeros(len(hashes), bool)
    chosen[np.arange(n) + at] = True
    return np.flatnonzero(chosen)


class Block:
    """Items and their fingerprints, as arrays."""

    def __init__(self, items: list[tuple[str, np.ndarray]]):
        self.ids = [i for i, _ in items]
        self.words = [w for _, w in items]
        found = [(grams(w, GRAM), k) for k, w in enumerate(self.words) if len(w) >= SPAN]
        chosen = [(h, winnow(h), k) for h, k in found]
        fps = np.concatenate([h[p] for h, p, _ in chosen] or [np.empty(0, np.uint64)])
        order = np.argsort(fps, kind="stable")
        self.fps = fps[order]
        self.at = np.concatenate([p for _, p, _ in chosen] or [np.empty(0, np.int64)])[order]
        self.item = np.concatenate([np.full(len(p), k) for _, p, k in chosen] or [np.empty(0, np.int64)])[order]
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in sorted({len(w) for w in self.words if len(w) < SPAN}):
            which = np.array([k for k, w in enumerate(self.words) if len(w) == n])
            h = np.array([grams(self.words[k], n)[0] for k in which], np.uint64)
            order = np.argsort(h, kind="stable")
            self.short[n] = h[order], which[order]

    def hits(self, words: np.ndarray, starts: np.ndarray, hit: np.ndarray, items: dict[int, set]) -> None:
        """Mark hit words of documents that follow each other in ``words``, and note their items."""
        jobs = []
        if len(self.fps):
            h = grams(words, GRAM)
            p = winnow(h)
            jobs.append((p, h[p], self.fps, self.item, self.at, GRAM))
        for n, (fps, which) in self.short.items():
            h = grams(words, n)
            jobs.append((np.arange(len(h)), h, fps, which, np.zeros(len(which), np.int64), n))
        for pos, h, fps, item, at, n in jobs:
            left = np.searchsorted(fps, h)
            extended: dict[tuple[int, int], int] = {}  # item and diagonal: where its last run ended
            for f in np.flatnonzero(fps[np.minimum(left, len(fps) - 1)] == h):
                p, i = int(pos[f]), int(left[f])
                d = int(np.searchsorted(starts, p, "right")) - 1
                if p + n > starts[d + 1]:
                    continue
                while i < len(fps) and fps[i] == h[f]:
                    k, q = int(item[i]), int(at[i])
                    i += 1
                    if extended.get((k, p - q), -1) > p:
                        continue
                    start, end = self._run(words, int(starts[d]), int(starts[d + 1]), p, k, q)
                    extended[k, p - q] = end
                    if end - start >= min(SPAN, len(self.words[k])):
                        hit[start:end] = True
                        items.setdefault(d, set()).add(self.ids[k])

    def _run(self, words: np.ndarray, lo: int, hi: int, p: int, k: int, q: int) -> tuple[int, int]:
        """The whole run of equal words around document position p and item position q, in [lo, hi)."""
        own = self.words[k]
        first, last = max(lo, p - q), min(hi, p - q + len(own))
        differs = np.flatnonzero(words[first:last] != own[first - p + q : last - p + q])
        j = int(np.searchsorted(differs, p - first))
        if j < len(differs) and differs[j] == p - first:
            return p, p
        return first + (int(differs[j - 1]) + 1 if j else 0), first + int(differs[j]) if j < len(differs) else last


def _rows_of(counts: list[int], hits: list[np.ndarray], items: list[list[str]]) -> dict[str, pa.Array]:
    """The made columns from each document's number of words, hit words as a mask and items."""
    out: dict[str, list] = {f.name: [] for f in MADE}
    for n, hit, ids in zip(counts, hits, items):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))).reshape(-1, 2).tolist() if hit.any() else []
        for name, value in zip(out, (n, int(hit.sum()), len(ids), ids, edges, bool(edges))):
            out[name].append(value)
    types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.list_(pa.int64())), pa.bool_()]
    return {n: pa.array(v, t) for (n, v), t in zip(out.items(), types)}


def _search(batches: Iterator[pa.RecordBatch], column: str, keep: list[str], block) -> Iterator[pa.RecordBatch]:
    seen = Words()
    for batch in batches:
        texts = as_bytes(batch.column(batch.schema.names.index(column)))
        counts, hits, ids = [], [], []
        for a, b in in_pieces(texts):
            lists = [words_of(t) for t in texts[a:b]]
            starts = np.concatenate([[0], np.cumsum([len(x) for x in lists], dtype=np.int64)])
            words = np.fromiter((seen[w] for x in lists for w in x), np.uint64, int(starts[-1]))
            hit = np.zeros(len(words), bool)
            items: dict[int, set] = {}
            block.value.hits(words, starts, hit, items)
            counts += map(len, lists)
            hits += [hit[s:e] for s, e in zip(starts[:-1], starts[1:])]
            ids += [sorted(items.get(d, ())) for d in range(b - a)]
        yield with_columns(batch, keep, _rows_of(counts, hits, ids))


def _united(batches: Iterator[pa.RecordBatch], column: str, keep: list[str]) -> Iterator[pa.RecordBatch]:
    """The made columns from the spans and items that all blocks have found."""
    for batch in batches:
        names = batch.schema.names
        counts, hits, ids = [], [], []
        for text, spans, items in zip(as_bytes(batch.column(names.index(column))), batch.column(names.index("__rl_spans")).to_pylist(), batch.column(names.index("__rl_items")).to_pylist()):
            n = len(words_of(text))
            hit = np.zeros(n, bool)
            for a, b in spans or ():
                hit[a:b] = True
            counts.append(n)
            hits.append(hit)
            ids.append(sorted(set(items or ())))
        yield with_columns(batch, keep, _rows_of(counts, hits, ids))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) -> (id, n, words) of the items with words."""
    seen = Words()
    for batch in batches:
        lists = [words_of(t) for t in as_bytes(batch.column(1))]
        some = [k for k, w in enumerate(lists) if w]
        ids = batch.column(0).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([ids[k] for k in some], pa.string()), pa.array([len(lists[k]) for k in some], pa.int64()), pa.array([np.fromiter((seen[w] for w in lists[k]), np.uint64).tobytes() for k in some], pa.binary())], names=["id", "n", "words"])


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """(block, id, words) of the items, a checkpoint, and the number of blocks."""
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    hashed = cut(items.mapInArrow(_hashed, "id string, n long, words binary"))
    total = hashed.agg(F.sum("n")).first()[0] or 0
    if total <= BLOCK_WORDS:
        return hashed.select(F.lit(0).cast("long").alias("block"), "id", "words"), int(total > 0)
    dealt = running(hashed.withColumn("at", F.xxhash64("id", "words")), ["at", "id"], {"before": "n"})
    dealt = cut(dealt.select(F.floor(F.col("before") / BLOCK_WORDS).alias("block"), "id", "words"))
    return dealt, dealt.agg(F.max("block")).first()[0] + 1


def _sent(blocks: DataFrame, k: int):
    """A block as a broadcast: at most BLOCK_WORDS words and one item pass through the driver."""
    rows = blocks.filter(F.col("block") == k).collect()
    return blocks.sparkSession.sparkContext.broadcast(Block([(r.id, np.frombuffer(r.words, np.uint64)) for r in rows]))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with n_words, n_hit, n_items, items (sorted as strings),
    spans ([start, end) in words) and contaminated."""
    names = {f.name for f in MADE}
    keep = [c for c in (docs.columns if keep is None else keep) if c not in names]
    schema = T.StructType([docs.schema[c] for c in keep] + list(MADE))
    src = docs.select(*dict.fromkeys([*keep, text_col]))
    blocks, n = item_blocks(benchmark, item_col, item_text_col)
    if n <= 1:
        return src.mapInArrow(functools.partial(_search, column=text_col, keep=keep, block=_sent(blocks, 0)), schema)
    # equal texts have equal finds, so texts stand for the rows: by 96 bits of two hashes
    keys = {"__rl_a": F.xxhash64(text_col), "__rl_b": F.hash(text_col)}
    texts, path = docs.select(F.col(text_col).alias("text"), *(c.alias(k) for k, c in keys.items())), shared_path(docs.sparkSession, "finds")
    found = T.StructType([T.StructField("__rl_a", T.LongType()), T.StructField("__rl_b", T.IntegerType()), *MADE])
    for k in range(n):
        sent = _sent(blocks, k)
        rows = texts.mapInArrow(functools.partial(_search, column="text", keep=list(keys), block=sent), found).filter("contaminated")
        rows.select(*keys, "items", "spans").dropDuplicates(list(keys)).write.parquet(f"{path}/{k}")
        sent.destroy()
    finds = docs.sparkSession.read.schema(T.StructType([found[c] for c in (*keys, "items", "spans")])).parquet(*(f"{path}/{k}" for k in range(n)))
    finds = finds.groupBy(*keys).agg(F.flatten(F.collect_list("spans")).alias("__rl_spans"), F.flatten(F.collect_list("items")).alias("__rl_items"))
    return src.withColumns(keys).join(finds, list(keys), "left").drop(*keys).mapInArrow(functools.partial(_united, column=text_col, keep=keep), schema)


def op3_decontamination(spark, sf_dir):
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = decontaminate(docs, items, keep=["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")
