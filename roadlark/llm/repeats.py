"""Exact removal of repeated byte strings by sparse suffix order and longest-previous-factor values.

A byte goes when a string of ``SPAN`` bytes over it also starts at an earlier place; a place is
(id, start), so the first copy of everything stays. The work per byte is small and no text is
compared with another one directly:

1. Every window of SPAN bytes is named by the least of the hashes of its ``GRAM``-byte strings, the
   leftmost of equals: its anchor. Equal windows have equal anchors at equal offsets. The windows
   that one occurrence of an anchor names follow each other and form its context.
2. Contexts are dealt by anchor. Of equal contexts all but the first go as they are. What remains to
   be compared are the first ones of anchors with several different contexts, the ends of shared
   passages for the most part; their bytes are fetched from the texts.
3. The windows of those contexts are put into suffix order, with the lengths of common prefixes of
   neighbours. The nearest places before and after in that order that are smaller give each
   window's longest previous factor; where it reaches SPAN, the window goes.
4. The removed windows are united by document and the texts are cut.

Copies are taken together in each chunk of texts before anything is dealt. An anchor with very many
different contexts (a line that most documents hold) is replaced by its windows, each its own anchor.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import as_bytes, with_columns
from .common import cut, shared_path, table, whole_number

#: Length of a repeated string.
SPAN = 100
#: Length of the strings that are hashed to choose anchors.
GRAM = 32
#: Bytes of text whose anchors are held at once, and bytes of one piece of a long text.
CHUNK, PIECE = 12 << 20, 1 << 20
#: Rows of a batch that are taken out of it at once.
ROWS = 256
#: Different contexts from which on an anchor is replaced by its windows; the list of such anchors
#: has at most 2**MOST entries, for which the limit rises with the number of all anchors.
HOT, MOST = 1 << 11, 20
#: Different contexts in a chunk from which on they count towards HOT.
SEEN = 4
#: Bytes of contexts in one suffix array, if they belong to several anchors.
BLOCK = 1 << 20
#: A null id takes this place in the order.
LAST = (1 << 63) - 1

_STEP, _MIX, _SPREAD = (np.uint64(x) for x in (1099511628211, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93))
_SCHEMA = "key long, ctx long, doc long, at long"


# ---- anchors


def gram_hashes(data: np.ndarray, n: int = GRAM) -> np.ndarray:
    """A 64-bit hash of every string of n bytes (a power of two), by doubling."""
    h = (data.astype(np.uint64) + np.uint64(1)) * _MIX
    h ^= h >> np.uint64(29)
    k, power = 1, int(_STEP)
    while k < n:
        h = h[:-k] * np.uint64(power) + h[k:]
        k, power = 2 * k, power * power % (1 << 64)
    h ^= h >> np.uint64(32)
    h *= _SPREAD
    return h ^ (h >> np.uint64(29))


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first window, windows, anchor's offset in the first window) of the contexts of a text
    of SPAN bytes or more and PIECE windows or less."""
    h = gram_hashes(data)
    least = (h >> np.uint64(21) << np.uint64(21)) | np.arange(len(h), dtype=np.uint64)
    width, k = SPAN - GRAM + 1, 1
    while 2 * k <= width:
        least = np.minimum(least[:-k], least[k:])
        k *= 2
    if k < width:
        least = np.minimum(least[: len(least) - (width - k)], least[width - k :])
    at = (least & np.uint64((1 << 21) - 1)).astype(np.int64)
    lo = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
    n = np.diff(np.concatenate([lo, [len(at)]]))
    return h[at[lo]].view(np.int64), lo, n, at[lo] - lo


def pack(lo, tag, n, rel):
    return (np.asarray(lo, np.int64) << 32) | (np.asarray(tag, np.int64) << 14) | (np.asarray(n, np.int64) << 7) | np.asarray(rel, np.int64)


def tag_of(text: bytes) -> int:
    """18 bits that tell texts of one id apart."""
    return xxhash.xxh3_64_intdigest(text) & 0x3FFFF


def _contexts(text: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[int], int]]:
    """Contexts of a text, piece by piece: (hash, first window, windows, offset, context's hash) and the place of the piece."""
    for start in range(0, len(text) - SPAN + 1, PIECE):
        part = text[start : start + PIECE + SPAN - 1]
        h, lo, n, rel = anchors(np.frombuffer(part, np.uint8))
        ctx = [xxhash.xxh3_64_intdigest(part[a : a + m + SPAN - 1], r) for a, m, r in zip(lo.tolist(), n.tolist(), rel.tolist())]
        yield h, lo + start, n, rel, ctx, start


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of batches of ROWS rows, so that the texts of a batch are never all copied at once."""
    for batch in batches:
        for s in range(0, batch.num_rows, ROWS):
            yield batch.slice(s, ROWS)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[bytes]]]:
    ids, texts, held = [], [], 0
    for batch in _slices(batches):
        for i, t in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
            if len(t) >= SPAN:
                ids.append(i)
                texts.append(t)
                held += len(t)
                if held >= CHUNK:
                    yield ids, texts
                    ids, texts, held = [], [], 0
    if texts:
        yield ids, texts


def _gathered(ids: list[int], texts: list[bytes], hot: np.ndarray) -> dict[str, np.ndarray]:
    """The contexts of a chunk as columns; those of hot anchors window by window."""
    out: dict[str, list] = {k: [] for k in ("key", "ctx", "doc", "at")}
    for i, text in zip(ids, texts):
        tag = tag_of(text)
        for h, lo, n, rel, ctx, _ in _contexts(text):
            c = np.array(ctx, np.uint64).view(np.int64)
            if len(hot) and (many := np.isin(h, hot)).any():
                starts = np.concatenate([np.arange(a, a + m) for a, m in zip(lo[many], n[many])])
                windows = [text[s : s + SPAN] for s in starts.tolist()]
                out["key"].append(np.array([xxhash.xxh3_64_intdigest(w, 1) for w in windows], np.uint64).view(np.int64))
                out["ctx"].append(np.array([xxhash.xxh3_64_intdigest(w) for w in windows], np.uint64).view(np.int64))
                out["at"].append(pack(starts, tag, 1, 0))
                out["doc"].append(np.full(len(starts), i, np.int64))
                h, lo, n, rel, c = (x[~many] for x in (h, lo, n, rel, c))
            out["key"].append(h)
            out["ctx"].append(c)
            out["at"].append(pack(lo, tag, n, rel))
            out["doc"].append(np.full(len(h), i, np.int64))
    return {k: np.concatenate(v) for k, v in out.items()}


def _later(key: np.ndarray, ctx: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows in the order of all four: which have an equal context at an earlier place, and which
    are the same row as the one before."""
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (ctx[1:] != ctx[:-1])])
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    later = (doc != doc[first]) | (at >> 32 != at[first] >> 32)
    same = np.concatenate([[False], ~new[1:] & (doc[1:] == doc[:-1]) & (at[1:] == at[:-1])])
    return later, same


def united(doc: np.ndarray, tag: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Intervals [lo, hi) of documents, with those that overlap or touch joined."""
    order = np.lexsort((lo, tag, doc))
    doc, tag, lo, hi = doc[order], tag[order], lo[order], hi[order]
    if not len(doc):
        return doc, tag, lo, hi
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])])
    which = np.cumsum(new) - 1
    far = (int(hi.max()) + 2) if len(hi) else 1
    reach = np.maximum.accumulate(hi + which * far)
    begins = np.concatenate([[True], (lo + which * far)[1:] > reach[:-1]])
    b = np.flatnonzero(begins)
    return doc[b], tag[b], lo[b], np.maximum.reduceat(hi, b)


def _anchor_rows(batches: Iterator[pa.RecordBatch], hot) -> Iterator[pa.RecordBatch]:
    """(key, ctx, doc, at) of the first of each chunk's equal contexts; what the others cover is
    passed on as intervals, with no windows in ``at`` and the length as ``ctx``."""
    for ids, texts in _chunks(batches):
        x = _gathered(ids, texts, hot.value)
        order = np.lexsort((x["at"], x["doc"], x["ctx"], x["key"]))
        key, ctx, doc, at = (x[k][order] for k in ("key", "ctx", "doc", "at"))
        later, same = _later(key, ctx, doc, at)
        keep = ~later & ~same
        n = (at[later] >> 7) & 127
        d, tag, lo, hi = united(doc[later], (at[later] >> 14) & 0x3FFFF, at[later] >> 32, (at[later] >> 32) + n + SPAN - 1)
        spread = (d.view(np.uint64) * _MIX).view(np.int64)
        cols = [np.concatenate(p) for p in ((key[keep], spread), (ctx[keep], hi - lo), (doc[keep], d), (at[keep], pack(lo, tag, 0, 0)))]
        for s in range(0, len(cols[0]), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(c[s : s + (1 << 16)]) for c in cols], names=["key", "ctx", "doc", "at"])


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, n): anchors with SEEN or more different contexts in a chunk, and under a null key the number of all contexts."""
    for ids, texts in _chunks(batches):
        x = _gathered(ids, texts, np.empty(0, np.int64))
        order = np.lexsort((x["ctx"], x["key"]))
        key, ctx = x["key"][order], x["ctx"][order]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (ctx[1:] != ctx[:-1])])
        keys, counts = np.unique(key[new], return_counts=True)
        many = counts >= SEEN
        yield pa.RecordBatch.from_arrays([pa.array([None, *keys[many].tolist()], pa.int64()), pa.array([len(key), *counts[many].tolist()], pa.int64())], names=["key", "n"])


# ---- equal contexts


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of whole keys from batches in the order of the first column."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not len(cols[0]):
            continue
        if held and cols[0][0] != held[0][0][-1]:
            yield [np.concatenate(c) for c in zip(*held)]
            held = []
        at = int(np.searchsorted(cols[0], cols[0][-1]))
        if at:
            yield [np.concatenate(c) for c in zip(*held, [c[:at] for c in cols])]
            held = []
        held.append([c[at:] for c in cols])
    if held:
        yield [np.concatenate(c) for c in zip(*held)]


def _told_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, at, length, key): what equal contexts cover, with its length, and the contexts whose bytes are needed, with length 0."""
    for key, ctx, doc, at in _by_key(batches):
        passed = (at >> 7) & 127 == 0
        out = [(doc[passed], at[passed], ctx[passed], np.zeros(int(passed.sum()), np.int64))]
        key, ctx, doc, at = (c[~passed] for c in (key, ctx, doc, at))
        if len(key):
            later, same = _later(key, ctx, doc, at)
            n = (at[later] >> 7) & 127
            out.append((doc[later], at[later], n + SPAN - 1, np.zeros(len(n), np.int64)))
            new = np.concatenate([[True], key[1:] != key[:-1]])
            which = np.cumsum(new) - 1
            starts = np.flatnonzero(new)
            several = np.maximum.reduceat(ctx, starts) != np.minimum.reduceat(ctx, starts)
            ask = several[which] & ~later & ~same
            out.append((doc[ask], at[ask], np.zeros(int(ask.sum()), np.int64), key[ask]))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["doc", "at", "length", "key"])


# ---- suffix order


def _fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, doc, at, bytes) of the contexts asked for of each text."""
    for batch in _slices(batches):
        out: list[list] = [[], [], [], []]
        for doc, text, asked in zip(batch.column(0).to_pylist(), as_bytes(batch.column(2)), batch.column(3)):
            if not asked.is_valid:
                continue
            tag = tag_of(text)
            fields = asked.values  # of this row alone
            for at, key in zip(fields.field("at").to_pylist(), fields.field("key").to_pylist()):
                if (at >> 14) & 0x3FFFF == tag:
                    lo = at >> 32
                    for v, o in zip((key, doc, at, text[lo : lo + ((at >> 7) & 127) + SPAN - 1]), out):
                        o.append(v)
            if len(out[0]) >= 1 << 14:
                yield _fetched_batch(out)
                out = [[], [], [], []]
        if out[0]:
            yield _fetched_batch(out)


def _fetched_batch(out: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.binary())], names=["key", "doc", "at", "bytes"])


def previous_factors(order_lcp: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Of suffixes in suffix order: the longest common prefix with one at a smaller place.

    ``order_lcp[i]`` is the common prefix of suffixes i - 1 and i, ``place[i]`` the place of suffix
    i. The nearest smaller place on either side is found by following pointers over larger ones,
    with the least common prefix on the way; a way that has fallen under SPAN isn't followed.
    """
    n = len(place)
    best = np.zeros(n, np.int64)
    for lcp, at in ((order_lcp, place), (np.concatenate([[0], order_lcp[1:][::-1]]), place[::-1])):
        to, least = np.arange(n) - 1, lcp.astype(np.int64).copy()
        least[0] = 0
        go = np.flatnonzero((to >= 0) & (least >= SPAN))
        go = go[at[to[go]] >= at[go]]
        while len(go):
            step, low = to[to[go]], np.minimum(least[go], least[to[go]])
            to[go], least[go] = step, low
            least[go[step < 0]] = 0
            go = go[(step >= 0) & (low >= SPAN)]
            go = go[at[to[go]] >= at[go]]
        best = np.maximum(best, least if at is place else least[::-1])
    return best


def _covered(doc: np.ndarray, at: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Intervals (doc, tag, lo, hi) of the windows whose longest previous factor reaches SPAN."""
    n, lo = (at >> 7) & 127, at >> 32
    sizes = np.array([len(t) for t in texts])
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    which = np.repeat(np.arange(len(n)), n)
    step = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    windows = np.ascontiguousarray(sliding_window_view(np.frombuffer(b"".join(texts), np.uint8), SPAN)[begin[which] + step])
    order = np.argsort(windows.view(np.dtype((np.void, SPAN))).ravel(), kind="stable")
    ordered = windows[order]
    lcp = np.full(len(order), SPAN)
    lcp[0] = 0
    differ = ordered[1:] != ordered[:-1]
    some = differ.any(1)
    lcp[1:][some] = differ[some].argmax(1)
    start = lo[which] + step
    by_place = np.lexsort((start, doc[which]))
    d, s = doc[which][by_place], start[by_place]
    place = np.empty(len(order), np.int64)
    place[by_place] = np.cumsum(np.concatenate([[False], (d[1:] != d[:-1]) | (s[1:] != s[:-1])]))
    gone = order[previous_factors(lcp, place[order]) >= SPAN]
    return united(doc[which[gone]], (at[which[gone]] >> 14) & 0x3FFFF, start[gone], start[gone] + SPAN)


def _suffix_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, at, length) of what goes, from contexts in the order of their keys."""
    held: list[list] = [[], [], [], []]

    def done(rows: list[list]) -> pa.RecordBatch:
        d, tag, lo, hi = _covered(np.array(rows[1], np.int64), np.array(rows[2], np.int64), rows[3])
        return pa.RecordBatch.from_arrays([pa.array(d), pa.array(pack(lo, tag, 0, 0)), pa.array(hi - lo)], names=["doc", "at", "length"])

    size = 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if size >= BLOCK and row[0] != held[0][-1]:
                yield done(held)
                held, size = [[], [], [], []], 0
            for v, o in zip(row, held):
                o.append(v)
            size += len(row[3])
    if held[0]:
        yield done(held)


# ---- whole operator


def _cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        n_bytes, n_removed, n_spans, kept = [], [], [], []
        for text, gone in zip(as_bytes(batch.column(1)), batch.column(2)):
            spans = []
            if gone.is_valid:
                at, length = (gone.values.field(k).to_numpy(zero_copy_only=False) for k in ("at", "length"))
                own = (at >> 14) & 0x3FFFF == tag_of(text)
                lo = at[own] >> 32
                zero = np.zeros(len(lo), np.int64)
                _, _, a, b = united(zero, zero, lo, lo + length[own])
                spans = list(zip(a.tolist(), b.tolist()))
            left, end = [], 0
            for a, b in spans:
                left.append(text[end:a])
                end = b
            left.append(text[end:])
            n_bytes.append(len(text))
            n_removed.append(sum(b - a for a, b in spans))
            n_spans.append(len(spans))
            kept.append(b"".join(left))
        made = {"n_bytes": pa.array(n_bytes, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "n_spans": pa.array(n_spans, pa.int64()), "kept": pa.array(kept, pa.binary())}
        yield with_columns(batch, ["id"], made)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept) for every row of ``docs``, ``kept`` being the bytes left.

    Ids are whole numbers. A null text is empty; a text under SPAN bytes keeps all. Rows of one id are one document as to
    the order of places, so of equal rows none goes because of the other; a null id comes last.
    Texts of one id are told apart by 18 bits of a hash, contexts of one anchor by 64 bits. A cut
    may split a character of several bytes. Texts of any length are worked on in pieces; an empty
    table gives no rows; other columns of ``docs`` are not looked at.
    """
    spark = docs.sparkSession
    named = docs.select(F.coalesce(whole_number(docs, id_col), F.lit(LAST)).alias("doc"), F.col(text_col).alias("text"))
    counts = cut(named.mapInArrow(_frequent, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")))
    total = next((r.n for r in counts.filter("key IS NULL").collect()), 0)
    hot = [r.key for r in counts.filter(F.col("key").isNotNull() & (F.col("n") >= max(HOT, total >> MOST))).collect()]
    sent = spark.sparkContext.broadcast(np.array(sorted(hot), np.int64))
    rows = named.mapInArrow(functools.partial(_anchor_rows, hot=sent), _SCHEMA)
    path = shared_path(spark, "repeats")
    rows.repartition("key").sortWithinPartitions("key", "ctx", "doc", "at").mapInArrow(_told_apart, "doc long, at long, length long, key long").write.parquet(path)
    found = spark.read.schema("doc long, at long, length long, key long").parquet(path)
    by_doc = docs.select(F.coalesce(whole_number(docs, id_col), F.lit(LAST)).alias("doc"), F.col(id_col).alias("id"), F.col(text_col).alias("text")).repartition("doc")
    asked = found.filter("length = 0").repartition("doc").groupBy("doc").agg(F.collect_list(F.struct("at", "key")).alias("asked"))
    # both joins take the same columns of the texts, so one exchange of them serves both
    contexts = by_doc.join(asked.hint("shuffle_hash"), "doc", "left").select("doc", "id", "text", "asked").mapInArrow(_fetched, "key long, doc long, at long, bytes binary")
    late = contexts.repartition("key").sortWithinPartitions("key").mapInArrow(_suffix_sorted, "doc long, at long, length long")
    gone = found.filter("length > 0").select("doc", "at", "length").unionByName(late).repartition("doc").groupBy("doc").agg(F.collect_list(F.struct("at", "length")).alias("gone"))
    return by_doc.join(gone.hint("shuffle_hash"), "doc", "left").select("id", "text", "gone").mapInArrow(_cut_texts, f"id {dict(docs.dtypes)[id_col]}, n_bytes long, n_removed long, n_spans long, kept binary")


def op13_repeats(spark, sf_dir):
    found = without_repeats(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
