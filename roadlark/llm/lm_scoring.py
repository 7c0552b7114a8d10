"""Language-model scoring with a log-frequency Bloom filter.

A bigram model is learnt from all training texts. Counts are quantised: exactly up to ``EXACT``, then on a
log scale. An n-gram whose level is J is in the filter as (n-gram, 1) ... (n-gram, J), so a count is
read back by probing level after level until one is missing, and never comes out below its level. The filter
is cut by hash into segments, whose number follows that of the training tokens (``segment_bits``), and holds every
n-gram, so it grows with the training texts and a segment doesn't; it is never gathered in one place. Documents
are dealt into chunks of about ``CHUNK_BYTES`` of text; each chunk sends its different n-grams to their segments
by shuffle, the task that builds a segment probes it, and the levels go back to the chunk. With c the counts as
read back, q their sum over the V training tokens,
P(w | v) = (min(c(v w), c(v)) + MU * P1(w)) / (c(v) + MU), P1(w) = (c(w) + 1) / (q + V + 1).
P1 sums to 1 over the training tokens and one unknown. P(. | v) does where all counts of v are up to EXACT, but for
the filter's false positives: an unseen pair is read as one seen once at the rate
``(1 - exp(-HASHES / BITS_PER_ENTRY)) ** HASHES``, 6e-6, or a few times that (2.5e-5 measured). Above EXACT the sum is also off by what quantising does to the
counts that follow v, within half a step of the scale. No sum over the whole vocabulary is stored with a context.
Chunks are named by partition and place, so the scored table must give the same rows in the same
partitions each time it is read, as a scan or a checkpoint does; a chunk that doesn't is refused.

``base_score`` and ``n_known`` use exact counts: those of frequent tokens (at most ``HEAD``) are
sent to the workers; occurrences of all others are joined with the table of counts by shuffle.

Tokens: a text's words in lower case (A-Z), then one end. Words are known by 64-bit hashes, n-grams
in the filter by 32 bits and those of their segment. Defined results: null and empty texts are one end token; repeated rows
get equal scores and each counts in training; without training rows N = V = 0; an empty table
gives an empty table; input columns named as an output column are replaced.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import Words, as_bytes, in_pieces, with_columns
from .common import cut, fold, table

CHUNK_BYTES, BITS_PER_ENTRY, HASHES = 4 << 20, 28, 10
#: Hashes that are looked at before the others of what has them.
FIRST = 4
#: The least segments, as a power of two, and the training tokens for which there is one more segment.
LEAST_BITS, MOST_BITS, SEGMENT_TOKENS = 10, 30, 1 << 18
EXACT, STEP, LEVELS = 16, 1.15, 194
HEAD = 1 << 19
MU = 200.0
FLUSH = 1 << 22
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Comes after all segments.
_LAST = (1 << 31) - 1
END = np.uint64(xxhash.xxh3_64_intdigest(b" end"))
BEGIN = np.uint64(xxhash.xxh3_64_intdigest(b" begin"))


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def unigrams(t: np.ndarray) -> np.ndarray:
    return _mix(t * _M1)


def bigrams(v: np.ndarray, t: np.ndarray) -> np.ndarray:
    return _mix(_mix(v * _M2) + t)


def tokens(texts: list[bytes], seen: Words) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, an end after each, and where each text begins."""
    lists = [t.lower().split() for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(x) + 1 for x in lists], dtype=np.int64)])
    out = np.full(int(starts[-1]), END)
    word = np.ones(len(out), bool)
    word[starts[1:] - 1] = False
    out[word] = np.fromiter((seen[w] for x in lists for w in x), np.uint64, len(out) - len(lists))
    return out, starts


def before(t: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The token before each; BEGIN at the start of a text."""
    v = np.empty_like(t)
    v[1:] = t[:-1]
    v[starts[:-1]] = BEGIN
    return v


def _thresholds() -> np.ndarray:
    """The least count of each level: 1 to EXACT + 1, then steps of at least STEP."""
    out = list(range(1, EXACT + 2))
    while len(out) < LEVELS:
        out.append(max(out[-1] + 1, math.ceil(out[-1] * STEP)))
    return np.array(out, np.int64)


THRESHOLDS = _thresholds()
#: The count that a level is read as: the mean of the whole numbers that have it.
VALUES = np.concatenate([[0.0], (THRESHOLDS + np.append(THRESHOLDS[1:] - 1, THRESHOLDS[-1])) / 2])


def level(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(THRESHOLDS, counts, "right")


def segment_bits(n_tokens: int) -> int:
    """The segments, as a power of two, with SEGMENT_TOKENS training tokens to each at most."""
    return min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(n_tokens, 1) / SEGMENT_TOKENS))))


# ---- counting


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = (np.concatenate(x) for x in zip(*parts))
    keys, where = np.unique(keys, return_inverse=True)
    return keys, np.bincount(where, counts, len(keys)).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch], keys_of) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sums of keys over the partition, flushed whenever FLUSH different ones are held."""
    seen, parts, held = Words(), [], 0
    for batch in batches:
        texts = as_bytes(batch.column(0))
        for a, b in in_pieces(texts):
            parts.append(np.unique(keys_of(*tokens(texts[a:b], seen)), return_counts=True))
            held += len(parts[-1][0])
            if held > FLUSH:
                parts = [_merged(parts)]
                held = len(parts[0][0])
                if held > FLUSH // 2:
                    yield parts[0]
                    parts, held = [], 0
    if parts:
        yield _merged(parts)


def _count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for keys, counts in _counted(batches, lambda t, starts: t):
        for k in range(0, len(keys), 1 << 18):
            yield pa.RecordBatch.from_arrays([pa.array(keys[k : k + (1 << 18)].view(np.int64)), pa.array(counts[k : k + (1 << 18)])], names=["h", "c"])


def _keys(t: np.ndarray, starts: np.ndarray, bits: int) -> np.ndarray:
    """Of each token the unigram, then of each the bigram, as the filter knows them: ``bits`` of the segment, then 32."""
    return np.concatenate([unigrams(t), bigrams(before(t, starts), t)]) >> np.uint64(32 - bits)


def _by_segment(chunk: int | None, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row for each segment: sorted n-gram hashes and their training counts, empty if all are 0."""
    which, first = np.unique((keys >> np.uint64(32)).astype(np.int32), return_index=True)
    cuts, low = np.append(first, len(keys)), keys.astype(np.uint32)
    for k in range(0, len(which), 4096):
        some = range(k, min(k + 4096, len(which)))
        own = [counts[cuts[i] : cuts[i + 1]] for i in some]
        packed = [c.astype(np.uint8 if c.max() < 256 else np.uint32 if c.max() < 1 << 32 else np.uint64).tobytes() if c.any() else b"" for c in own]
        yield pa.RecordBatch.from_arrays(
            [pa.array(which[k : k + len(some)]), pa.array([chunk] * len(some), pa.int64()), pa.array([low[cuts[i] : cuts[i + 1]].tobytes() for i in some], pa.binary()), pa.array(packed, pa.binary())],
            names=["segment", "chunk", "hashes", "counts"])


def _count_ngrams(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    for keys, counts in _counted(batches, functools.partial(_keys, bits=bits)):
        yield from _by_segment(None, keys, counts)


# ---- chunks: what they ask, what they are answered


def _dealt(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[int, pa.RecordBatch, list[bytes]]]:
    """Chunk, rows and texts. Where a chunk ends follows from the texts alone, not from the batches."""
    chunk, held = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        texts, start = as_bytes(batch.column(batch.schema.names.index(column))), 0
        for i, t in enumerate(texts):
            if held and held + len(t) > CHUNK_BYTES:
                if start < i:
                    yield chunk, batch.slice(start, i - start), texts[start:i]
                chunk, held, start = chunk + 1, 0, i
            held += len(t) + 64
        if start < len(texts):
            yield chunk, batch.slice(start), texts[start:]


def _homes(batches: Iterator[pa.RecordBatch], column: str, keep: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows with their chunk, in the order after its segments."""
    for chunk, rows, _ in _dealt(batches, column):
        n = rows.num_rows
        yield with_columns(rows, keep, {"__rl_chunk": pa.array([chunk] * n, pa.int64()), "__rl_segment": pa.array([_LAST] * n, pa.int32())})


def _asked(batches: Iterator[pa.RecordBatch], column: str, bits: int) -> Iterator[pa.RecordBatch]:
    """Each chunk's different n-grams, with how often its training texts (``__rl_train``) have them."""
    seen = Words()

    def rows() -> Iterator[pa.RecordBatch]:
        t, starts = tokens([x for texts, _ in held for x in texts], seen)
        train = np.repeat(np.concatenate([x for _, x in held]), np.diff(starts)).astype(np.uint64)
        both, n = np.unique((_keys(t, starts, bits) << np.uint64(1)) | np.concatenate([train, train]), return_counts=True)
        keys = both >> np.uint64(1)
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        yield from _by_segment(now, keys[first], np.add.reduceat(np.where(both & np.uint64(1), n, 0), first))

    now, held = None, []
    for chunk, batch, texts in _dealt(batches, column):
        if chunk != now and held:
            yield from rows()
            held = []
        now = chunk
        held.append((texts, batch.column(batch.schema.names.index("__rl_train")).to_numpy(zero_copy_only=False).astype(bool)))
    if held:
        yield from rows()


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of segment -> the segment is built, and the levels of what each chunk asked are read from it."""
    now, held = None, None
    for batch in batches:
        for s, chunk, h, c in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if s != now:
                if held:
                    yield from held.answers()
                now, held = s, _Segment(s)
            held.add(chunk, h, c)
    if held:
        yield from held.answers()


class _Segment:
    """What has come for one segment: counts, summed as they come, and the chunks with what they ask, packed."""

    def __init__(self, segment: int):
        self.segment, self.counted, self.new = segment, [], 0
        self.chunks: list[int] = []
        self.sizes: list[int] = []
        self.asked = bytearray()

    def add(self, chunk: int | None, hashes: bytes, counts: bytes) -> None:
        keys = np.frombuffer(hashes, np.uint32)
        if counts:
            c = np.frombuffer(counts, {1: np.uint8, 4: np.uint32, 8: np.uint64}[len(counts) // len(keys)])
            self.counted.append((keys[c > 0], c[c > 0]))
            self.new += len(self.counted[-1][0])
            if self.new > FLUSH:
                self.counted, self.new = [_merged(self.counted)], 0
        if chunk is not None:
            self.chunks.append(chunk)
            self.sizes.append(len(keys))
            self.asked += hashes

    def answers(self) -> Iterator[pa.RecordBatch]:
        found, asked = LogFrequencyFilter.of(self.segment, self.counted), np.frombuffer(self.asked, np.uint32)
        different = np.unique(asked)
        levels, at = found.levels(different.astype(np.uint64) | np.uint64(self.segment << 32)).astype(np.uint8), 0
        for k in range(0, len(self.chunks), 4096):
            rows = []
            for n in self.sizes[k : k + 4096]:
                rows.append(levels[np.searchsorted(different, asked[at : at + n])].tobytes())
                at += n
            yield pa.RecordBatch.from_arrays([pa.array(self.chunks[k : k + 4096], pa.int64()), pa.array([self.segment] * len(rows), pa.int32()), pa.array(rows, pa.binary())], names=["__rl_chunk", "__rl_segment", "__rl_levels"])


def positions(keys: np.ndarray, j: int, bits, first: int = 0, last: int = HASHES) -> Iterator[np.ndarray]:
    x = _mix(keys * _M1 + np.uint64(j * int(_M2) % (1 << 64)))
    a, step = x & np.uint64(0xFFFFFFFF), (x >> np.uint64(32)) | np.uint64(1)
    for i in range(first, last):
        yield ((a + np.uint64(i) * step) % bits).astype(np.int64)


class LogFrequencyFilter:
    """Quantised counts of n-grams, as a Bloom filter in segments, or one segment of it."""

    def __init__(self, segments: dict[int, bytes]):
        own = sorted(segments.items()) or [(0, b"\0" * 8)]
        self.segments = np.array([s for s, _ in own], np.int64)
        self.bits = np.array([len(x) * 8 for _, x in own], np.uint64)
        self.offsets = np.concatenate([[0], np.cumsum([len(x) for _, x in own])[:-1]]).astype(np.int64)
        self.data = np.frombuffer(b"".join(x for _, x in own), np.uint8)

    @classmethod
    def of(cls, segment: int, parts: list[tuple[np.ndarray, np.ndarray]]) -> LogFrequencyFilter:
        """The segment of these counts (32-bit hashes, counts), which may name an n-gram more than once."""
        keys, counts = _merged(parts) if parts else (np.empty(0, np.uint32), np.empty(0, np.int64))
        levels = level(counts)
        bits = max(64, -(-int(levels.sum()) * BITS_PER_ENTRY // 8) * 8)
        out = np.zeros(bits, bool)
        for j in range(1, int(levels.max(initial=0)) + 1):
            keys, levels = keys[levels >= j], levels[levels >= j]
            for p in positions(keys.astype(np.uint64) | np.uint64(segment << 32), j, np.uint64(bits)):
                out[p] = True
        return cls({segment: np.packbits(out, bitorder="little").tobytes()})

    def counts(self, keys: np.ndarray) -> np.ndarray:
        return VALUES[self.levels(keys)]

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Levels of n-grams as ``_keys`` names them; 0 in a segment that isn't there."""
        segment = (keys >> np.uint64(32)).astype(np.int64)
        at = np.minimum(np.searchsorted(self.segments, segment), len(self.segments) - 1)
        found, active = np.zeros(len(keys), np.int64), np.flatnonzero(self.segments[at] == segment)
        for j in range(1, LEVELS + 1):
            for first, last in ((0, FIRST), (FIRST, HASHES)):
                s = at[active]
                bits, offsets = self.bits[s], self.offsets[s]
                here = np.ones(len(active), bool)
                for p in positions(keys[active], j, bits, first, last):
                    here &= (self.data[offsets + (p >> 3)] >> (p & 7).astype(np.uint8)) & 1 == 1
                active = active[here]
            if not len(active):
                break
            found[active] = j
        return found


class Model:
    """N, V, the sum of the quantised counts, the exact counts of the frequent tokens and, on the driver only, the training texts."""

    def __init__(self, n: int, v: int, quantised: float, head: np.ndarray, head_counts: np.ndarray, complete: bool, texts: DataFrame | None = None):
        self.n, self.v, self.quantised, self.complete, self.texts = n, v, quantised, complete, texts
        self.bits = segment_bits(n)
        order = np.argsort(head)
        self.head, self.head_counts = head[order], head_counts[order]

    def __getstate__(self) -> dict:
        return self.__dict__ | {"texts": None}

    def exact(self, t: np.ndarray) -> np.ndarray:
        """Counts of the frequent tokens, 0 for others."""
        if not len(self.head):
            return np.zeros(len(t), np.int64)
        at = np.minimum(np.searchsorted(self.head, t), len(self.head) - 1)
        return np.where(self.head[at] == t, self.head_counts[at], 0)

    def log10_probabilities(self, t: np.ndarray, starts: np.ndarray, levels: np.ndarray) -> np.ndarray:
        """Of each token, from the levels of its chunk's different n-grams in their order."""
        keys, where = np.unique(_keys(t, starts, self.bits), return_inverse=True)
        if len(keys) != len(levels):
            raise RuntimeError("the scored table gave other rows when read again; pass a scan or a checkpoint")
        c = VALUES[levels[where]]
        cw, c2 = c[: len(t)], c[len(t) :]
        cv = np.empty_like(cw)
        cv[1:] = cw[:-1]
        cv[starts[:-1]] = cw[-1]  # as many texts begin as end
        return np.log10((np.minimum(c2, cv) + MU * (cw + 1) / (self.quantised + self.v + 1)) / (cv + MU))


MADE = [("n_tokens", T.LongType()), ("n_known", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType()), ("rare", T.ArrayType(T.LongType())), ("rare_n", T.ArrayType(T.LongType()))]


def _score(batches: Iterator[pa.RecordBatch], column: str, keep: list[str], model) -> Iterator[pa.RecordBatch]:
    """Rows in the order of chunk and segment -> scores of the chunk's documents."""
    model, seen, now, levels, held = model.value, Words(), None, [], []
    for batch in batches:
        chunk, segment = (batch.column(batch.schema.names.index(c)).to_numpy(zero_copy_only=False) for c in ("__rl_chunk", "__rl_segment"))
        cuts = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(chunk)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if chunk[a] != now and held:
                yield from _score_chunk(held, levels, column, keep, model, seen)
            if chunk[a] != now:
                now, levels, held = chunk[a], [], []
            docs = a + int(np.searchsorted(segment[a:b], _LAST))
            levels += batch.column(batch.schema.names.index("__rl_levels")).slice(a, docs - a).to_pylist()
            if docs < b:
                held.append(batch.slice(docs, b - docs))
    if held:
        yield from _score_chunk(held, levels, column, keep, model, seen)


def _score_chunk(held: list[pa.RecordBatch], levels: list[bytes], column: str, keep: list[str], model: Model, seen: Words) -> Iterator[pa.RecordBatch]:
    """``rare`` are the tokens, with counts, that the exact table of frequent ones doesn't hold."""
    t, starts = tokens([x for batch in held for x in as_bytes(batch.column(batch.schema.names.index(column)))], seen)
    c = model.exact(t)
    base = np.log10((c + 1) / (model.n + model.v + 1))
    if not model.complete:
        base[c == 0] = 0.0
    total = lambda x: np.add.reduceat(x, starts[:-1])
    rare, rare_n = [], []
    for a, b in zip(starts, starts[1:]):
        own = t[a:b]
        ids, n = np.unique(own[c[a:b] == 0], return_counts=True) if not model.complete else (own[:0], own[:0])
        rare.append(ids.view(np.int64))
        rare_n.append(n.astype(np.int64))
    p = model.log10_probabilities(t, starts, np.frombuffer(b"".join(levels), np.uint8))
    types = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    made = [(name, pa.array(x, k)) for (name, _), x, k in zip(MADE, (np.diff(starts), total((c > 0).astype(np.int64)), total(base), total(p), rare, rare_n), types)]
    at = 0
    for batch in held:
        yield with_columns(batch, keep, {name: x.slice(at, batch.num_rows) for name, x in made})
        at += batch.num_rows


def _quantised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield pa.RecordBatch.from_arrays([pa.array([float(sum(VALUES[level(b.column(0).to_numpy(zero_copy_only=False))].sum() for b in batches))])], names=["q"])


def fit(train: DataFrame, text_col: str = "text") -> tuple[Model, DataFrame]:
    """The model, and the table (h, c) of all token counts."""
    texts = train.select(F.col(text_col))
    counts = cut(texts.mapInArrow(_count_tokens, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")))
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # The least count at which at most HEAD tokens have it or more, to 5 %: at most a few hundred rows.
    step = F.floor(F.log(F.col("c").cast("double")) / F.log(F.lit(1.05)))
    held, least = 0, None
    for s, size, low in sorted(counts.groupBy(step.alias("s")).agg(F.count("*"), F.min("c")).collect(), reverse=True):
        if held + size > HEAD:
            break
        held, least = held + size, low
    head = counts.filter(F.col("c") >= (least or 0)).toArrow() if least else None
    ids, sums = (head.column(k).to_numpy() for k in (0, 1)) if head else (np.empty(0, np.int64), np.empty(0, np.int64))
    quantised = counts.select("c").mapInArrow(_quantised, "q double").agg(F.coalesce(F.sum("q"), F.lit(0.0))).first()[0]
    return Model(n, v, quantised, ids.view(np.uint64), sums, held == v, texts), counts


def score(docs: DataFrame, model: Model, counts: DataFrame, text_col: str = "text", keep: list[str] | None = None, trained: Column | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with n_tokens, n_known, train_tokens, base_score and score.

    ``trained`` says which rows of ``docs`` are all those that ``model`` was fitted to; without it the
    training texts are read on their own.
    """
    made = [name for name, _ in MADE]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in [*made, "train_tokens"]]
    sent = docs.sparkSession.sparkContext.broadcast(model)
    ngrams = "segment int, chunk long, hashes binary, counts binary"
    asked = docs.select(text_col, F.coalesce(F.lit(False) if trained is None else trained, F.lit(False)).alias("__rl_train")).mapInArrow(functools.partial(_asked, column=text_col, bits=model.bits), ngrams)
    if trained is None:
        asked = asked.unionAll(model.texts.mapInArrow(functools.partial(_count_ngrams, bits=model.bits), ngrams))
    answers = asked.repartition("segment").sortWithinPartitions("segment").mapInArrow(_answers, "__rl_chunk long, __rl_segment int, __rl_levels binary")
    own = list(dict.fromkeys([*keep, text_col]))
    homes = docs.select(*own).mapInArrow(functools.partial(_homes, column=text_col, keep=own), T.StructType([T.StructField(c, docs.schema[c].dataType) for c in own] + [T.StructField("__rl_chunk", T.LongType()), T.StructField("__rl_segment", T.IntegerType())]))
    met = homes.unionByName(answers, allowMissingColumns=True).repartition("__rl_chunk").sortWithinPartitions("__rl_chunk", "__rl_segment")
    schema = T.StructType([T.StructField(c, docs.schema[c].dataType) for c in keep] + [T.StructField(n, k) for n, k in MADE])
    out = met.mapInArrow(functools.partial(_score, column=text_col, keep=keep, model=sent), schema)
    if not model.complete:
        out = cut(out).withColumn("__rl_row", F.monotonically_increasing_id())  # stable, for it reads a checkpoint
        rare = out.select("__rl_row", F.explode(F.arrays_zip("rare", "rare_n")).alias("x")).select("__rl_row", "x.rare", "x.rare_n")
        known = rare.join(counts.filter(F.col("c") < int(model.head_counts.min(initial=1 << 62))), F.col("rare") == F.col("h"), "left")
        sums = known.groupBy("__rl_row").agg(
            F.sum(F.when(F.col("c") > 0, F.col("rare_n")).otherwise(0)).alias("__rl_known"),
            F.sum(F.col("rare_n") * F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(float(model.n + model.v + 1)))).alias("__rl_base"))
        out = out.join(sums, "__rl_row", "left").withColumns({"n_known": F.col("n_known") + F.coalesce("__rl_known", F.lit(0)), "base_score": F.col("base_score") + F.coalesce("__rl_base", F.lit(0.0))})
    return out.withColumn("train_tokens", F.lit(model.n).cast("long")).select(*keep, "n_tokens", "n_known", "train_tokens", "base_score", "score")


def is_held_out(id_col: Column) -> Column:
    return F.coalesce(fold(id_col, 7) == 2, F.lit(False))


def op2_lm_scoring(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", is_held_out(F.col("doc_id")).alias("held_out"))
    model, counts = fit(docs.filter("not held_out"))
    return score(docs, model, counts, keep=["doc_id", "held_out"], trained=~F.col("held_out"))
