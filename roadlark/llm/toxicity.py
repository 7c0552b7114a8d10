"""Toxicity by a noisy channel: restore disguised words, then score the restored text.

Channel: letters written as digits or signs (leetspeak), words spelt with spaces or separators
between letters, and letters repeated. Each disguised word becomes a lattice of the letters that
it may stand for, and Viterbi decoding under a character trigram model, counted over the words
of all texts, picks the likeliest word. In a run of single characters the lattice also has a word
break after each character, so that "a l o s e r" is read as two words. Score: the words of the restored text, and their first
5 and 7 characters, are features; the log odds of those with enough support among all labelled
training texts (in at least ``MIN_SUPPORT`` different ones) make a Bernoulli model with the class
odds as its prior. A word counts once and by its strongest feature.

Counts are summed in each task and then by key; what is sent to workers has a fixed bound (a
27-letter trigram table; weights only if there are at most ``MAX_BROADCAST_FEATURES`` and labels only if
there are at most ``MAX_BROADCAST_LABELS``, else either are joined by shuffle with the same result).

Defined results: null and empty texts have no features and get the prior's score; rows with
a null or unknown label aren't learnt from; without training rows every score is the prior 0;
repeated rows get equal scores; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import as_bytes, in_pieces, with_columns
from .common import cut, fold, table

#: The letters that a sign may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c"}
SIGNS = "".join(map(re.escape, LEET))
SEPARATORS = ".-_*~"
LETTERS = 27  # a to z, and 0 for a word's edge
COST_SIGN, COST_REPEAT, COST_DOUBLE, COST_BREAK = -0.7, -0.3, -3.0, -1.5
MIN_SUPPORT, MIN_WEIGHT, MAX_BROADCAST_FEATURES = 4, 2.0, 1 << 20
MAX_BROADCAST_LABELS = 2_000_000
_EDGE = b"\"'()[]{}.,;:"
_SPELT = re.compile(rb"(?<!\S)(?:[a-z0-9@$!|+(<] ){2,}[a-z0-9@$!|+(<](?!\S)")
_OTHER = re.compile(rf"[^a-z{SIGNS}]+")
_DISGUISED = re.compile(rf"(?=.*[a-z])(?:.*[a-z{SIGNS}][{SIGNS}][a-z]|[{SIGNS}][a-z]|.*[a-z][{SIGNS}]|.*([a-z])\1\1|(?:[a-z{SIGNS}][{re.escape(SEPARATORS)}]){{2,}})")


# ---- the character model


def _letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram counts of all words made of a to z, with two edges before and one after."""
    total, words = np.zeros(LETTERS**3, np.int64), Counter()

    def flush():
        for word, n in words.items():
            w = word.strip(_EDGE)
            if w.isalpha() and w.isascii():
                s = [0, 0, *(b - 96 for b in w), 0]
                for a, b, c in zip(s, s[1:], s[2:]):
                    total[(a * LETTERS + b) * LETTERS + c] += n
        words.clear()

    for batch in batches:
        for text in as_bytes(batch.column(0)):
            words.update(text.lower().split())
            if len(words) > 400_000:
                flush()
    flush()
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["i", "n"])


def character_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """log P(c | a b) as a 27 x 27 x 27 table, from all texts."""
    sums = docs.select(text_col).mapInArrow(_letters, "i int, n long").groupBy("i").agg(F.sum("n").alias("n"))
    counts = np.full(LETTERS**3, 0.1)
    for r in sums.collect():  # 27^3 rows at most
        counts[r.i] += r.n
    counts = counts.reshape(LETTERS, LETTERS, LETTERS)
    return np.log(counts / counts.sum(axis=2, keepdims=True))


# ---- decoding


def lattice(word: str) -> list[list[tuple[str, float]]]:
    """For each run of equal characters what it may stand for, with the channel's cost."""
    out: list[list[tuple[str, float]]] = []
    i = 0
    while i < len(word):
        j = i
        while j < len(word) and word[j] == word[i]:
            j += 1
        letters = [(word[i], 0.0)] if "a" <= word[i] <= "z" else [(x, COST_SIGN) for x in LEET.get(word[i], "")]
        if not letters:
            out.append([("", 0.0)])
        elif j - i == 1:
            out.append([(x, c) for x, c in letters])
        else:
            # A double letter is mostly meant; of three or more, one or two are.
            out.append([(x * k, c + (COST_REPEAT if j - i > 2 else COST_DOUBLE * (k == 1))) for x, c in letters for k in (1, 2)])
        i = j
    return out


def decode(word: str, model: np.ndarray, breaks: bool = False) -> str:
    """The likeliest word of a disguised one's lattice; with ``breaks`` the likeliest words, a space between.

    Few states are reached at each character and paths share their beginnings, so the work is linear."""
    paths: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
    for options in lattice(word):
        new: dict[tuple[int, int], tuple[float, tuple]] = {}
        for (a, b), (score, before) in paths.items():
            for letters, cost in options:
                x, y, s = a, b, score + cost
                for ch in letters:
                    c = ord(ch) - 96
                    s += model[x, y, c]
                    x, y = y, c
                if (x, y) not in new or s > new[x, y][0]:
                    new[x, y] = (s, (before, letters))
                if breaks and letters and ((0, 0) not in new or s + model[x, y, 0] + COST_BREAK > new[0, 0][0]):
                    new[0, 0] = (s + model[x, y, 0] + COST_BREAK, (before, letters + " "))
        paths = new
    (_, last), out = max(((s + model[a, b, 0] * ((a, b) != (0, 0)), t) for (a, b), (s, t) in paths.items()), key=lambda p: p[0]), []
    while last:
        last, letters = last
        out.append(letters)
    return "".join(reversed(out))


def restore(word: str, model: np.ndarray) -> str:
    """The word itself, or what it is decoded to if it looks disguised."""
    if word.isalpha() and not re.search(r"([a-z])\1\1", word):
        return word
    if not _DISGUISED.match(word) or not all("a" <= c <= "z" or c in LEET or c in SEPARATORS for c in word):
        return word
    return decode("".join(c for c in word if c not in SEPARATORS), model)


class Features(dict):
    """Word -> its features, as hashes; forgets all when it is large."""

    def __init__(self, model: np.ndarray, most: int = 1 << 19):
        self.model, self.most = model, most

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= self.most:
            self.clear()
        core = word.strip(_EDGE).rstrip(b"!?$%&*#").strip(_EDGE).decode("utf-8", "replace")
        core = restore(core, self.model)
        out = {f"w{core}"} | {f"p{core[:n]}" for n in (5, 7) if len(core) > n} if core else set()
        self[word] = found = tuple(sorted(xxhash.xxh3_64_intdigest(f) >> 1 for f in out))
        return found

    def words(self, text: bytes) -> set[bytes]:
        text = text.lower()
        words = set(text.split())
        for m in _SPELT.finditer(text):
            words.update(w.encode() for w in self.spelt(m[0][::2].decode()) if len(w) > 2)
        return words

    def of(self, text: bytes) -> set[tuple[int, ...]]:
        """The features of each different word."""
        return set(map(self.__getitem__, self.words(text)))

    def spelt(self, letters: str) -> list[str]:
        """The words of a run of single characters; digits that stand for no letter end a word."""
        parts = (p for p in _OTHER.split(letters) if any("a" <= c <= "z" for c in p))
        return [w for p in parts for w in decode(p, self.model, True).split()]


def _evidence(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    """Rows (text, toxic) -> for each feature the texts of either kind that have it, and a bitmap of
    the toxic ones' hashes, by which copies of one text are told from different texts."""
    features = Features(model.value)
    toxic, clean, bits = Counter(), Counter(), {}

    def out():
        keys = list(toxic | clean)
        signed = [b - (1 << 64) * (b >= 1 << 63) for b in (bits.get(k, 0) for k in keys)]
        made = pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *(pa.array([c[k] for k in keys], pa.int64()) for c in (toxic, clean)), pa.array(signed, pa.int64())], names=["f", "t", "n", "bits"])
        for c in (toxic, clean, bits):
            c.clear()
        return made

    for batch in batches:
        for text, kind in zip(as_bytes(batch.column(0)), batch.column(1).to_pylist()):
            found = set().union(*map(features.__getitem__, features.words(text)))
            (toxic if kind else clean).update(found)
            if kind:
                bit = 1 << (_sketch(text) % 64)
                for f in found:
                    bits[f] = bits.get(f, 0) | bit
            if len(toxic) + len(clean) > 1 << 20:
                yield out()
    yield out()


def _sketch(text: bytes) -> int:
    """The least hash of the text's three-word runs: near copies mostly share it."""
    w = text.lower().split()
    return min((xxhash.xxh3_64_intdigest(b" ".join(w[i : i + 3])) for i in range(max(1, len(w) - 2))), default=0)


class Scorer:
    """The prior, the weights (f, w) as a dictionary or, if they are too many to send, as a table, and the character model."""

    def __init__(self, prior: float, weights: dict[int, float] | DataFrame, model: np.ndarray):
        self.prior, self.weights, self.model = prior, weights, model


def _word_features(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    """(row, text) -> a row (row, word, f) for each feature of each different word."""
    features = Features(model.value)
    for batch in batches:
        out: tuple[list, list, list] = ([], [], [])
        for row, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
            for k, fs in enumerate(features.of(text)):
                out[0].extend([row] * len(fs))
                out[1].extend([k] * len(fs))
                out[2].extend(fs)
            if len(out[0]) > 1 << 18:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["row", "word", "f"])
                out = ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["row", "word", "f"])


def _score(batches: Iterator[pa.RecordBatch], column: str, keep: list[str], scorer) -> Iterator[pa.RecordBatch]:
    scorer = scorer.value
    features, weights = Features(scorer.model), scorer.weights
    idle: set[bytes] = set()  # words known to have no weight: most
    for batch in batches:
        scores = []
        for text in as_bytes(batch.column(batch.schema.names.index(column))):
            found: dict[tuple[int, ...], float] = {}
            for word in features.words(text) - idle:
                fs = features[word]
                own = [weights[f] for f in fs if f in weights]
                if own:
                    found[fs] = max(own)
                else:
                    idle.add(word)
            if len(idle) > features.most:
                idle.clear()
            total = scorer.prior + math.fsum(found.values())
            scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, total)))))
        yield with_columns(batch, keep, {"score": pa.array(scores, pa.float64())})


def fit(train: DataFrame, model: np.ndarray) -> Scorer:
    """From (text, toxic) rows: the prior and the weights of supported features."""
    sent = train.sparkSession.sparkContext.broadcast(model)
    sizes = {r.toxic: r["count"] for r in train.groupBy("toxic").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    counted = train.select("text", "toxic").mapInArrow(functools.partial(_evidence, model=sent), "f long, t long, n long, bits long")
    sums = counted.groupBy("f").agg(F.sum("t").alias("t"), F.sum("n").alias("n"), F.bit_or("bits").alias("bits")).filter(F.bit_count("bits") >= MIN_SUPPORT)
    # Log odds with one standard deviation of either count against the feature.
    low = F.log((F.col("t") - F.sqrt(F.col("t")) + 0.5) / (toxic + 1.0)) - F.log((F.col("n") + F.sqrt(F.col("n")) + 0.5) / (clean + 1.0))
    kept = cut(sums.select("f", low.alias("w")).filter(F.col("w") > MIN_WEIGHT))
    weights = {r.f: r.w for r in kept.collect()} if kept.count() <= MAX_BROADCAST_FEATURES else kept
    return Scorer(math.log((toxic + 1) / (clean + 1)) if toxic + clean else 0.0, weights, model)


def score(docs: DataFrame, scorer: Scorer, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``score``, 0 to 1."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != "score"]
    if isinstance(scorer.weights, DataFrame):
        return _score_by_shuffle(docs, scorer, text_col, keep)
    sent = docs.sparkSession.sparkContext.broadcast(scorer)
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("score", T.DoubleType())])
    return docs.select(*dict.fromkeys([*keep, text_col])).mapInArrow(functools.partial(_score, column=text_col, keep=keep, scorer=sent), schema)


def _score_by_shuffle(docs: DataFrame, scorer: Scorer, text_col: str, keep: list[str]) -> DataFrame:
    """The same scores with the weights joined: a word counts by its strongest feature, a text by its words."""
    sent = docs.sparkSession.sparkContext.broadcast(scorer.model)
    rows = cut(docs.select(*dict.fromkeys([*keep, text_col])).withColumn("__rl_row", F.monotonically_increasing_id()))  # read from the checkpoint, so the numbers stay
    found = rows.select("__rl_row", text_col).mapInArrow(functools.partial(_word_features, model=sent), "row long, word long, f long").join(scorer.weights, "f")
    sums = found.groupBy("row", "word").agg(F.max("w").alias("w")).groupBy("row").agg(F.sum("w").alias("__rl_sum"))
    total = F.least(F.greatest(F.coalesce("__rl_sum", F.lit(0.0)) + scorer.prior, F.lit(-30.0)), F.lit(30.0))
    return rows.join(sums, F.col("__rl_row") == F.col("row"), "left").select(*keep, (1 / (1 + F.exp(-total))).alias("score"))


def op8_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    labels = labels.select("doc_id", "toxic").filter(F.col("toxic").isin(0, 1) & (fold(F.col("doc_id"), 5) != 0))
    small = labels.count() <= MAX_BROADCAST_LABELS
    train = docs.select("doc_id", "text").join(F.broadcast(labels) if small else labels, "doc_id").select("text", "toxic")
    scorer = fit(train, character_model(docs))
    held_out = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out")
    return score(docs.select("doc_id", held_out, "text"), scorer, keep=["doc_id", "held_out"]).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
