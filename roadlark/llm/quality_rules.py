"""Distribution-divergence quality rules (native expressions only).

A document's character-class and common-word histograms are compared with those of its
language by Jensen-Shannon distance; short texts and languages without a word list are
not judged by divergence. Everything stays in JVM expressions, one row in, one row out:
no word ever leaves its row, so neither a hot source nor a very long text skews a task.

Defined results: null and empty texts have no words and fail the base rules; a null or
unlisted ``lang`` has no reference, so only the base rules count; repeated rows and ties
are judged row by row; an empty table gives an empty table; input columns with the name
of an output column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, cut, table

#: Frequent function words by language.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "as", "with"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un"],
}
N_COMMON = 12
_ANY_COMMON = sorted({w for words in COMMON_WORDS.values() for w in words})
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Distances are in base 2, 0 to 1. Characters: above this a text is unlike its language.
#: Words: above this share of the distance that a text without any common word has.
MAX_CHAR_DISTANCE = 0.27
MAX_WORD_SHARE = 0.94
MIN_CHARS_JUDGED = 200
MIN_WORDS_JUDGED = 50

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_T, _L, _W = "__rl_text", "__rl_lang", "__rl_words"
_STRIPPED = ["[a-z]+", f"[{SPACES}]+", "[A-Z]+", "[0-9]+", r"[^\x00-\x7F]+", r"[#*$%&|<>]+"]


def _word_list() -> Column:
    """The common words of a row's language, padded with spaces; null where there is no list."""
    out = F.when(F.lit(False), F.array().cast("array<string>"))
    for lang, words in COMMON_WORDS.items():
        out = out.when(F.col(_L) == lang, F.array(*(F.lit(f" {w} ") for w in words)))
    return out


def _histograms(df: DataFrame) -> DataFrame:
    """Add the word array, n_words, character classes (``__rl_chars``) and counts of the common
    words and of all others (``__rl_common``, null without a list)."""
    df = df.withColumn(_W, F.array_remove(F.split(F.col(_T), f"[{SPACES}]+"), ""))
    df = df.withColumns({"n_words": F.size(_W).cast("long"), "__rl_joined": F.concat(F.lit(" "), F.array_join(F.filter(_W, lambda w: w.isin(*_ANY_COMMON)), "  "), F.lit(" ")), "__rl_list": _word_list()})
    rest, lengths = F.col(_T), [F.length(_T)]
    for k, pattern in enumerate(_STRIPPED):
        df = df.withColumn(f"__rl_s{k}", F.regexp_replace(rest, pattern, ""))
        rest = F.col(f"__rl_s{k}")
        lengths.append(F.length(rest))
    df = df.withColumn("__rl_lengths", F.array(*(x.cast("long") for x in lengths)))
    joined = F.col("__rl_joined")
    seen = F.transform("__rl_list", lambda w: F.try_divide(F.length(joined) - F.length(F.replace(joined, w, F.lit(""))), F.length(w)).cast("long"))
    df = df.withColumns({
        "__rl_chars": F.transform("__rl_lengths", lambda x, i: x - F.coalesce(F.get("__rl_lengths", i + 1), F.lit(0).cast("long"))),
        "__rl_common": seen,
    })
    others = F.col("n_words") - F.aggregate("__rl_common", F.lit(0).cast("long"), lambda a, x: a + x)
    df = df.withColumn("__rl_common", F.when(F.col("__rl_common").isNotNull(), F.concat("__rl_common", F.array(others))))
    return df.drop("__rl_joined", "__rl_list", "__rl_lengths", *(f"__rl_s{k}" for k in range(len(_STRIPPED))))


def _repeated(df: DataFrame) -> DataFrame:
    """Add ``n_repeat_words``: words inside 3-word windows that the text has twice or more.

    Windows are sorted as (hash, position), with all 64 bits of the hash, so equal windows are neighbours
    that carry their positions; neighbours with equal hashes count only if their words are equal.
    """
    windows = F.transform(
        F.when(F.col("n_words") >= 3, F.sequence(F.lit(0), (F.col("n_words") - 3).cast("int"))).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(F.xxhash64(F.get(_W, i), F.get(_W, i + 1), F.get(_W, i + 2)).alias("h"), i.alias("p")),
    )
    df = df.withColumn("__rl_sorted", F.sort_array(windows))
    word = lambda x, k: F.get(_W, x.p + k)
    same = lambda x, y: (x.h == y.h) & (word(x, 0) == word(y, 0)) & (word(x, 1) == word(y, 1)) & (word(x, 2) == word(y, 2))
    at = lambda i: F.get("__rl_sorted", i)
    twice = F.filter("__rl_sorted", lambda x, i: same(x, at(i - 1)) | same(x, at(i + 1)))
    df = df.withColumn("__rl_twice", F.sort_array(F.transform(twice, lambda x: x.p.cast("long"))))
    spans = F.transform("__rl_twice", lambda p, i: F.least(F.lit(3).cast("long"), F.coalesce(F.get("__rl_twice", i + 1) - p, F.lit(3).cast("long"))))
    df = df.withColumn("n_repeat_words", F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + x))
    return df.drop("__rl_sorted", "__rl_twice")


def _shares(name: str) -> Column:
    total = F.aggregate(name, F.lit(0).cast("long"), lambda a, x: a + x)
    return F.transform(name, lambda x: F.try_divide(x.cast("double"), total))


def _distance(p: str, q: str) -> Column:
    """Jensen-Shannon distance of two columns of shares, in base 2; null where either is null or empty."""
    h = lambda x: F.when(x > 0, -x * F.log2(x)).when(x.isNotNull(), F.lit(0.0))
    terms = F.zip_with(p, q, lambda x, y: h((x + y) / 2) - (h(x) + h(y)) / 2)
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x), F.lit(0.0)))


def language_references(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Shares over all rows of each listed language: at most len(COMMON_WORDS) rows."""
    src = df.select(F.coalesce(F.col(text_col), F.lit("")).alias(_T), F.col(lang_col).alias(_L)).filter(F.col(_L).isin(*COMMON_WORDS))
    return _references(_histograms(src))


def _references(h: DataFrame) -> DataFrame:
    sums = lambda name, n: F.array(*(F.sum(F.get(name, F.lit(k))) for k in range(n)))
    refs = h.filter(F.col(_L).isin(*COMMON_WORDS)).groupBy(F.col(_L).alias("__rl_ref")).agg(sums("__rl_chars", len(_STRIPPED) + 1).alias("__rl_rc"), sums("__rl_common", N_COMMON + 1).alias("__rl_rw"))
    return refs.withColumns({"__rl_rc": _shares("__rl_rc"), "__rl_rw": _shares("__rl_rw")})


def quality_rules(df: DataFrame, text_col: str = "text", lang_col: str = "lang", references: DataFrame | None = None, max_char_distance: float = MAX_CHAR_DISTANCE, max_word_share: float = MAX_WORD_SHARE, keep: list[str] | None = None) -> DataFrame:
    """``df`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, char_distance,
    word_distance, base_failed and kept. ``references`` defaults to those of ``df`` itself, for which the
    texts are read twice, or once if the text itself isn't to be returned (``keep``): what is counted is then
    small and goes to a checkpoint that both the references and the verdicts read."""
    made = [*BASE, "char_distance", "word_distance", "base_failed", "kept"]
    kept = [c for c in (df.columns if keep is None else keep) if c not in made]
    src = df.select(*kept, F.coalesce(F.col(text_col), F.lit("")).alias(_T), F.col(lang_col).alias(_L))
    h = _repeated(_histograms(src))
    lines = F.filter(F.split(F.col(_T), "\n"), lambda x: x.rlike(f"[^{SPACES}]"))
    h = h.withColumn("__rl_lines", lines).withColumns({
        "word_chars": F.length(_T).cast("long") - F.get("__rl_chars", F.lit(1)),
        "n_symbols": F.get("__rl_chars", F.lit(5)),
        "n_dup_lines": (F.size("__rl_lines") - F.size(F.array_distinct("__rl_lines"))).cast("long"),
    }).drop("__rl_lines", _W, _T)
    if references is None and text_col not in kept:
        h = cut(h)
        references = _references(h)
    elif references is None:
        references = language_references(df, text_col, lang_col)
    h = h.withColumns({"__rl_n": F.aggregate("__rl_chars", F.lit(0).cast("long"), lambda a, x: a + x), "__rl_chars": _shares("__rl_chars"), "__rl_common": _shares("__rl_common")})
    # At most one row for each listed language, so the broadcast's size is fixed by COMMON_WORDS.
    h = h.join(F.broadcast(references), F.col(_L) == F.col("__rl_ref"), "left")
    h = h.withColumn("__rl_none", F.array(*[F.lit(0.0)] * N_COMMON, F.lit(1.0)))
    h = h.withColumns({
        "char_distance": F.when(F.col("__rl_n") >= MIN_CHARS_JUDGED, _distance("__rl_chars", "__rl_rc")),
        "word_distance": F.when(F.col("n_words") >= MIN_WORDS_JUDGED, _distance("__rl_common", "__rl_rw")),
        "__rl_most": _distance("__rl_none", "__rl_rw"),
        "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
    })
    far = (F.col("char_distance") > max_char_distance) | (F.col("word_distance") > max_word_share * F.col("__rl_most"))
    # A partition id is never negative. It keeps the optimizer from moving a later filter on ``kept`` below the
    # projections, where each step's expression would be written out wherever the next one uses it.
    verdict = F.when(F.spark_partition_id() >= 0, ~F.col("base_failed") & ~F.coalesce(far, F.lit(False))).otherwise(F.lit(False))
    return h.withColumn("kept", verdict).select(*kept, *made)


def op6_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return quality_rules(docs, keep=["doc_id"]).select("doc_id", *BASE, "base_failed", "kept")
