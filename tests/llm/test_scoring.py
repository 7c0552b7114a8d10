"""Language model, toxicity, quality rules, pseudonyms and URL lists."""

from __future__ import annotations

import datetime
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadlark.llm import lm_scoring as L
from roadlark.llm import pii, quality_rules, toxicity, url_filters

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---- language model


@pytest.mark.parametrize("head", [1 << 19, 40])
def test_scores_against_brute_force(spark, docs, texts, head, monkeypatch):
    monkeypatch.setattr(L, "HEAD", head)
    held = docs.withColumn("held_out", L.is_held_out(F.col("doc_id")))
    model, counts = L.fit(held.filter("not held_out"))
    got = L.score(held, model, counts).collect()
    tokens = lambda t: WORD.findall((t or "").translate(LOWER)) + [None]
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, t in texts if not out(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = Counter((i, t, out(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t)), 4)) for i, t in texts)
    assert Counter((r.doc_id, r.text, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(r.score < 0 for r in got)


def whole_filter(keys, counts):
    """All segments in one place."""
    seg, low = (keys >> np.uint64(32)).astype(int), keys.astype(np.uint32)
    out = {}
    for s in set(seg.tolist()):
        f = L.LogFrequencyFilter.of(s, [(low[seg == s], counts[seg == s])])
        out[s] = f.data.tobytes()
    return L.LogFrequencyFilter(out)


def test_filter_never_reads_below_a_level_and_rarely_invents():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 42, 4000).astype(np.uint64)
    counts = rng.integers(1, 5000, 4000)
    f = whole_filter(keys, counts)
    got = f.counts(keys)
    assert (got >= L.VALUES[L.level(counts)]).all() and (np.abs(got / counts - 1) < 0.1).mean() > 0.98
    assert (f.counts(rng.integers(0, 1 << 42, 20_000).astype(np.uint64)) > 0).mean() < 0.01


def test_levels_are_exact_for_small_counts_and_close_for_others():
    n = np.concatenate([np.arange(1, 5000), 10 ** np.arange(4, 12)])
    v = L.VALUES[L.level(n)]
    assert (v[: L.EXACT] == n[: L.EXACT]).all() and (np.abs(v / n - 1) <= (L.STEP - 1) / 2 + 0.01).all() and L.LEVELS < 256


def test_segment_grows_with_its_ngrams_and_their_number_with_the_tokens():
    keys = np.arange(60_000, dtype=np.uint32)
    assert (L.LogFrequencyFilter.of(3, [(keys, np.ones(len(keys), np.uint32))]).counts(keys.astype(np.uint64) | np.uint64(3 << 32)) >= 1).all()
    assert L.segment_bits(0) == L.segment_bits(10**8) == 10 and all(n / 2 ** L.segment_bits(n) <= L.SEGMENT_TOKENS for n in (10**9, 10**12, 10**14))


@pytest.mark.parametrize("chunk,bits,flush", [(4 << 20, 10, 1 << 22), (3000, 10, 50), (3000, 16, 1 << 22)])
@pytest.mark.parametrize("together", [True, False])
def test_scores_are_those_of_the_whole_filter(spark, docs, texts, chunk, bits, flush, together, monkeypatch):
    monkeypatch.setattr(L, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(L, "segment_bits", lambda n: bits)
    monkeypatch.setattr(L, "FLUSH", flush)
    held = docs.withColumn("held_out", L.is_held_out(F.col("doc_id")))
    model, counts = L.fit(held.filter("not held_out"))
    got = L.score(held, model, counts, trained=~F.col("held_out") if together else None).collect()
    ngrams = lambda t: np.split(L._keys(*L.tokens([(t or "").encode()], L.Words()), bits), 2)
    train = [t for i, t in texts if not (i is not None and zlib.crc32(str(i).encode()) % 7 == 2)]
    f = whole_filter(*np.unique(np.concatenate([x for t in train for x in ngrams(t)]), return_counts=True))
    want = Counter()
    for i, t in texts:
        c, c2 = map(f.counts, ngrams(t))
        cv = np.concatenate([c[-1:], c[:-1]])
        score = np.log10((np.minimum(c2, cv) + L.MU * (c + 1) / (model.quantised + model.v + 1)) / (cv + L.MU)).sum()
        want[i, t, round(float(score), 4)] += 1
    assert Counter((r.doc_id, r.text, round(r.score, 4)) for r in got) == want


def exact_model(train):
    """P(w | v) of the same smoothing from exact counts, with nothing hashed or quantised."""
    tokens = lambda t: WORD.findall((t or "").translate(LOWER)) + [None]
    c, pairs, after = Counter(), Counter(), Counter()
    for t in train:
        w = tokens(t)
        c.update(w)
        pairs.update(zip([None, *w[:-1]], w))
        after.update([None, *w[:-1]])
    n, v = sum(c.values()), len(c)
    return tokens, c, lambda w, v_: (pairs[v_, w] + L.MU * (c[w] + 1) / (n + v + 1)) / (after[v_] + L.MU)


def test_scores_are_close_to_those_of_exact_counts(spark, docs, texts):
    model, counts = L.fit(docs)
    tokens, c, p = exact_model([t for _, t in texts])
    assert abs(sum(p(w, "the") for w in [*c, "unseen"]) - 1) < 1e-9
    for r in L.score(docs, model, counts).collect():
        w = tokens(r.text)
        want = sum(math.log10(p(b, a)) for a, b in zip([None, *w[:-1]], w))
        assert abs(r.score - want) <= 0.01 * abs(want) + 0.05


def test_probabilities_of_a_context_sum_to_one(texts):
    """Exactly where the counts are exact; else within half a step of the scale."""
    train = [(t or "").encode() for _, t in texts]
    seen = L.Words()
    t, starts = L.tokens(train, seen)
    f = whole_filter(*np.unique(L._keys(t, starts, 10), return_counts=True))
    types, n = np.unique(t, return_counts=True)
    q = f.counts(L.unigrams(types) >> np.uint64(22))
    p1 = (q + 1) / (L.VALUES[L.level(n)].sum() + len(types) + 1)
    assert abs(p1.sum() + 1 / (L.VALUES[L.level(n)].sum() + len(types) + 1) - 1) < 1e-3
    pairs = set(zip(L.before(t, starts).tolist(), t.tolist()))
    for at in np.flatnonzero(types != L.END)[::37]:
        # The pairs that the filter was given; what it invents is bounded by the test above.
        known = np.array([w for v, w in pairs if v == int(types[at])], np.uint64)
        c2 = np.minimum(f.counts(L.bigrams(np.full(len(known), types[at]), known) >> np.uint64(22)), q[at])
        total = (c2.sum() + L.MU) / (q[at] + L.MU)
        assert abs(total - 1) < (1e-9 if n[at] <= L.EXACT else (L.STEP - 1) / 2)


def test_model_without_training_rows(spark, docs, none):
    model, counts = L.fit(none)
    r = L.score(docs, model, counts).first()
    assert r.train_tokens == 0 and r.n_known == 0
    assert L.score(none, model, counts).count() == 0


# ---- quality


def brute_quality(text):
    text = text or ""
    w = WORD.findall(text)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    again = {p for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(again)


def test_quality_counts(spark, docs, texts, none):
    got = quality_rules.quality_rules(docs).collect()
    assert Counter((r.doc_id, r.text, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == Counter((i, t, *brute_quality(t)) for i, t in texts)
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in got)
    assert not any(r.kept for r in got if r.base_failed)
    assert quality_rules.quality_rules(none).count() == 0
    once = quality_rules.quality_rules(docs, keep=["doc_id"])
    assert once.columns[0] == "doc_id" and Counter(map(tuple, once.select(*sorted(once.columns)).collect())) == Counter(tuple(r[c] for c in sorted(once.columns)) for r in got)
    assert quality_rules.quality_rules(none, keep=["doc_id"]).count() == 0


def test_repeats_of_a_very_long_text(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdeorst") for _ in range(5)) for _ in range(400)]
    text = " ".join(rng.choice(words) for _ in range(300_000))
    r = quality_rules.quality_rules(spark.createDataFrame([(1, text, "en")], "doc_id long, text string, lang string"), keep=["doc_id"]).first()
    assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_quality(text)


def test_quality_filter_keeps_its_projections(spark, docs):
    plan = quality_rules.quality_rules(docs).filter("kept")._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter (isnotnull(kept" in plan


def test_divergence_rejects_junk_and_keeps_clean(spark):
    rng = random.Random(3)
    from .conftest import make_text

    clean = [(i, make_text(rng, 200), "en") for i in range(60)]
    junk = [(100, " | ".join(make_text(rng, 200, ("zq",)).split()), "en"), (101, make_text(rng, 200).upper(), "en")]
    got = {r.doc_id: r.kept for r in quality_rules.quality_rules(spark.createDataFrame(clean + junk, "doc_id long, text string, lang string")).collect()}
    assert all(got[i] for i in range(60)) and not got[100] and not got[101]


# ---- toxicity


@pytest.fixture(scope="module")
def characters():
    rng = np.full((27, 27, 27), 0.01)
    for w in ["idiot", "stupid", "loser", "moron", "trash", "clown", "worthless", "pathetic", "the", "disgusting"]:
        s = [0, 0, *(ord(c) - 96 for c in w), 0]
        for a, b, c in zip(s, s[1:], s[2:]):
            rng[a, b, c] += 10
    return np.log(rng / rng.sum(axis=2, keepdims=True))


@pytest.mark.parametrize("said,meant", [("id1ot", "idiot"), ("$tupid", "stupid"), ("l0ser", "loser"), ("idiooot", "idiot"), ("i.d.i.o.t", "idiot"), ("tr@sh", "trash"), ("worthle$$", "worthless"), ("the", "the"), ("2024", "2024"), ("größe", "größe")])
def test_decoding(characters, said, meant):
    assert toxicity.restore(said, characters) == meant


def test_decoder_is_the_best_of_all_paths(characters):
    import itertools

    for word in ("l00ser", "m0r0n", "!d1ot"):
        paths = []
        for choice in itertools.product(*toxicity.lattice(word)):
            text = "".join(x for x, _ in choice)
            s = [0, 0, *(ord(c) - 96 for c in text), 0]
            paths.append((sum(c for _, c in choice) + sum(characters[a, b, c] for a, b, c in zip(s, s[1:], s[2:])), text))
        assert toxicity.decode(word, characters) == max(paths)[1]


@pytest.mark.parametrize("run,words", [("a i d i o t", "a idiot"), ("the l 0 s e r", "loser"), ("s t u p i d i d i o t", "stupid idiot")])
def test_spelt_words_are_parted(characters, run, words):
    model = characters.copy()
    model[0, 0, 1] = model[0, 1, 0] = -0.5  # "a" is a word
    core = run.removeprefix("the ").replace(" ", "")
    assert toxicity.decode(core, model, True).strip() == words
    if len(core) <= 8:
        assert " ".join(max(_partings(core), key=lambda parts: _path_score(parts, core, model))) == words


def _partings(core):
    import itertools

    for choice in itertools.product(*toxicity.lattice(core)):
        letters = [x for x, _ in choice]
        for breaks in itertools.product([0, 1], repeat=len(letters) - 1):
            out = letters[0]
            for x, b in zip(letters[1:], breaks):
                out += " " * b + x
            yield out.split(" ")


def _path_score(parts, core, model):
    signs = sum(toxicity.COST_SIGN for c in core if not c.isalpha())
    total = signs + toxicity.COST_BREAK * (len(parts) - 1)
    for w in parts:
        s = [0, 0, *(ord(c) - 96 for c in w), 0]
        total += sum(model[a, b, c] for a, b, c in zip(s, s[1:], s[2:]))
    return total


def brute_toxic_scores(train, texts, model):
    """Scores from sets of words and exact counts, one text at a time."""
    features = toxicity.Features(model)
    toxic, clean = sum(y for _, y in train), sum(1 - y for _, y in train)
    t, n, bits = Counter(), Counter(), {}
    for text, y in train:
        for f in {f for fs in features.of(text.encode()) for f in fs}:
            (t if y else n)[f] += 1
            if y:
                bits.setdefault(f, set()).add(toxicity._sketch(text.encode()) % 64)
    w = {f: math.log((t[f] - math.sqrt(t[f]) + 0.5) / (toxic + 1)) - math.log((n[f] + math.sqrt(n[f]) + 0.5) / (clean + 1)) for f in t if len(bits[f]) >= toxicity.MIN_SUPPORT}
    w = {f: x for f, x in w.items() if x > toxicity.MIN_WEIGHT}
    for text in texts:
        total = math.log((toxic + 1) / (clean + 1)) + sum(max((w[f] for f in fs if f in w), default=0.0) for fs in features.of(text.encode()))
        yield 1 / (1 + math.exp(-total))


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_toxic_scores_against_brute_force(spark, most, monkeypatch):
    """With the weights sent, and joined by shuffle."""
    monkeypatch.setattr(toxicity, "MAX_BROADCAST_FEATURES", most)
    rng = random.Random(8)
    from .conftest import make_text

    rows = []
    for i in range(120):
        words = make_text(rng, 30).split()
        if i % 3 == 0:
            words[5] = rng.choice(["idiot", "m0ron", "l o s e r", "clown"])
        rows.append((i, " ".join(words), int(i % 3 == 0)))
    rows += [(200, "", 0), (201, rows[0][1], 1), (201, rows[0][1], 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(3)
    model = toxicity.character_model(d)
    got = toxicity.score(d, toxicity.fit(d.select("text", "toxic"), model), keep=["doc_id"]).collect()
    want = brute_toxic_scores([(t, y) for _, t, y in rows], [t for _, t, _ in rows], model)
    assert Counter((r.doc_id, round(r.score, 9)) for r in got) == Counter((i, round(s, 9)) for (i, _, _), s in zip(rows, want))


def test_held_out_accuracy(spark):
    rng = random.Random(5)
    from .conftest import make_text

    bad = ["idiot", "m0ron", "l o s e r", "stuuupid"]
    rows = []
    for i in range(400):
        words = make_text(rng, 80).split()
        toxic = i % 4 == 0
        if toxic:
            words[10] = rng.choice(["idiot", "moron", "loser", "stupid"] if i < 300 else bad)
        rows.append((i, " ".join(words), int(toxic)))
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    scorer = toxicity.fit(d.filter("doc_id < 300").select("text", "toxic"), toxicity.character_model(d))
    got = toxicity.score(d.filter("doc_id >= 300"), scorer, keep=["doc_id", "toxic"]).collect()
    assert all((r.score >= 0.5) == bool(r.toxic) for r in got)


def test_toxicity_edges(spark, docs, none):
    scorer = toxicity.fit(docs.select("text", F.lit(1).alias("toxic")).limit(0), toxicity.character_model(none))
    assert all(0 <= r.score <= 1 for r in toxicity.score(docs, scorer).collect())
    assert toxicity.score(none, scorer).count() == 0


# ---- pseudonyms

KEY = b"a key"


def luhn_valid(rng, n=16):
    body = "4" + "".join(rng.choice("0123456789") for _ in range(n - 2))
    return body + str(-pii.luhn(body + "0") % 10)


def test_pseudonyms_round_trip_and_stay_valid():
    rng = random.Random(1)
    for _ in range(300):
        card = luhn_valid(rng)
        day = datetime.date(1900, 1, 1) + datetime.timedelta(rng.randrange(73_049))
        text = f"x {card}, {card[:4]} {card[4:8]} {card[8:12]} {card[12:]}; +1 (555) {rng.randrange(1000):03d}-{rng.randrange(10_000):04d} on {day} or {day:%d.%m.%Y} from 10.{rng.randrange(256)}.3.4 a.b{rng.randrange(99)}@example.com"
        new, found = pii.pseudonymise(text, KEY)
        assert pii.reveal(new, KEY) == pii.reveal(new, KEY, found) == text and [k for k, _, _ in found] == ["card", "card", "phone", "date", "date", "ip", "email"]
        cards = [new[a:b].replace(" ", "") for k, a, b in found if k == "card"]
        assert cards[0] == cards[1] != card and pii.luhn(cards[0]) == 0
        a, b = (new[s:e] for k, s, e in found if k == "date")
        assert datetime.date.fromisoformat(a) == datetime.datetime.strptime(b, "%d.%m.%Y").date()
        assert pii.pseudonymise(new, KEY) != (text, found)


@pytest.mark.parametrize("text", ["4539578763621487", "2024-02-30", "999.1.1.1", "000-12-3456", "DE00370400440532013000", "version 1.2.3", "", "12345"])
def test_invalid_values_stay(text):
    assert pii.pseudonymise(text, KEY) == (text, [])


@pytest.mark.parametrize("kind,ways", [
    ("date", ["2024-01-15", "2024/01/15", "01/15/2024", "15/01/2024", "15.01.2024"]),
    ("date", ["2024-03-04", "03/04/2024", "3/4/2024", "4.3.2024"]),
    ("phone", ["+49 30 1234567", "+49301234567", "+49 (30) 123-4567"]),
    ("phone", ["+1 555 234 4567", "(555) 234-4567", "555.234.4567", "+15552344567"]),
    ("card", ["4111111111111111", "4111 1111 1111 1111", "4111-1111-1111-1111"]),
    ("iban", ["DE89370400440532013000", "DE89 3704 0044 0532 0130 00"]),
    ("ip", ["2001:db8::8a2e:370:7334", "2001:0db8:0:0:0:8a2e:0370:7334"]),
])
def test_equal_values_are_linked_however_they_are_written(kind, ways):
    values = set()
    for way in ways:
        new, found = pii.pseudonymise(f"x {way} y", KEY)
        assert [k for k, _, _ in found] == [kind] and way not in new
        _, a, b = found[0]
        if kind == "date":
            p = [int(x) for x in re.split(r"\D", new[a:b])]
            values.add((p[0], p[1], p[2]) if p[0] > 31 else (p[2], p[1], p[0]) if "." in way or way.startswith("15/") else (p[2], p[0], p[1]))
        else:
            values.add(re.sub(r"[^0-9A-Fa-f:]", "", new[a:b])[-10:])
    assert len(values) == 1


@pytest.mark.parametrize("text,kinds", [("12 4111 1111 1111 1111", ["card"]), ("4111 1111 1111 1111 12", ["card"]), ("BE68 5390 0754 7034 OK", ["iban"]), ("at 2024-01-05T10:00:00Z", ["date"]),
                                        ("jürgen@example.de", ["email"]), ("10:00:00 std::vector a::b 1.2.3 +49", []), ("2024-13-45 10.0.0.1", ["ip"])])
def test_valid_values_beside_others_are_found(text, kinds):
    new, found = pii.pseudonymise(text, KEY)
    assert [k for k, _, _ in found] == kinds and pii.reveal(new, KEY, found) == text


def brute_cards(text):
    """All ways to read whole digit groups as a valid card, from the left, the longest first."""
    groups, out, i = re.findall(r"\d+", text), [], 0
    while i < len(groups):
        for j in range(len(groups), i, -1):
            d = "".join(groups[i:j])
            if 13 <= len(d) <= 19 and pii.luhn(d) == 0 and len(set(d)) > 1:
                out.append(d)
                i = j
                break
        else:
            i += 1
    return out


def test_cards_among_digit_groups_against_brute_force():
    rng = random.Random(9)
    for _ in range(300):
        groups = ["".join(rng.choice("0123456789") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(0, 4))]
        card = luhn_valid(rng)
        groups[rng.randint(0, len(groups)) : 0] = [card[k : k + 4] for k in range(0, 16, 4)]
        text = " ".join(groups)
        new, found = pii.pseudonymise(text, KEY)
        back = pii.reveal(new, KEY, found)
        assert back == text and [pii._digits(back[a:b]) for k, a, b in found if k == "card"] == brute_cards(text)


@pytest.mark.parametrize("n", [7, 100])
def test_permutation_of_a_kind_stays_in_it(n):
    p, kind = pii.Permutation(b"k", "t", n), lambda x: x % 3 == 0
    assert sorted(p(x, kind=kind) for x in range(0, n, 3)) == list(range(0, n, 3)) and all(p(p(x, kind=kind), True, kind) == x for x in range(n))


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_permutation_is_one_to_one(n):
    p = pii.Permutation(b"k", "t", n)
    assert sorted(p(x) for x in range(n)) == list(range(n)) and all(p(p(x), back=True) == x for x in range(n))


def test_pseudonym_frame(spark, docs, none):
    got = pii.pseudonyms(docs, KEY)
    assert set(got.columns) == {*docs.columns, "pii"} and got.count() == docs.count()
    assert got.filter("text is null").count() == 1
    assert pii.pseudonyms(none, KEY).count() == 0


# ---- URL lists


def test_as_of_join(spark):
    entries = spark.createDataFrame([("a", "block", "bad.org", "add", 10), ("a", "block", "bad.org", "remove", 20), ("a", "block", "bad.org", "add", 10), ("b", "allow", "ok.bad.org", "add", 5), ("c", "block", "x.org/p/", "add", 0), ("c", "block", None, "add", 0), ("d", "block", "tie.org", "add", 3), ("d", "block", "tie.org", "remove", 3)], "list string, action string, pattern string, change string, at int")
    cases = [("http://bad.org/", 9, None), ("http://bad.org/", 10, "block"), ("http://bad.org/", 19, "block"), ("http://bad.org/", 20, None), ("http://www.BAD.org:80/q", 15, "block"), ("http://notbad.org/", 15, None), ("http://ok.bad.org/", 15, "allow"),
             ("http://x.org/p/q.html", 1, "block"), ("http://x.org/pq", 1, None), ("http://u@x.org./p/?a", 1, "block"), (None, 1, None), ("nonsense", 1, None), ("http://bad.org/", None, None), ("http://tie.org/", 4, None)]
    captures = spark.createDataFrame([(i, u, t, "x") for i, (u, t, _) in enumerate(cases * 2)], "id int, url string, fetched int, matched string")
    got = {r.id: (r.decision, r.kept) for r in url_filters.filter_urls(captures, entries).collect()}
    assert got == {i: (d, d != "block") for i, (_, _, d) in enumerate(cases * 2)}
    assert url_filters.filter_urls(captures, entries.limit(0)).filter("kept").count() == 28
    assert url_filters.filter_urls(captures.limit(0), entries).count() == 0


def test_letter_case_of_patterns_and_paths(spark):
    entries = spark.createDataFrame([("a", "block", "Bad.org", "add", 1), ("a", "block", "bad.org", "remove", 5), ("b", "block", "X.org/Private/", "add", 1)], "list string, action string, pattern string, change string, at int")
    cases = [("http://bad.org/", 3, "block"), ("http://BAD.org/", 9, None), ("http://x.org/Private/a", 2, "block"), ("http://x.org/private/a", 2, None)]
    got = url_filters.filter_urls(spark.createDataFrame([(i, u, t) for i, (u, t, _) in enumerate(cases)], "id int, url string, fetched int"), entries).collect()
    assert {r.id: r.decision for r in got} == {i: d for i, (_, _, d) in enumerate(cases)}


def brute_decision(url, at, entries):
    m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@\s]+?)\.?(?::\d*)?((?:/[^?#]*)?)(?:[?#]|$)", url or "")
    if not m or at is None:
        return None
    host, folder, best = m[1].lower(), m[2].rpartition("/")[0] + "/", None
    for name, action, pattern in {e[:3] for e in entries}:
        days = sorted((e[4], e[3] == "remove") for e in entries if e[:3] == (name, action, pattern))
        on = False
        for day, remove in days:
            if day <= at:
                on = not remove
        h, slash, p = pattern.partition("/")
        if on and (host == h and ("/" + p).startswith("/") and folder.startswith("/" + p) if slash else host == h or host.endswith("." + h)):
            best = max(best or (), (len(pattern), action == "allow", pattern, name, action))
    return best and best[4]


def test_as_of_join_against_brute_force(spark):
    rng = random.Random(4)
    hosts = ["a.org", "b.a.org", "c.b.a.org", "d.com", "xd.com"]
    patterns = hosts + [f"{h}/{p}" for h in hosts for p in ("", "p/", "p/q/", "P/")]
    entries = list({(rng.choice("xy"), rng.choice(["block", "allow"]), rng.choice(patterns), day): change for day in range(20) for change in rng.choices(["add", "remove"], k=4)}.items())
    entries = [(*k[:3], change, k[3]) for k, change in entries]
    captures = [(i, f"http://{rng.choice(['', 'u@'])}{rng.choice(hosts)}{rng.choice(['', ':80', '.'])}{rng.choice(['', '/', '/p/', '/p/q/r', '/P/z?x=/p/', '/pq/'])}", rng.randrange(25)) for i in range(400)]
    long = "http://a.org/" + "d/" * 20_000
    captures += [(1000, long, 12), (1001, "http://a.org/p/q/" + "x" * 100_000, 12)]
    got = url_filters.filter_urls(spark.createDataFrame(captures, "id int, url string, fetched int"), spark.createDataFrame(entries, "list string, action string, pattern string, change string, at int")).collect()
    assert {r.id: r.decision for r in got} == {i: brute_decision(u, t, entries) for i, u, t in captures}


# ---- rows of op7


def planted_text(rng):
    """A text with known values in many ways of writing, decoys that must stay, and the values as (kind, written, canonical)."""
    found, parts = [], []
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    card = with_check(rng.choice("3456") + digits(14))
    iban = next(x for x in (f"DE{k:02d}{digits(18)}" for k in range(2, 99) for _ in range(97)) if pii._mod97(x) == 1)
    day = f"{rng.randint(1950, 2030)}-{rng.randint(1, 12):02d}-{rng.randint(13, 28):02d}"
    ssn = f"{rng.randint(100, 600)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}"
    ways = [
        ("card", card), ("card", " ".join(card[k : k + 4] for k in range(0, 16, 4))), ("card", ".".join(card[k : k + 4] for k in range(0, 16, 4))), ("card", "-".join(card[k : k + 4] for k in range(0, 16, 4))),
        ("iban", iban), ("iban", " ".join(iban[k : k + 4] for k in range(0, 22, 4))), ("iban", iban.lower()), ("date", day), ("date", day.replace("-", "/")), ("ssn", ssn), ("ip", f"10.{rng.randint(0, 255)}.{rng.randint(0, 255)}.7"), ("email", f"ann.o'neil{rng.randint(1, 99)}@example.org"),
    ]
    for kind, written in rng.sample(ways, rng.randint(1, len(ways))):
        parts += [rng.choice(["call", "see", "pay to", "on"]), (kind, written)]
        found.append(kind)
    parts += ["decoys", "1234567812345678", "999-00-1234", "2024-02-30", "300.1.1.1", "ab12 this that then when", "0000 0000 0000 0000", "SSN", ("ssn", ssn.replace("-", "")), "end-"]
    found.append("ssn")
    return parts, Counter(found)


def with_check(body):
    return body + str(-pii.luhn(body + "0") % 10)


def test_query_rows_equal_replacement_of_known_values(spark, tmp_path):
    rng, key = random.Random(17), "a key of the tests"
    made = [planted_text(rng) for _ in range(60)]
    plain = [" ".join(p if isinstance(p, str) else p[1] for p in parts) for parts, _ in made]
    rows = list(enumerate(plain)) + [(100, None), (101, ""), (101, ""), (None, plain[0]), (102, "1 " * 60_000)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.conf.set(pii.KEY_SETTING, key)
    try:
        got = pii.op7_pii(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset(pii.KEY_SETTING)
    own = {k: (" ".join(p if isinstance(p, str) else pii._MAKERS[p[0]](p[1], key.encode(), False) for p in parts), kinds) for k, (parts, kinds) in enumerate(made)}
    own |= {100: (None, Counter()), 101: ("", Counter()), None: own[0], 102: ("1 " * 60_000, Counter())}
    assert len(got) == len(rows)
    for r in got:
        text, kinds = own[r.doc_id]
        assert r.text == text and {k: r[f"n_{k}"] for k in pii.KINDS if r[f"n_{k}"]} == dict(kinds)
    one, two = (sorted(pii.op7_pii(spark, str(tmp_path)).collect(), key=repr) for _ in range(2))
    assert len(one) == len(rows) and [r.text for r in one] != [r.text for r in two], "without a setting each run has its own key"


def test_keys():
    long = b"k" * 100
    new, found = pii.pseudonymise("pay 4111 1111 1111 1111 on 2024-05-17", long)
    assert [k for k, _, _ in found] == ["card", "date"] and pii.reveal(new, long, found) == "pay 4111 1111 1111 1111 on 2024-05-17" and pii.pseudonymise(new, b"k" * 101)[0] != new
    for key in (b"", None):
        with pytest.raises(ValueError):
            pii.pseudonymise("x", key)


def test_written_alike_or_not_values_are_linked():
    card = with_check("411111111111111")
    a, b = (pii.pseudonymise(x, b"k")[0] for x in (f"{card[:4]}.{card[4:8]}.{card[8:12]}.{card[12:]}-", card))
    assert pii._digits(a) == pii._digits(b) != card and a.endswith("-")
    x, y = (pii.pseudonymise(t, b"k")[0] for t in ("GB82WEST12345698765432", "gb82west12345698765432"))
    assert x.lower() == y and x != "GB82WEST12345698765432"
    assert pii.pseudonymise("SSN 123456789", b"k")[0] == "SSN " + pii.pseudonymise("123-45-6789", b"k")[0].replace("-", "")


def test_a_pattern_with_many_changes_and_a_hot_host(spark, monkeypatch):
    monkeypatch.setattr(url_filters, "LEAST_HOT", 50)
    rng = random.Random(21)
    entries = [(name, action, "hot.example", rng.choice(["add", "remove"]), rng.randint(0, 300)) for name, action in (("a", "block"), ("b", "allow"), ("c", "block")) for _ in range(120)] + [("d", "block", "example", "add", 100), ("d", "block", "example", "remove", 200)]
    captures = [(i, rng.choice(["https://hot.example/x", "https://www.hot.example/", "https://cold.example/"]), rng.choice([None, rng.randint(-5, 305)])) for i in range(900)]
    got = url_filters.filter_urls(spark.createDataFrame(captures, "id int, url string, fetched int"), spark.createDataFrame(entries, "list string, action string, pattern string, change string, at int")).collect()
    assert {r.id: r.decision for r in got} == {i: brute_decision(u, t, entries) for i, u, t in captures}
