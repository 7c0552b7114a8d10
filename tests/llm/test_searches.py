"""The conversation trie, hard negatives and repeated strings against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from roadlark.llm import negatives as N
from roadlark.llm import prefix_trie as P
from roadlark.llm import repeats as R

# ---- repeated strings


def repeats_by_force(rows):
    first, texts = {}, [((R.LAST if i is None else i), (t or "").encode()) for i, t in rows]
    for i, b in texts:
        for p in range(len(b) - R.SPAN + 1):
            w = b[p : p + R.SPAN]
            first[w] = min(first.get(w, (i, p)), (i, p))
    out = []
    for (i, b), (own, _) in zip(texts, rows):
        gone = np.zeros(len(b) + 1, int)
        for p in range(len(b) - R.SPAN + 1):
            if first[b[p : p + R.SPAN]] < (i, p):
                gone[p : p + R.SPAN] = 1
        kept = bytes(np.frombuffer(b, np.uint8)[gone[: len(b)] == 0])
        out.append((own, len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def test_repeats_equal_brute_force(spark, texts, docs, none):
    line = "This line of more than a hundred bytes stands in many of the documents of this collection, again and again, it does. "
    rng = random.Random(3)
    more = [(200 + k, "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 300))) + line + "".join(rng.choice("abcdefgh ") for _ in range(150))) for k in range(40)]
    more += [(7, line + "same id, other text " + line), (300, "ab" * 400), (301, "\x00" * 250 + "z"), (-5, "é漢" * 120 + line), (302, line[:99]), (303, line[:100])]
    every = texts + more
    df = docs.select("doc_id", "text", "fp", F.lit(1).alias("at"), F.lit(2).alias("doc"), F.lit("x").alias("id")).unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    got = R.without_repeats(df)
    assert Counter((r.id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got.collect()) == repeats_by_force(every)
    assert R.without_repeats(none).count() == 0
    assert R.without_repeats(spark.createDataFrame([(None, None), (1, "")], "doc_id long, text string")).count() == 2


def found_here(rows, hot, monkeypatch, **limits):
    """The stages one after the other in this process, under small limits."""
    for k, v in limits.items():
        monkeypatch.setattr(R, k, v)
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([t for _, t in rows])], names=["doc", "text"])

    def by(batches, *names):
        whole = pa.Table.from_batches(list(batches)).combine_chunks()
        return whole.take(pa.compute.sort_indices(whole, [(n, "ascending") for n in names])).to_batches(max_chunksize=50)

    found = pa.Table.from_batches(list(R._told_apart(iter(by(R._anchor_rows(iter([batch]), SimpleNamespace(value=np.array(sorted(hot), np.int64))), "key", "ctx", "doc", "at"))))).to_pylist()
    texts = dict(rows)
    asked = {}
    for r in found:
        if not r["length"]:
            asked.setdefault(r["doc"], []).append({"at": r["at"], "key": r["key"]})
    ids = sorted(texts)
    fetched = R._fetched(iter([pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids), pa.array([texts[i] for i in ids]), pa.array([asked.get(i) for i in ids], pa.list_(pa.struct([("at", pa.int64()), ("key", pa.int64())])))], names=list("abcd"))]))
    late = [r for b in R._suffix_sorted(iter(by(fetched, "key"))) for r in b.to_pylist()]
    gone = {i: np.zeros(len(texts[i].encode()) + 1, int) for i in ids}
    for r in [*found, *late]:
        gone[r["doc"]][r["at"] >> 32 : (r["at"] >> 32) + r["length"]] = 1
    return Counter((i, int(g.sum())) for i, g in gone.items()), len(late)


@pytest.mark.parametrize("hot", [False, True])
def test_repeats_in_pieces_and_with_frequent_anchors(monkeypatch, hot):
    rng = random.Random(5)
    passages = ["".join(rng.choice("abcdefghij ") for _ in range(rng.choice([90, 130, 400]))) for _ in range(6)]
    rows = [(i, "".join(rng.choice(passages) if rng.random() < 0.4 else "".join(rng.choice("abcd") for _ in range(70)) for _ in range(8))) for i in range(60)]
    keys = set()
    if hot:
        keys = {int(h) for _, t in rows for h in R.anchors(np.frombuffer(t.encode(), np.uint8))[0].tolist()[::2]}
    got, _ = found_here(rows, keys, monkeypatch, PIECE=150, CHUNK=2000, BLOCK=3000)
    assert got == Counter({(i, n): 1 for i, _, n, _, _ in repeats_by_force(rows)})


def test_frequent_anchors_are_counted_by_chunk():
    line = "a line that every document holds, and that is longer than the hundred bytes of a span, so it has windows of its own here"
    rng = random.Random(1)
    noise = lambda: "".join(rng.choice("abcdefgh") for _ in range(200))
    batch = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array([noise() + line + noise() for _ in range(40)])], names=["doc", "text"])
    found = [r for b in R._frequent(iter([batch])) for r in b.to_pylist()]
    assert found[0]["key"] is None and any(r["n"] == 40 for r in found[1:]) and all(r["n"] >= R.SEEN for r in found[1:])


def test_previous_factors_equal_brute_force():
    rng = random.Random(2)
    for n in [1, 2, 50, 400]:
        lcp = np.array([0] + [rng.choice([3, 99, 100, 100, 100]) for _ in range(n - 1)])
        place = np.array([rng.randrange(n) for _ in range(n)])
        got = P_reaches(R.previous_factors(lcp, place))
        want = []
        for i in range(n):
            best = 0
            for j in range(n):
                if place[j] < place[i]:
                    a, b = min(i, j), max(i, j)
                    best = max(best, int(lcp[a + 1 : b + 1].min()))
            want.append(best >= R.SPAN)
        assert got == want


def P_reaches(values):
    return (values >= R.SPAN).tolist()


# ---- hard negatives


def negatives_by_force(rows, positives=5, negatives=3):
    part = []
    for i, v, n in rows:
        if n is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        n = (n + 1) % 10 if i is not None and i % 7 == 0 else n
        part.append((i, [math.floor(256 * x) for x in v], n))
    last = lambda i: (i is None, i or 0)
    out = []
    for a, (i, v, n) in enumerate(part):
        if i is None or i % 50:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(v, w)), last(j), j, m) for b, (j, w, m) in enumerate(part) if b != a), key=lambda x: x[:2])
        for s, _, p, _ in [x for x in scored if x[3] == n][:positives]:
            for rank, (t, _, q, _) in enumerate([x for x in scored if x[3] != n and 50 * -s <= 100 * -x[0] <= 95 * -s][:negatives], 1):
                out.append((i, p, rank, q, -s, -t))
    return Counter(out)


def test_negatives_equal_brute_force(spark):
    rng = random.Random(4)
    vector = lambda d=6: [rng.gauss(0, 1) for _ in range(d)]
    hot = vector()
    rows = [(i, hot if i % 3 == 0 else vector(), rng.choice([0, 0, 0, 1, 2, 9])) for i in range(400)]
    rows += [(50, rows[50][1], rows[50][2]), (50, vector(), 3), (50, None, 1), (100, vector(), None), (51, [1.0, None], 1), (52, [float("nan")] * 6, 1), (53, [float("inf")] * 6, 1), (None, hot, 0), (None, vector(), 1), (54, vector(3), 0), (55, [], 1), (450, [0.0] * 6, 7), (451, [0.0] * 6, 7), (500, vector(9), 8)]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "vec_id long, embedding array<float>, label int, query string, score int").repartition(3)
    rows = [tuple(r)[:3] for r in df.collect()]
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    mined = lambda x: Counter(tuple(r) for r in N.hard_negatives(x, F.col("vec_id") % 50 == 0, label).collect())
    want = negatives_by_force(rows)
    assert mined(df) == want and len(want) > 50
    assert not mined(df.filter("false")) and not mined(df.filter("vec_id = 51"))


def test_negatives_in_rounds_and_many_trees(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)], rng.choice([0, 0, 1])) for i in range(500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    monkeypatch.setattr(N, "TREE_ROWS", 60)
    monkeypatch.setattr(N, "SENT_BYTES", 100)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    assert Counter(tuple(r) for r in N.hard_negatives(df, F.col("vec_id") % 50 == 0, label).collect()) == negatives_by_force(rows)


def test_search_passes_over_balls():
    rng = np.random.default_rng(0)
    middle = rng.normal(size=(20, 8)) * 2000
    vectors = (middle[rng.integers(0, 20, 4000)] + rng.normal(size=(4000, 8)) * 20).astype(np.int64)
    forest = N.Forest.unpack(N.build(np.arange(4000), np.zeros(4000, np.int64), vectors).pack())
    search = N.Search(vectors[:1], np.zeros(1, np.int64), np.array([-np.inf]), np.array([np.inf]), 5, True)
    search.over(forest)
    score = vectors @ vectors[0]
    best = np.lexsort((np.arange(4000), -score))[:5]
    assert search.ids[0].tolist() == best.tolist() and search.scores[0].tolist() == score[best].tolist()
    assert search.balls < len(forest.radii) / 2
    with pytest.raises(OverflowError):
        N.Search(vectors[:1] << 40, np.zeros(1, np.int64), np.array([0]), np.array([1]), 1, True).over(forest)


# ---- trie


def trie_by_force(rows):
    convs = {}
    for c, t, r, x in rows:
        if c is not None:
            convs.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in convs.items()}
    made = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        made[c] = tuple(own.get(c - int(math.fmod(c, 20)), [])[:h] + v[h:])
    return nodes_by_force(made)


def nodes_by_force(made):
    members, kids, sub, out = {}, {}, {}, []
    for c, s in made.items():
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append(c)
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    for p in sorted(members, key=len, reverse=True):
        words = len([w for w in re.split(r"[\x20\x09-\x0D]+", p[-1][1]) if w]) if p else 0
        below = [sub[k] for k in kids.get(p, [])]
        sub[p] = (sum(x for x, _ in below) or 1, sum(x for _, x in below) + (len(members[p]) - 1) * words)
        ends = ",".join(map(str, sorted(c for c in members[p] if made[c] == p)))
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(below), *sub[p], hashlib.sha256(ends.encode()).hexdigest()))
    return Counter(out)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.fixture(scope="module")
def turns():
    rng = random.Random(8)
    starts = [[("system", f"start {k} of some words"), ("user", "hello"), ("assistant", "x " * k)] for k in range(3)]
    rows = []
    for c in [*range(-45, 90), 10**12]:
        s = list(rng.choice(starts)[: rng.randint(0, 3)]) + [(rng.choice(["user", None]), rng.choice(["a", "b c", "", None, "x\ty"])) for _ in range(rng.randint(0, 5))]
        rows += [(c, rng.choice([k, k, None]) if k == 2 else k, r, x) for k, (r, x) in enumerate(s)]
    rows += [(c, 0, "user", "one") for c in range(200, 260)] + [(400, k, "user", f"t{k % 7}") for k in range(300)]
    rows += [(401, k, "user", f"t{k % 7}") for k in range(299)] + [(None, 0, "user", "lost"), (402, 0, "user", "same"), (402, 0, "user", "same"), (402, 0, "user", "other"), (403, None, None, None)]
    rng.shuffle(rows)
    return rows


def query_rows(spark, rows, tmp_path, name):
    spark.createDataFrame([(*r, "c", 1) for r in rows], "conv_id long, turn long, role string, text string, path string, depth int").repartition(3).write.parquet(str(tmp_path / name / "conversations.parquet"))
    return Counter(tuple(r) for r in P.op11_prefix_trie(spark, str(tmp_path / name)).select(COLUMNS).collect())


@pytest.mark.parametrize("size", [1 << 24, 700])
def test_trie_equals_brute_force(spark, turns, tmp_path, monkeypatch, size):
    monkeypatch.setattr(P, "RANGE_BYTES", size)
    assert query_rows(spark, turns, tmp_path, "all") == trie_by_force(turns)


def test_trie_of_few(spark, tmp_path):
    for name, rows in (("none", []), ("null", [(None, 1, "a", "b")]), ("one", [(1, 0, "a", "b c")]), ("gone", [(20, 0, "u", "x")] + [(c, 0, "u", "y") for c in range(21, 40)])):
        assert query_rows(spark, rows, tmp_path, name) == trie_by_force(rows)


def test_a_node_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(P, "RANGE_BYTES", 400)
    made = {c: (("u", "a b"),) if c % 3 else (("u", "a b"), ("u", f"{c % 5}")) for c in range(300)}
    rows = [(c, [(hashlib.md5(f"{len(r)}:{r}{x}".encode()).hexdigest(), len(x.split())) for r, x in s]) for c, s in made.items()] + [(1000, []), (1001, [])]
    held = spark.createDataFrame(rows, "conv_id long, turns array<struct<hash: string, words: int>>")
    assert Counter(tuple(r) for r in P.trie(held).select(COLUMNS).collect()) == nodes_by_force(made | {1000: (), 1001: ()})


def test_loser_tree_merges_with_shared_turns():
    rng = random.Random(9)
    turn = [bytes([k]) * P.TURN for k in range(3)]
    for n in [0, 1, 2, 3, 5, 9]:
        items = [(b"".join(rng.choice(turn) for _ in range(rng.randint(0, 6))), i, []) for i in range(120 if n else 0)]
        runs = [P.sorted_run(items[k::n]) for k in range(n)]
        got = list(P.merged(runs))
        want = sorted(items, key=lambda x: x[:2])
        assert [g[:2] for g in got] == [w[:2] for w in want]
        assert [g[3] for g in got] == [P.shared_turns(a[0], b[0], 0) for a, b in zip([(b"",), *want], want)]


def test_ids_are_whole_numbers(spark):
    df = spark.createDataFrame([("a", "b", [1.0])], "i string, t string, v array<double>")
    for make in (lambda: R.without_repeats(df, "i", "t"), lambda: P.sequences(df, "i", "i", "t", "t"), lambda: N.quantised(df, "i", "v", F.lit(1))):
        with pytest.raises(TypeError):
            make()
