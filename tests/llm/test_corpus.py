"""WARC, decontamination, near duplicates, mixing, sharding and the pipeline."""

from __future__ import annotations

import hashlib
import os
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from roadlark.llm import decontaminate as D
from roadlark.llm import mixing, near_copies, quality_rules, sharding, simhash, warc
from roadlark.llm.components import components
from roadlark.llm.sql import SQL

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SF = "/root/testdata/sf0.001"


# ---- WARC


def archive(payloads, most=1 << 20):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(len(payloads))), pa.array(["u"] * len(payloads)), pa.array(payloads), pa.array([None] * len(payloads), pa.int64())], names=list("abcd"))
    return b"".join(f + warc.SEPARATOR.encode() for out in warc._compress(iter([batch]), most) for f in out.column(0).to_pylist())


@pytest.mark.parametrize("n", [1, 40])
def test_archive_round_trip(n):
    payloads = [f"page {i} " * 40 for i in range(n)] + ["", "é" * 9000]
    got = list(warc.decode(archive(payloads)))
    assert [r["payload"].decode() for r in got] == payloads and not any(r["error"] for r in got)


def test_archives_are_rolled_by_bytes(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, "u", "".join(rng.choice("abcdefghij ") for _ in range(3000))) for i in range(60)] + [(99, "u", "y" * 300_000 + "z")]
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, payload string").repartition(1), str(tmp_path / "r"), 20_000)
    sizes = [p.stat().st_size for p in (tmp_path / "r").glob("part-*")]
    assert len(sizes) > 3 and max(sizes) < 40_000
    assert sorted((r.page_id, r.payload.decode()) for r in warc.read_archives(spark, str(tmp_path / "r")).collect()) == [(i, t) for i, _, t in rows]


def test_a_record_over_the_limit_is_an_error_row(monkeypatch):
    data = archive(["abc " * 1000, "x"])
    monkeypatch.setattr(warc, "MAX_RECORD", 2000)
    got = list(warc.decode(data))
    assert [bool(r["error"]) for r in got] == [True, False] and got[0]["page_id"] is None and got[1]["payload"] == b"x"


def test_broken_archives_give_errors():
    data = archive(["abc " * 100, "def " * 100])
    assert [bool(r["error"]) for r in warc.decode(data[:-20])] == [False, True]
    broken = bytearray(data)
    at = [r["offset"] for r in warc.decode(data)][0]
    broken[at + 30] ^= 0xFF
    assert [bool(r["error"]) for r in warc.decode(bytes(broken))][-1] is False
    assert list(warc.decode(b"garbage bytes here"))[0]["error"]
    assert list(warc.decode(b"")) == []


@pytest.mark.parametrize("change", [(b"Content-Length: 6", b"Content-Length: 7"), (b"WARC/1.1", b"WARC/9.9"), (b"WARC-Type: response", b"WARC-Kind: response"), (b"abc", b"abd")])
def test_records_that_do_not_agree_are_refused(change):
    good = warc.record(1, "http://x/", b"abc", None)
    assert warc.parse(good)["payload"] == b"abc"
    with pytest.raises(warc.BadArchive):
        warc.parse(good.replace(*change) if change[1] != b"Content-Length: 7" else re.sub(rb"(Content-Type: application/http;msgtype=response\r\nContent-Length: )\d+", rb"\g<1>7", good))


def test_revisits(spark, tmp_path):
    rows = [(1, "u", "x" * 100), (2, "u", "x" * 100), (3, None, None), (4, "v", ""), (None, "v", "q"), (6, "v\r\nw", "é"), (6, "v", "é")]
    df = spark.createDataFrame(rows, "page_id long, url string, payload string")
    warc.write_archives(df.repartition(2), str(tmp_path / "a"))
    got = warc.read_archives(spark, str(tmp_path / "a")).collect()
    assert Counter((r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.error) for r in got) == Counter([(1, "revisit", 2, 100, None), (2, "response", None, 100, None), (3, "revisit", 4, 0, None), (4, "response", None, 0, None), (None, "response", None, 1, None), (6, "response", None, 2, None), (6, "response", None, 2, None)])
    warc.write_archives(df.limit(0), str(tmp_path / "b"))
    assert warc.read_archives(spark, str(tmp_path / "b")).count() == 0


# ---- decontamination


def brute_hits(texts, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {}
    for i, t in items:
        w = word.findall((t or "").translate(LOWER))
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add("" if i is None else str(i))
    for i, t in texts:
        w = word.findall((t or "").translate(LOWER))
        hit, ids = set(), set()
        for n in {len(g) for g in windows}:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    ids |= found
                    hit |= set(range(k, k + n))
        yield i, t, len(w), len(hit), sorted(ids), bool(hit)


def test_decontamination_against_brute_force(spark, docs, texts, none):
    rng = random.Random(2)
    own = [t for _, t in texts if t and len(t.split()) > 60]
    items = [(k, " ".join(t.split()[a : a + n])) for k, (t, a, n) in enumerate((rng.choice(own), rng.randrange(20), rng.choice([3, 9, 10, 11, 25, 40])) for _ in range(40))]
    items += [(50, None), (51, ""), (52, "one"), (None, "x y z x y z x y z x y z"), (3, items[3][1]), (53, "nowhere to be found in any of these texts at all really")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = D.decontaminate(docs, bench).collect()
    assert Counter((r.doc_id, r.text, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in got) == Counter((i, t, n, h, tuple(s), c) for i, t, n, h, s, c in brute_hits(texts, items))
    assert all(sum(b - a for a, b in r.spans) == r.n_hit for r in got)
    assert D.decontaminate(docs, bench.limit(0)).filter("contaminated").count() == 0
    assert D.decontaminate(none, bench).count() == 0


def test_blocks_give_the_same(spark, docs, texts, monkeypatch):
    own = [t for _, t in texts if t and len(t.split()) > 60][:8]
    bench = spark.createDataFrame([(k, " ".join(t.split()[5:30])) for k, t in enumerate(own)], "item_id long, text string")
    bench = bench.union(bench.limit(2)).repartition(3)
    rows = lambda: Counter((r.doc_id, r.text, r.fp, r.n_words, r.n_hit, tuple(r["items"]), str(r.spans), r.contaminated) for r in D.decontaminate(docs, bench).collect())
    one = rows()
    monkeypatch.setattr(D, "BLOCK_WORDS", 30)
    assert D.item_blocks(bench, "item_id", "text")[1] > 3 and rows() == one
    assert D.decontaminate(docs, bench, keep=["doc_id"]).columns[:1] == ["doc_id"]


def test_winnowing_guarantee():
    rng = np.random.default_rng(0)
    for _ in range(50):
        shared = rng.integers(0, 1 << 60, D.SPAN).astype(np.uint64)
        a, b = (np.concatenate([rng.integers(0, 1 << 60, n).astype(np.uint64), shared, rng.integers(0, 1 << 60, m).astype(np.uint64)]) for n, m in ((3, 9), (17, 2)))
        ha, hb = D.grams(a, D.GRAM), D.grams(b, D.GRAM)
        assert set(ha[D.winnow(ha)]) & set(hb[D.winnow(hb)])


# ---- near duplicates


def brute_fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
    if not w:
        return 0
    h = [xxhash.xxh64(" ".join(w[k : k + 4]).encode(), seed=42).intdigest() for k in range(max(1, len(w) - 3))]
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))


def brute_components(ids, fps):
    label = list(range(len(ids)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            r = root(i)
            least[r] = min(least.get(r, d), d)
    return [least.get(root(i)) for i in range(len(ids))]


def test_simhash_against_brute_force(spark, docs, texts, none):
    got = simhash.near_duplicates(docs).collect()
    fps = [brute_fingerprint(t) for _, t in texts]
    want = brute_components([i for i, _ in texts], fps)
    assert Counter((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in got) == Counter((i, f, c) for (i, _), f, c in zip(texts, fps, want))
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("m", [2, 3, 4, 5])
@pytest.mark.parametrize("group", [8192, 16])
def test_every_link_is_found(spark, monkeypatch, m, group):
    if m == 2 and group == 16:
        pytest.skip("the same code with more rows")
    monkeypatch.setattr(simhash, "partition_count", lambda n: m)
    monkeypatch.setattr(simhash, "GROUP", group)
    rng = random.Random(m)
    fps = {0}
    for _ in range(25):
        x = rng.getrandbits(64)
        for _ in range(12):
            fps.add(x)
            x ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6)))
    signed = [f - (1 << 64) if f >> 63 else f for f in sorted(fps)]
    nodes = spark.createDataFrame([(f,) for f in signed], "fp long").repartition(3).cache()
    roots = {r.node: r.root for r in components(simhash.links(nodes)).collect()}
    classes = [roots.get(f, f) for f in signed]
    want = brute_components(signed, [f & (1 << 64) - 1 for f in signed])
    assert len(set(zip(classes, want))) == len(set(classes)) == len(set(want))


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 140)}


def test_keep_one(spark, docs, texts):
    kept = simhash.keep_one(docs).collect()
    ids = [r.doc_id for r in kept]
    want = brute_components([i for i, _ in texts if i is not None], [brute_fingerprint(t) for i, t in texts if i is not None])
    assert sorted(i for i in ids if i is not None) == sorted(set(want)) and ids.count(None) == 1


def brute_set(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def brute_kept(rows):
    """Ids that stay: in their order, those that are no near copy of one that stays."""
    kept = {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        x = brute_set(t)
        if i not in kept and not any(5 * len(x & y) >= 4 * len(x | y) for y in kept.values()):
            kept[i] = x
    return set(kept)


@pytest.mark.parametrize("large,heads,most", [(256, 32, 1024), (3, 2, 8), (3, 1, 1)])
def test_pipeline_keeps_no_near_copies(spark, docs, texts, large, heads, most, monkeypatch):
    monkeypatch.setattr(near_copies, "LARGE", large)
    monkeypatch.setattr(near_copies, "HEADS", heads)
    monkeypatch.setattr(near_copies, "MOST_HEADS", most)
    rng = random.Random(11)
    rows = []
    for _ in range(40):
        base = ["".join(rng.choice("abcdeorst") for _ in range(6)) for _ in range(rng.randint(125, 250))]
        for edits in (0, 2, 3, 4, 8, 12):
            w = list(base)
            for at in rng.sample(range(len(w)), edits):
                w[at] = "changed" + str(rng.random())
            rows.append(" ".join(w))
    rng.shuffle(rows)
    rows = list(enumerate(rows, 1000)) + [(i, t) for i, t in texts if i is not None]
    got = {r.doc_id for r in corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), None).collect()}
    assert got == brute_kept(rows)
    assert corpus_pipeline.near_dedup(spark, docs, None).filter("doc_id is null").count() == 1
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), None).count() == 0


def test_large_groups_of_near_copies_and_of_others(spark, monkeypatch):
    """A group of near copies, and one whose members are candidates of each other without being near copies."""
    monkeypatch.setattr(near_copies, "LARGE", 40)
    monkeypatch.setattr(near_copies, "HEADS", 4)
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdeorst") for _ in range(6))
    one, other = ([word() for _ in range(150)] for _ in range(2))

    def edited(base, edits):
        w = list(base)
        for at in rng.sample(range(len(w)), edits):
            w[at] = word()
        return " ".join(w)

    texts = [edited(one, rng.choice([1, 2, 3])) for _ in range(500)] + [edited(other, rng.choice([5, 6, 7, 8])) for _ in range(300)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = {r.doc_id for r in near_copies.keep_distinct(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == brute_kept(rows) and 100 < len(got) < 500


# ---- mixing and sharding


def test_mixing(spark, docs, texts, none):
    got = mixing.temperature_mix(docs, max_epochs=3.0, target_entropy=0.99)
    assert set(got.columns) == {*docs.columns, "epoch", "position"}
    rows = got.collect()
    assert {(r.doc_id, r.text) for r in rows} == {(i, t) for i, t in texts}, "every row at least once"
    assert max(r.epoch for r in rows) <= 2
    by = Counter(r.source for r in rows if r.epoch == 0)
    assert by == Counter(r.source for r in docs.collect())
    assert mixing.temperature_mix(none).count() == 0


def test_exponent_meets_its_limits(spark):
    s = spark.createDataFrame([("a", 1000), ("b", 100), ("c", 10)], "source string, tokens long")
    a = mixing.find_exponent(s, target_entropy=0.8, max_epochs=1e9)
    p = np.array([1000, 100, 10]) / 1110
    share = lambda a: p**a / (p**a).sum()
    h = lambda w: -(w * np.log(w)).sum() / np.log(3)
    assert abs(h(share(a)) - 0.8) < 1e-5
    b = mixing.find_exponent(s, target_entropy=1.0, max_epochs=4.0)
    r = share(b) / p
    assert abs(r.max() / r.min() - 4.0) < 1e-4
    assert mixing.find_exponent(s.limit(1)) == 1.0
    even, q = spark.createDataFrame([("a", 100), ("b", 120), ("c", 150)], "source string, tokens long"), np.array([100, 120, 150]) / 370
    up = mixing.find_exponent(even, 0.95, 1e9)
    assert up > 1 and abs(h(q**up / (q**up).sum()) - 0.95) < 1e-4
    last = mixing.find_exponent(even, 0.5, 2.0)
    assert last == pytest.approx(1 + np.log(2) / np.log(1.5), abs=1e-4) and 1.5 ** (last - 1) <= 2.0
    with pytest.warns(UserWarning, match="no exponent"):
        assert mixing.find_exponent(spark.createDataFrame([(c, 10) for c in "abcd"], "source string, tokens long")) == 1.0


def test_budget_of_tokens(spark, docs, texts):
    """Each source's tokens are its whole passes and the blocks of one more that fit in the rest of its part."""
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    own, got, blocks = Counter(), Counter(), {}
    for r in docs.collect():
        own[r.source] += words(r.text)
        block = hashlib.md5(f"mix:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()[:3]
        blocks[r.source, block] = blocks.get((r.source, block), 0) + words(r.text)
    rows = mixing.temperature_mix(docs, target_entropy=0.999, max_epochs=1.7).collect()
    for r in rows:
        got[r.source] += words(r.text)
    used = {s: n for s, n in own.items() if n}
    total = sum(used.values())
    alpha = mixing.find_exponent(spark.createDataFrame([(s, n) for s, n in used.items()], "source string, tokens long"), 0.999, 1.7)
    x = {s: (n / total) ** alpha for s, n in used.items()}
    least = min(x[s] / (used[s] / total) for s in used)
    for s in used:
        part = round(x[s] / (used[s] / total) / least, 6) * used[s]
        largest = max(n for (src, _), n in blocks.items() if src == s)
        assert part - largest < got[s] <= part + 1e-6
        # blocks in the order of the last, partial pass
        order = [b for _, b in sorted((hashlib.md5(f"mix:{int(part // used[s])}:{'' if s is None else '=' + s}:{b}".encode()).hexdigest(), b) for src, b in blocks if src == s)]
        room, want = part - used[s] * int(part // used[s]), 0
        for b in order:
            if blocks[s, b] + want > room:
                break
            want += blocks[s, b]
        assert got[s] == used[s] * int(part // used[s]) + want


def test_store_versions(spark, docs, none, tmp_path):
    store = sharding.ShardStore(spark, str(tmp_path / "s"), target_bytes=1 << 20, small_rows=5)
    assert store.append(docs) == 1 and store.append(docs) == 2
    files = len(store.manifest()["files"])
    assert store.compact() == 3 and len(store.manifest()["files"]) < files
    sizes = sorted(f["bytes"] for f in store.manifest()["files"] if f["bytes"] < store.target)
    assert all(sum(x <= y <= store.fanout * x for y in sizes) < store.fanout for x in sizes), "no run is left"
    key = lambda df: Counter(map(tuple, df.collect()))
    assert key(store.read()) == key(docs.union(docs)) and key(store.read(1)) == key(docs)
    other = sharding.ShardStore(spark, str(tmp_path / "s"))
    base = other.manifest(2)
    with pytest.raises(sharding.CommitConflict):
        other._commit(base, docs.schema, [])
    assert store.vacuum() == 0 and store.vacuum(0.0, 3) == 0 and key(store.read(1)) == key(docs)
    pending = other._write(docs.limit(3))
    assert store.vacuum() == 0 and store.vacuum(0.0, 1) >= 1  # the last takes what isn't committed, too
    with pytest.raises(sharding.CommitConflict):
        other._commit(other.manifest(), docs.schema, [*other.manifest()["files"], *pending])
    assert key(store.read()) == key(docs.union(docs))
    empty = sharding.ShardStore(spark, str(tmp_path / "e"))
    empty.append(none)
    assert empty.compact() == 1 and empty.read().columns == docs.columns and empty.read().count() == 0


def test_two_writers_at_once(spark, docs, tmp_path):
    """Each arrival is there once for each writer that was told so, whoever loses a version."""
    from concurrent.futures import ThreadPoolExecutor

    def write(k):
        store, tries = sharding.ShardStore(spark, str(tmp_path / "w")), 0
        while True:
            try:
                return store.append(spark.createDataFrame([(k,)], "k int")), tries
            except sharding.CommitConflict:
                tries += 1

    with ThreadPoolExecutor(4) as pool:
        versions = [v for v, _ in pool.map(write, range(8))]
    store = sharding.ShardStore(spark, str(tmp_path / "w"))
    assert sorted(versions) == list(range(1, 9)) and sorted(r.k for r in store.read().collect()) == list(range(8))


# ---- pipeline and SQL


def test_pipeline_stages_against_brute_force(spark, docs, texts, tmp_path):
    """Each stage's rows by its own rule, on the rows that brute force says the one before keeps."""
    from .test_scoring import brute_quality

    text = next(t for i, t in texts if i == 5)
    (tmp_path / "sf").mkdir()
    spark.createDataFrame([(1, " ".join(text.split()[:20]))], "item_id long, text string").write.parquet(str(tmp_path / "sf/benchmark.parquet"))
    docs.write.parquet(str(tmp_path / "sf/documents.parquet"))
    sf, work = str(tmp_path / "sf"), str(tmp_path / "work")
    out = corpus_pipeline.run(spark, sf, work).collect()
    stage = lambda k, name: spark.read.parquet(f"{work}/{k}-{name}").collect()
    rows = lambda k, name: Counter((r.doc_id, r.text) for r in stage(k, name))

    # The verdict of divergence has its own tests; here it only takes what the base rules leave.
    verdicts = {(r.doc_id, r.text): r.kept for r in quality_rules.quality_rules(docs).collect()}
    fine = lambda t: (lambda n, rep: n >= 50 and 100 * rep <= 50 * n)(*brute_quality(t)[::4])
    assert all(not kept or fine(t) for (_, t), kept in verdicts.items()) and sum(verdicts.values()) > 25
    want = Counter((i, t) for i, t in texts if verdicts[i, t])
    assert rows(0, "quality") == want

    kept = brute_kept([r for r in want if r[0] is not None])
    want = Counter({r: n if r[0] is None else 1 for r, n in want.items() if r[0] is None or r[0] in kept})
    assert rows(1, "near_dedup") == want and len(want) < len(texts)

    clean = {i for i, _, _, n_hit, _, _ in brute_hits(list(want), [(1, " ".join(text.split()[:20]))]) if not n_hit}
    want = Counter({r: n for r, n in want.items() if r[0] in clean})
    assert rows(2, "decontamination") == want and (5, text) not in want

    passes = Counter((r.doc_id, r.text) for r in mixing.temperature_mix(spark.read.parquet(f"{work}/2-decontamination")).collect())
    assert set(passes) == set(want) and all(passes[r] >= n for r, n in want.items())
    assert rows(3, "mixing") == passes
    assert Counter((r.doc_id, r.text) for r in out) == passes and set(out[0].asDict()) == set(docs.columns)
    assert len(corpus_pipeline.STAGES) == 5


def test_pipeline_is_taken_up_again(spark, docs, none, tmp_path, monkeypatch):
    (tmp_path / "sf").mkdir()
    spark.createDataFrame([(1, "no such words anywhere")], "item_id long, text string").write.parquet(str(tmp_path / "sf/benchmark.parquet"))
    docs.write.parquet(str(tmp_path / "sf/documents.parquet"))
    sf, work, ran = str(tmp_path / "sf"), str(tmp_path / "work"), []

    def broken(spark, docs, sf_dir):
        raise RuntimeError("lost")

    stages = [(n, lambda s, d, p, n=n, f=f: (ran.append(n), f(s, d, p))[1]) for n, f in corpus_pipeline.STAGES]
    monkeypatch.setattr(corpus_pipeline, "STAGES", [*stages[:2], ("decontamination", broken), *stages[3:]])
    with pytest.raises(RuntimeError, match="lost"):
        corpus_pipeline.run(spark, sf, work)
    monkeypatch.setattr(corpus_pipeline, "STAGES", stages)
    again = corpus_pipeline.run(spark, sf, work)
    assert ran == ["quality", "near_dedup", "decontamination", "mixing", "sharding"]
    monkeypatch.undo()
    assert Counter(map(tuple, again.collect())) == Counter(map(tuple, corpus_pipeline.run(spark, sf).collect()))

    (tmp_path / "none").mkdir()
    none.write.parquet(str(tmp_path / "none/documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "none/benchmark.parquet"))
    empty = corpus_pipeline.run(spark, str(tmp_path / "none"))
    assert empty.columns == docs.columns and empty.count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    from roadlark.llm.queries import QUERIES

    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels", "conversations", "embeddings"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    rel = con.sql(SQL[name])
    df = QUERIES[name](spark, SF)
    assert sorted(rel.columns) == sorted(df.columns)
    at = [rel.columns.index(c) for c in df.columns]
    assert Counter(tuple(map(str, (r[i] for i in at))) for r in rel.fetchall()) == Counter(tuple(map(str, r)) for r in df.collect())
