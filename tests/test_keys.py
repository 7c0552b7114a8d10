"""Sequential operators with null, NaN and large keys; inputs locked by hashes."""

from __future__ import annotations

import hashlib
import random
import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from roadlark.functions import extension
from roadlark.operators import protocol, rules, sessions
from roadlark.sources.files import ContractError

BIG = 9007199254740993  # 2**53 + 1


class Total:
    def __init__(self):
        self.n, self.x, self.keys = 0, 0.0, set()

    def add(self, rows):
        self.n += len(rows)
        self.x += float(rows["x"].sum())
        self.keys |= set(rows["k"])

    def merge(self, other):
        self.n += other.n
        self.x += other.x
        self.keys |= other.keys

    def finish(self):
        return {"n": self.n, "x": self.x, "keys": len(self.keys)}


@pytest.mark.parametrize("most", [100, 0])
def test_accumulate_keeps_null_and_large_keys(spark, most):
    rows = [(k, float(i)) for i, k in enumerate([None, BIG, BIG + 1, 1] * 30)]
    df = spark.createDataFrame(rows, "k long, x double").repartition(4)
    got = {r.k: (r.n, r.x, r["keys"]) for r in extension.accumulate(df, "k", Total, "k long, n long, x double, keys long", most).collect()}
    assert got == {k: (30, sum(x for j, x in rows if j == k), 1) for k in (None, BIG, BIG + 1, 1)}
    text = spark.createDataFrame([("a", 1.0), (None, 2.0), ("a", 3.0)], "k string, x double")
    assert {r.k: r.n for r in extension.accumulate(text, "k", Total, "k string, n long, x double, keys long").collect()} == {"a": 2, None: 1}
    odd = spark.createDataFrame([(float("nan"), 1.0), (float("nan"), 2.0), (None, 3.0)], "k double, x double").repartition(2)
    assert sorted(r.n for r in extension.accumulate(odd, "k", Total, "k double, n long, x double, keys long", most).collect()) == [1, 2]
    assert extension.accumulate(df.filter("false"), "k", Total, "k long, n long, x double, keys long").count() == 0


class Calls(Total):
    calls = 0

    def add(self, rows):
        super().add(rows)
        self.calls += 1

    def finish(self):
        return super().finish() | {"n": self.calls}


def test_accumulate_adds_rows_of_a_key_together(spark):
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
        df = spark.range(2000).coalesce(1).selectExpr("id % 40 AS k", "cast(id AS double) x")
        got = extension.accumulate(df, "k", Calls, "k long, n long, x double, keys long").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
    assert {r.k: (r.n, r.x) for r in got} == {k: (1, float(sum(range(k, 2000, 40)))) for k in range(40)}


def test_replay_goes_on_within_null_and_large_keys(spark):
    rows = [(k, d, 4.0, 2.0 if d != 1 else 0.0) for k in (None, BIG, 5) for d in range(3)]
    df = spark.createDataFrame(rows, "k long, d int, points double, e double").repartition(4)
    got = {}
    for r in rules.replay(df, "k", "d", "points", "e").orderBy("d").collect():
        got.setdefault(r.k, []).append((round(r.score, 9), r.observed))
    assert set(got) == {None, BIG, 5} and got[None] == got[BIG] == got[5] and got[5][0][0] == got[5][1][0] != got[5][2][0]


def test_cool_down_keeps_null_and_large_keys(spark):
    rows = [(k, s, v) for k in (None, BIG) for s, v in ((0.0, 1.0), (10.0, 3.0), (100.0, None), (110.0, 0.5))] + [(1, None, 2.0), (1, None, 2.0)]
    df = spark.createDataFrame(rows, "k long, s double, v double").repartition(4)
    got = sorted(sessions.cool_down(df, ["k"], "s", "v", 30).collect(), key=repr)
    assert sorted(map(tuple, got), key=repr) == sorted([(None, 10.0, 3.0), (None, 110.0, 0.5), (BIG, 10.0, 3.0), (BIG, 110.0, 0.5), (1, None, 2.0), (1, None, 2.0)], key=repr)


def by_force(values, weights):
    blocks = [(v, w, 1) for v, w in zip(values, weights)]
    while any(a[0] > b[0] for a, b in zip(blocks, blocks[1:])):
        i = next(i for i in range(len(blocks) - 1) if blocks[i][0] > blocks[i + 1][0])
        (v, w, n), (x, y, m) = blocks[i : i + 2]
        blocks[i : i + 2] = [((v * w + x * y) / (w + y), w + y, n + m)]
    return [v for v, _, n in blocks for _ in range(n)]


def test_monotone_fit_equals_pooling():
    rng = random.Random(3)
    for n in range(12):
        v, w = [rng.choice([0.1, 0.5, 0.5, 0.9]) for _ in range(n)], [rng.randint(1, 9) for _ in range(n)]
        assert rules.pool_adjacent(v, w) == pytest.approx(by_force(v, w))


# ---- locked inputs


@pytest.fixture
def folder(spark, tmp_path):
    """Files of one name in several folders, as some writers leave them."""
    path = tmp_path / "locked data"
    for k in range(3):
        spark.createDataFrame([(i, f"text {k} {i}") for i in range(50)], "i long, t string").coalesce(1).write.parquet(str(path / f"k={k}"))
        next((path / f"k={k}").glob("part-*.parquet")).rename(path / f"k={k}" / "part-0.parquet")
        for crc in (path / f"k={k}").glob(".*.crc"):
            crc.unlink()
    return path


def test_locked_files_are_known_by_their_paths(spark, folder, monkeypatch):
    hashes = {r.name: r.sha256 for r in protocol.file_hashes(spark, str(folder)).collect()}
    plain = {f"k={k}/part-0.parquet": hashlib.sha256((folder / f"k={k}/part-0.parquet").read_bytes()).hexdigest() for k in range(3)}
    assert hashes == plain
    root = protocol.tree_hash(protocol.file_hashes(spark, str(folder)))
    assert protocol.read_locked(spark, str(folder), hashes).count() == protocol.read_locked(spark, str(folder), root, ["i", "t", "k"]).count() == 150
    one, other = (folder / f"k={k}/part-0.parquet" for k in (0, 1))

    def refused():
        for lock in (hashes, root):
            with pytest.raises(ContractError):
                protocol.read_locked(spark, str(folder), lock)

    held = one.read_bytes()
    shutil.copy(other, one)
    refused()
    one.write_bytes(held)
    one.rename(folder / "k=0/part-1.parquet")
    refused()
    (folder / "k=0/part-1.parquet").rename(one)
    shutil.copy(one, folder / "k=0/part-2.parquet")
    refused()
    (folder / "k=0/part-2.parquet").unlink()
    assert protocol.read_locked(spark, str(folder), root).count() == 150
    with pytest.raises(ContractError):
        protocol.read_locked(spark, str(folder), root, ["i", "t"])


def test_files_of_many_ranges(spark, tmp_path, monkeypatch):
    rng = random.Random(1)
    contents = {"a": bytes(rng.randrange(256) for _ in range(30_000)), "sub/a": b"\n", "sub/b": b"", "sub/deep/c": b"x" * 999 + b"\n" * 5, "d": b"\n\n" + b"y" * 3000}
    for name, data in contents.items():
        (tmp_path / "f" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "f" / name).write_bytes(data)
    small = {r.name: (r.sha256, r.bytes) for r in protocol.file_hashes(spark, str(tmp_path / "f")).collect()}
    assert small == {n: (hashlib.sha256(d).hexdigest(), len(d)) for n, d in contents.items() if d}
    monkeypatch.setattr(protocol, "LEAF_BYTES", 1000)
    ranged = {r.name: r.sha256 for r in protocol.file_hashes(spark, str(tmp_path / "f")).collect()}
    assert ranged["sub/a"] == small["sub/a"][0] and ranged["a"] != small["a"][0]
    seen = {ranged["a"]}
    for at in (0, 999, 1000, 15_000, 29_999):
        data = bytearray(contents["a"])
        data[at] ^= 1
        (tmp_path / "f/a").write_bytes(bytes(data))
        seen.add({r.name: r.sha256 for r in protocol.file_hashes(spark, str(tmp_path / "f")).collect()}["a"])
    assert len(seen) == 6


def test_bins_are_compressed_as_documented_and_as_in_use(spark):
    rng = random.Random(11)
    rows = [(rng.choice([0.1, 0.2, 0.3, rng.random()]), float(rng.random() < 0.4)) for _ in range(90)]
    df = spark.createDataFrame([*rows, (None, 1.0)], "x double, y double").repartition(3)
    plain = [tuple(r) for r in rules.fit_bins(df, "x", "y", 8).orderBy("bin").collect()]
    packed = [tuple(r) for r in rules.fit_bins(df, "x", "y", 8, compress=True).orderBy("bin").collect()]
    assert [r[3] for r in packed] == pytest.approx(sorted({round(r[3], 12) for r in plain})) and sum(r[2] for r in packed) == sum(r[2] for r in plain) == 90
    xs = sorted(x for x, _ in rows)
    edges = sorted({xs[min(89, round(k * 90 / 8))] for k in range(1, 8)})
    bins = [[y for x, y in rows if sum(e <= x for e in edges) == k] for k in range(len(edges) + 1)]
    held = [(k, b) for k, b in enumerate(bins) if b]
    blocks = [[sum(b), len(b)] for _, b in held]
    while (i := next((i for i in range(len(blocks) - 1) if blocks[i][0] / blocks[i][1] > blocks[i + 1][0] / blocks[i + 1][1]), None)) is not None:
        blocks[i : i + 2] = [[blocks[i][0] + blocks[i + 1][0], blocks[i][1] + blocks[i + 1][1]]]
    want = []
    for (k, b), (t, n) in zip(held, blocks):
        if want and abs(want[-1][1] - t / n) < 1e-12:
            want[-1] = (want[-1][0], t / n)
        else:
            want.append((k, t / n))
    got = [(r.bin, r.risk) for r in rules.fit_bins(df, "x", "y", 8, compat=True).orderBy("bin").collect()]
    assert [k for k, _ in got] == [k for k, _ in want] and [v for _, v in got] == pytest.approx([v for _, v in want])
    one = rules.fit_bins(spark.createDataFrame([(2.0, 1.0), (2.0, 0.0)], "x double, y double"), "x", "y", compat=True).collect()
    assert [tuple(r) for r in one] == [(0, 2.0, 2, 0.5)] and rules.fit_bins(df.limit(0), "x", "y", compat=True).count() == rules.fit_bins(df.limit(0), "x", "y").count() == 0


def test_moments_round_halves_away_from_zero():
    from roadlark.plans.dynamics import Moments

    for total, n, mean in ((3148.24, 64, 49.1913), (3148.2400000000002, 64, 49.1913), (-2743.6, 64, -42.8688), (3811.5, 80, 47.6438), (float("inf"), 2, float("inf"))):
        m = Moments()
        m.n, m.total = n, total
        assert m.finish()["mean"] == mean
