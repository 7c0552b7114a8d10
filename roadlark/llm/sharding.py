"""Size-tiered compaction of immutable Parquet shards under versioned manifests.

``append`` writes arrivals as small shards that never change; ``compact`` merges runs of shards
of similar size into files of about the target size; each ends by committing a new manifest.
A manifest lists all live files with bytes; it is written beside its final name and renamed,
and the rename fails if the version exists, so a version is there whole or not at all and of two
writers one loses and nothing of its work is seen. Readers name a version and never see files
that come or go. That two commits of a version can't both win needs a file system whose rename is atomic
and refuses an existing name (HDFS and the like); a store without it needs a lock around ``append`` and
``compact``. Before a commit every file that it adds must still be there. Lost tasks are run again by
Spark's own commit protocol; the files of a failed job are in no manifest and ``vacuum`` removes them once
they are older than ``keep_seconds``, so what another writer has written and not yet committed stays, as
do the files of the newest ``keep_versions`` versions.

A run is merged by reading its files and coalescing their partitions, so no row is shuffled,
whatever the source, key or length of a document.

Defined results: nulls, empty and very long texts, repeated rows and extra columns are stored
as they are; an empty table gives a version without rows that keeps the columns; fewer than
``fanout`` small files of similar size wait for more arrivals.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shared_path, table

TARGET_BYTES = 64 << 20
FANOUT = 4
KEEP_SECONDS, KEEP_VERSIONS = 7 * 86400.0, 3
#: Of the query: lots in which the documents arrive, and rows of one of their shards.
ARRIVALS, SMALL_ROWS = FANOUT, 5000


class CommitConflict(RuntimeError):
    """Another writer has committed the version first."""


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT, small_rows: int = 0):
        """``small_rows`` cuts arrivals into files of so many rows; 0 leaves one file to each of their partitions."""
        self.spark, self.root = spark, root.rstrip("/")
        self.target, self.fanout, self.small_rows = target_bytes, fanout, small_rows
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # ---- manifests

    def _name(self, version: int) -> str:
        return f"{self.root}/manifests/v{version:08d}.json"

    def version(self) -> int:
        """The newest committed version; 0 before the first."""
        folder = self._path(f"{self.root}/manifests")
        if not self._fs.exists(folder):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return max([0, *(int(n[1:9]) for n in names if n.startswith("v") and n.endswith(".json"))])

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "schema": None, "files": []}
        stream = self._fs.open(self._path(self._name(version)))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def _commit(self, base: dict, schema: T.StructType, files: list[dict]) -> int:
        version = base["version"] + 1
        known = {f["path"] for f in base["files"]}
        gone = [f["path"] for f in files if f["path"] not in known and not self._fs.exists(self._path(f["path"]))]
        if gone:
            raise CommitConflict(f"{len(gone)} files of the commit are gone, such as {gone[0]}")
        body = json.dumps({"version": version, "schema": schema.jsonValue(), "files": sorted(files, key=lambda f: f["path"])})
        temporary = self._path(f"{self.root}/manifests/.{uuid.uuid4().hex}")
        out = self._fs.create(temporary, False)
        try:
            out.write(bytearray(body.encode()))
        finally:
            out.close()
        final = self._path(self._name(version))
        if self._fs.exists(final) or not self._fs.rename(temporary, final):
            self._fs.delete(temporary, False)
            raise CommitConflict(f"version {version} exists")
        return version

    # ---- data

    def _write(self, df: DataFrame, rows: int = 0) -> list[dict]:
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").option("maxRecordsPerFile", rows).parquet(folder)
        return [{"path": f"{folder}/{s.getPath().getName()}", "bytes": s.getLen()} for s in self._fs.listStatus(self._path(folder)) if s.getPath().getName().startswith("part-")]

    def append(self, arrivals: DataFrame) -> int:
        """Write arrivals as shards of their own and commit them."""
        base = self.manifest()
        return self._commit(base, arrivals.schema, base["files"] + self._write(arrivals, self.small_rows))

    def compact(self) -> int:
        """Merge runs of ``fanout`` or more files of similar size, none ``fanout`` times another, smallest first, until there are none; one commit."""
        base = self.manifest()
        schema = T.StructType.fromJson(base["schema"]) if base["schema"] else T.StructType()
        size = lambda f: f["bytes"]
        whole = [f for f in base["files"] if size(f) >= self.target]
        small, at, changed = sorted((f for f in base["files"] if size(f) < self.target), key=size), 0, False
        while at < len(small):
            run = [f for f in small[at:] if size(f) <= self.fanout * max(1, size(small[at]))]
            if len(run) < self.fanout:
                at += 1
                continue
            # fewer files than before, so this ends
            merged = self._write(self.spark.read.schema(schema).parquet(*(f["path"] for f in run)).coalesce(max(1, sum(map(size, run)) // self.target)))
            whole += [f for f in merged if size(f) >= self.target]
            small = sorted(small[:at] + small[at + len(run):] + [f for f in merged if size(f) < self.target], key=size)
            at, changed = 0, True
        return self._commit(base, schema, whole + small) if changed else base["version"]

    def read(self, version: int | None = None) -> DataFrame:
        m = self.manifest(version)
        schema = T.StructType.fromJson(m["schema"]) if m["schema"] else T.StructType()
        if not m["files"]:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f["path"] for f in m["files"]))

    def vacuum(self, keep_seconds: float = KEEP_SECONDS, keep_versions: int = KEEP_VERSIONS) -> int:
        """Delete data folders that none of the newest versions lists and that are older than ``keep_seconds``."""
        newest, gone = self.version(), 0
        live = {f["path"].rsplit("/", 1)[0].rsplit("/", 1)[1] for v in range(max(1, newest - keep_versions + 1), newest + 1) for f in self.manifest(v)["files"]}
        data, before = self._path(f"{self.root}/data"), 1000 * (time.time() - keep_seconds)
        for folder in self._fs.listStatus(data) if self._fs.exists(data) else []:
            if folder.getPath().getName() not in live and folder.getModificationTime() <= before:
                self._fs.delete(folder.getPath(), True)
                gone += 1
        return gone


def shard(docs: DataFrame, root: str | None = None, target_bytes: int = TARGET_BYTES) -> tuple[ShardStore, int]:
    """Append ``docs`` and compact; the store and its version. In a store of its own, which nobody else
    can write to or read, the merged arrivals are dropped at once."""
    store = ShardStore(docs.sparkSession, root or shared_path(docs.sparkSession, "shards"), target_bytes)
    store.append(docs)
    version = store.compact()
    store.vacuum(*(() if root else (0.0, 1)))
    return store, version


def op9_sharding(spark, sf_dir):
    """Documents that arrive in ARRIVALS lots of small shards, compacted: what a reader of the committed version gets, with the lot,
    the version, and whether the row's file is a merged one."""
    store = ShardStore(spark, shared_path(spark, "shards"), small_rows=SMALL_ROWS)
    lot = F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit("arrival:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 4), 16, 10).cast("int"), F.lit(ARRIVALS))
    docs = table(spark, sf_dir, "documents").withColumn("arrival", lot)
    for k in range(ARRIVALS):
        store.append(docs.filter(F.col("arrival") == k))
    arrived = {f["path"].rsplit("/", 2)[1] for f in store.manifest()["files"]}  # a folder for each arrival
    version = store.compact()
    folder = F.element_at(F.split(F.input_file_name(), "/"), -2)
    rows = store.read(version).select("doc_id", "source", F.octet_length("text").cast("long").alias("n_bytes"), F.md5("text").alias("text_md5"), "arrival", F.lit(version).cast("long").alias("version"), (~folder.isin(arrived)).alias("merged"))
    return rows
