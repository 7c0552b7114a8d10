"""The corpus pipeline: quality rules, near-duplicate removal, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept; all but
the last return the columns of ``docs``. Between stages the rows are written as Parquet to the
folder that the cluster shares and read again, so a lost executor costs a stage at most. With a folder
of its own (``work``) a run that failed is taken up after the last stage that it finished.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadlark.llm.common import delete_path, path_exists, shared_path, table
from roadlark.llm.decontaminate import decontaminate
from roadlark.llm.mixing import temperature_mix
from roadlark.llm.near_copies import keep_distinct
from roadlark.llm.quality_rules import quality_rules
from roadlark.llm.sharding import shard


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules(docs).filter("kept").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without near copies (five-word shingles, similarity 0.8 or more) of a kept one with a lesser id."""
    return keep_distinct(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).filter("not contaminated").select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the passes that their source's weight gives them, each once at least, in the order
    of the permuted blocks of all sources and passes, and in a block in an order of its own."""
    mixed = temperature_mix(docs).withColumns({"__place": F.xxhash64("epoch", "position"), "__in": F.xxhash64("epoch", "doc_id")})
    return mixed.repartitionByRange("__place", "__in").sortWithinPartitions("__place", "__in").select(*docs.columns)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture as the committed version of its shards."""
    store, version = shard(docs)
    return store.read(version)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

#: Near copies have no SQL form; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, work: str | None = None) -> DataFrame:
    """All stages over ``documents``. What a stage has written goes when the next one is done, unless the folder is named."""
    docs, last = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        if k + 1 == len(STAGES):
            return stage(spark, docs, sf_dir)
        path = f"{work.rstrip('/')}/{k}-{name}" if work else shared_path(spark, f"stage-{name}")
        if not path_exists(spark, f"{path}/_SUCCESS"):
            stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        if last and not work:
            delete_path(spark, last)
        last = path
    return docs
