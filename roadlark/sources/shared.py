"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not named and not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("name a folder that the driver and the executors share in spark.checkpoint.dir")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="roadlark-"))
    return named or sc._jsc.sc().getCheckpointDir().get()


def path(spark: SparkSession, kind: str) -> str:
    return f"{folder(spark).rstrip('/')}/roadlark/{kind}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Evaluate once and cut the lineage with a reliable checkpoint."""
    folder(df.sparkSession)
    return df.checkpoint(eager=True)
