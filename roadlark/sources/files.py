"""Table sources and sinks: CSV, TSV shards, JSON manifests, submissions, fingerprints."""

from __future__ import annotations

import hashlib
import json
import os
import re
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import date, timedelta
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What stands for null in raw shards.
NULL_TOKENS = ["", r"\N", "null", "NULL"]


class ContractError(ValueError):
    """A table breaks its contract."""


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header and a declared schema; a byte-order mark and bad values do no harm (bad is null)."""
    return spark.read.schema(schema).csv(path, header=True, enforceSchema=True, mode="PERMISSIVE", encoding="UTF-8")


def read_shards(spark: SparkSession, pattern: str, order: list[str], types: dict[str, str], required: list[str], aliases: dict[str, str] | None = None) -> DataFrame:
    """Headerless TSV shards by declared column order -> canonical columns with their types.

    ``aliases`` maps canonical names to names in ``order``; optional columns that ``order`` lacks are null. Only
    the selected columns are parsed.
    """
    aliases = aliases or {}
    named = {c: aliases.get(c, c) for c in types}
    if missing := [c for c in required if named[c] not in order]:
        raise ContractError(f"the shards have no {missing}")
    raw = spark.read.schema(_texts(order)).csv(pattern, sep="\t", header=False, nullValue=r"\N")
    return raw.select(*_typed(order, types, named))


def _texts(order: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in order])


def _typed(order: list[str], types: dict[str, str], named: dict[str, str]) -> list[Column]:
    clean = lambda c: F.when(~F.trim(F.col(c)).isin(*NULL_TOKENS), F.trim(F.col(c)))
    return [(clean(named[c]).try_cast(t) if named[c] in order else F.lit(None).cast(t)).alias(c) for c, t in types.items()]


def scan_window(spark: SparkSession, pattern: str, order: list[str], types: dict[str, str], at: str, start: str, end: str, allowed: dict[str, list] | None = None) -> DataFrame:
    """Rows of headerless TSV shards whose time ``at`` (named in ``types``) lies in [start, end).

    Lines without the text of one of the window's dates are passed over before any value is parsed. Rows whose time
    can't be read go. A value that ``allowed`` doesn't list for its column stops the scan; null is no value.
    """
    first, last = (date.fromisoformat(x[:10]) for x in (start, end))
    days = [(first + timedelta(days=d)).isoformat() for d in range((last - first).days + 1)]
    lines = spark.read.text(pattern).filter(F.col("value").rlike("|".join(days)))
    raw = lines.select(F.from_csv("value", _texts(order).simpleString()[7:-1].replace(":", " "), {"sep": "\t"}).alias("r")).select("r.*")
    rows = raw.select(*_typed(order, types, {c: c for c in types}))
    rows = rows.filter((F.col(at) >= F.lit(start).cast("timestamp_ntz")) & (F.col(at) < F.lit(end).cast("timestamp_ntz")))
    for c, values in (allowed or {}).items():
        bad = F.raise_error(F.concat(F.lit(f"{c} can't be "), F.col(c).cast("string"))).cast("boolean")
        rows = rows.filter(F.when(F.col(c).isNull() | F.col(c).isin(*values), True).otherwise(bad))
    return rows


def disorder(spark: SparkSession, pattern: str, order: list[str], key: str, at: str) -> DataFrame:
    """(file, key, n): how many rows of a key in a file have a lesser time than the one before. Whole files may be large,
    so places are those of the splits and the rows within; a key's rows in one file are read in their order."""
    raw = spark.read.schema(_texts(order)).csv(pattern, sep="\t", header=False, nullValue=r"\N")
    src = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__split"), F.monotonically_increasing_id().alias("__row"), F.col(key).alias("key"), F.col(at).try_cast("timestamp_ntz").alias("__at"))
    w = Window.partitionBy("file", "key").orderBy("__split", "__row")
    back = src.filter("__at is not null").withColumn("__back", F.col("__at") < F.lag("__at").over(w))
    return back.filter("__back").groupBy("file", "key").agg(F.count("*").alias("n"))


def embedded_json(html: Column, name: str, schema: str) -> Column:
    """The object that a line ``window.<name> = {...};`` of a page assigns, parsed; null without one or if it can't be read."""
    if not re.fullmatch(r"[A-Za-z_$][\w$]*", name):
        raise ContractError(f"{name} is no name")
    return F.from_json(F.nullif(F.regexp_extract(html, r"(?m)^window\." + name.replace("$", r"\$") + r" = (\{.*\});$", 1), F.lit("")), schema)


def read_ordered(spark: SparkSession, path: str, key: str) -> DataFrame:
    """A headed CSV, all text, with ``ordinal``: the row's place in the file from 0, by the place of its split and within. For one file."""
    from ..operators.windows import with_position

    src = spark.read.csv(path, header=True, encoding="UTF-8")
    if key not in src.columns:
        raise ContractError(f"{path} has no {key}")
    return with_position(src.select("*", F.col("_metadata.file_block_start").alias("__split"), F.monotonically_increasing_id().alias("__row")), ["__split", "__row"], "ordinal").drop("__split", "__row")


def read_member(table: DataFrame, roster: DataFrame, key: str, meta: list[str], blocked: list[str], forbidden: list[str] | None = None) -> DataFrame:
    """(key, ordinal, features as double) for exactly the keys of ``roster`` (key, ordinal). Columns of ``meta`` and ``blocked`` are no
    features. A column that is ``forbidden`` here, keys that repeat, are missing or unknown, a text that is no number and a table without
    features are refused."""
    if seen := sorted(set(forbidden or []) & set(table.columns)):
        raise ContractError(f"columns that must not be here: {seen}")
    names = [c for c in table.columns if c not in {key, "ordinal", *meta, *blocked}]
    if not names:
        raise ContractError("no features")
    held = require_unique(table.withColumn(key, F.trim(F.col(key).cast("string"))), [key])
    order = require_unique(roster.select(F.trim(F.col(key).cast("string")).alias(key), "ordinal"), [key])
    text = {c: F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in names}
    both = order.withColumn("__r", F.lit(1)).join(held.select(key, F.lit(1).alias("__t"), *(v.alias(c) for c, v in text.items())), key, "full")
    bad = both.agg(F.count_if(F.col("__r").isNull() | F.col("__t").isNull()).alias("__keys"), *(F.count_if(F.col(c).isNotNull() & F.col(c).try_cast("double").isNull()).alias(c) for c in names)).first()
    if bad["__keys"]:
        raise ContractError(f"{bad['__keys']} keys are in one of table and roster only")
    if wrong := [c for c in names if bad[c]]:
        raise ContractError(f"not numbers: {wrong}")
    return both.select(key, "ordinal", *(F.col(c).try_cast("double").alias(c) for c in names))


def schema_of(spark: SparkSession, path: str) -> list[str]:
    """Column names without reading data."""
    return spark.read.parquet(path).columns


def shard_coverage(df: DataFrame, at: Column, start: str, end: str, rows: int = 1000) -> DataFrame:
    """For each file the position of its first rows in time: before, inside and after [start, end)."""
    src = df.withColumn("file", F.input_file_name()).withColumn("at", at)
    first = src.withColumn("n", F.row_number().over(Window.partitionBy("file").orderBy(F.monotonically_increasing_id()))).filter(F.col("n") <= rows)
    a, b = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    return first.groupBy("file").agg(F.count_if(F.col("at") < a).alias("before"), F.count_if((F.col("at") >= a) & (F.col("at") < b)).alias("inside"), F.count_if(F.col("at") >= b).alias("after"), F.min("at").alias("first"), F.max("at").alias("last"))


def require_unique(df: DataFrame, keys: list[str], rows: int | None = None) -> DataFrame:
    n, distinct, nulls = df.agg(F.count("*"), F.count_distinct(*keys), F.count_if(F.greatest(*(F.col(k).isNull() for k in [*keys, *keys])))).first()
    if n != distinct or nulls or (rows is not None and n != rows):
        raise ContractError(f"{keys}: {n} rows, {distinct} different keys, {nulls} without")
    return df


def write_submission(df: DataFrame, path: str, id_col: str, value_cols: list[str], fmt: str = "%.6f") -> None:
    """One CSV part, UTF-8 without mark, LF, fixed column order and number format, sorted by id. For the
    few rows of a roster, so one task writes it."""
    out = df.select(F.col(id_col).cast("string").alias(id_col), *(F.format_string(fmt, F.col(c).cast("double")).alias(c) for c in value_cols))
    out.orderBy(id_col).coalesce(1).write.mode("errorifexists").csv(path, header=True, lineSep="\n", encoding="UTF-8", quoteAll=False)


def manifest(df: DataFrame, key: str, label: str | None = None) -> str:
    """Counts and missing rates of all columns, from one aggregate, as JSON with sorted keys."""
    row = df.agg(F.count("*").alias("rows"), F.count_distinct(key).alias("keys"), *([F.sum(label).alias("positives")] if label else []), *(F.avg(F.col(c).isNull().cast("double")).alias(f"missing.{c}") for c in df.columns)).first().asDict()
    return json.dumps(row, sort_keys=True, default=float)


def drop_ledger(kept: list[str], dropped: list[tuple[str, str, str]], rules: dict) -> str:
    """Which columns went, at which stage and why, as JSON with sorted keys: equal input gives equal bytes, so it
    holds no time. A column can't be kept and dropped, or dropped twice."""
    gone = [c for c, _, _ in dropped]
    if len(set(gone)) != len(gone) or set(gone) & set(kept):
        raise ContractError("a column has two fates")
    body = {"rules": rules, "kept": kept, "dropped": [{"column": c, "stage": stage, "reason": reason} for c, stage, reason in dropped]}
    return json.dumps(body, ensure_ascii=False, indent=2, sort_keys=True) + "\n"


def write_atomic(text: str, path: str) -> None:
    """A small file on the driver, whole or not at all: written beside its place and renamed to it."""
    folder = Path(path).resolve().parent
    handle, name = tempfile.mkstemp(dir=folder, prefix=f".{Path(path).name}.")
    try:
        with os.fdopen(handle, "w", encoding="utf-8", newline="\n") as out:
            out.write(text)
            out.flush()
            os.fsync(out.fileno())
        os.replace(name, path)
    except BaseException:
        Path(name).unlink(missing_ok=True)
        raise


def fingerprint(df: DataFrame, by: str, id_col: str) -> DataFrame:
    """SHA-256 of each group's sorted ids, comma-joined: a sorted partition is hashed as it comes, no group is gathered."""
    kind = df.schema[by].dataType

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n, digest = None, 0, None

        def done(values: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v[0] for v in values], batch.schema.field(0).type), pa.array([v[1] for v in values], pa.int64()), pa.array([v[2] for v in values], pa.string())], names=[by, "n", "sha256"])

        for batch in batches:
            out = []
            for group, text in zip(*(batch.column(i).to_pylist() for i in range(2))):
                if digest is None or group != now:
                    if digest is not None:
                        out.append((now, n, digest.hexdigest()))
                    now, n, digest, first = group, 0, hashlib.sha256(), True
                n += 1
                if text is not None:
                    digest.update((text if first else f",{text}").encode())
                    first = False
            yield done(out)
        if digest is not None:
            yield done([(now, n, digest.hexdigest())])

    dealt = df.select(by, id_col).repartition(by).sortWithinPartitions(by, id_col).select(by, F.col(id_col).cast("string").alias("__id"))
    return dealt.mapInArrow(scan, T.StructType([T.StructField(by, kind), T.StructField("n", T.LongType()), T.StructField("sha256", T.StringType())]))


@dataclass(frozen=True)
class WindowConfig:
    """The window triple, which has no defaults, and named paths relative to the file's folder."""

    as_of: str
    lookback_days: int
    horizon_days: int
    paths: dict[str, str] = field(default_factory=dict)


def load_config(path: str) -> WindowConfig:
    """A YAML, TOML or JSON file on the driver."""
    text, kind = Path(path).read_text(encoding="utf-8-sig"), Path(path).suffix
    if kind == ".json":
        raw = json.loads(text)
    elif kind == ".toml":
        import tomllib

        raw = tomllib.loads(text)
    else:
        import yaml

        raw = yaml.safe_load(text)
    if missing := [k for k in ("as_of", "lookback_days", "horizon_days") if k not in raw]:
        raise ContractError(f"{path} has no {missing}")
    base = Path(path).resolve().parent
    return WindowConfig(str(raw["as_of"]), int(raw["lookback_days"]), int(raw["horizon_days"]), {k: str(base / v) for k, v in raw.get("paths", {}).items()})


def column_list(text: str) -> list[str]:
    """An allow-list: a JSON array, or lines with # comments. Repeats are an error."""
    names = json.loads(text) if text.lstrip().startswith("[") else [x for line in text.splitlines() if (x := line.split("#")[0].strip())]
    if len(set(names)) != len(names):
        raise ContractError("a column is listed twice")
    return names
