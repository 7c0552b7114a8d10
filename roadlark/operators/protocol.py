"""Checks of inputs, manifests, columns and results; what they count is data, what they refuse raises."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from datetime import date

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import ContractError
from ..sources.shared import checkpoint
from .joins import repeated_keys
from .windows import with_position


# ---- inputs


#: Bytes of a file that one leaf of its hash covers.
LEAF_BYTES = 64 << 20


def _leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, start, closed, open, bytes): hashes of each range's bytes, with a line feed at the end and without."""
    names = ["path", "start", "closed", "open", "bytes"]
    now, digest, size = None, None, 0

    def done() -> pa.RecordBatch:
        closed = digest.copy()
        closed.update(b"\n")
        return pa.RecordBatch.from_arrays([pa.array([v]) for v in (*now, closed.hexdigest(), digest.hexdigest(), size + 1)], names=names)

    for batch in batches:
        paths, starts, lines = (batch.column(i) for i in range(3))
        for (path, start), (i, j) in _stretches(paths.to_pylist(), starts.to_pylist()):
            data = b"\n".join(lines.slice(i, j - i).to_pylist())
            if now == (path, start):
                digest.update(b"\n")
                size += 1
            else:
                if now:
                    yield done()
                now, digest, size = (path, start), hashlib.sha256(), 0
            digest.update(data)
            size += len(data)
    if now:
        yield done()


def _stretches(paths: list, starts: list) -> Iterator[tuple]:
    begin = 0
    for i in range(1, len(paths) + 1):
        if i == len(paths) or (paths[i], starts[i]) != (paths[begin], starts[begin]):
            yield (paths[begin], starts[begin]), (begin, i)
            begin = i


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(name, sha256, bytes) of every file below a path, by its relative path.

    Files are read in ranges of LEAF_BYTES, each hashed in its task a few lines at a time, so a file may be larger than a
    row or a task's memory. A file of one range has its plain SHA-256; that of a larger one is the hash of its ranges'
    hashes in order. A file without bytes isn't listed.
    """
    whole = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("_metadata.file_path").alias("path"), F.col("length").alias("bytes"))
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in held:  # both, so that ranges begin at multiples of LEAF_BYTES whatever the cluster
            spark.conf.set(k, LEAF_BYTES)
        lines = spark.read.option("recursiveFileLookup", True).option("lineSep", "\n").text(path)
        parts = lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("line"))
        leaves = checkpoint(parts.mapInArrow(_leaves, "path string, start long, closed string, open string, bytes long"))
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    files = leaves.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("start", "closed", "open"))).alias("leaves"), F.sum("bytes").alias("read"))
    last = F.element_at("leaves", -1)
    own = F.when(F.col("read") == F.col("bytes"), last["closed"]).otherwise(last["open"])
    many = F.sha2(F.concat(F.lit("ranges:"), F.array_join(F.transform(F.slice("leaves", 1, F.size("leaves") - 1), lambda x: x["closed"]), ","), F.lit(","), own), 256)
    sha = F.when(F.col("leaves").isNull(), F.sha2(F.lit(""), 256)).when(F.size("leaves") == 1, own).otherwise(many)
    return whole.join(files, "path", "left").select(relative(F.col("path"), spark, path).alias("name"), sha.alias("sha256"), "bytes")


def relative(file: Column, spark: SparkSession, base: str) -> Column:
    """A file's path below ``base``; of a file that is the base itself its name."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
    root = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toUri().getRawPath().rstrip("/")
    plain = F.regexp_replace(file, "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    return F.when(plain.startswith(root + "/"), F.substring(plain, len(root) + 2, 1 << 30)).otherwise(F.substring_index(plain, "/", -1))


def tree_hash(hashes: DataFrame) -> str:
    """One hash of (name, sha256) rows: those of a folder are folded in the order of their names, then the folders."""
    folder = F.regexp_extract("name", "^(.*/)?[^/]*$", 1)
    line = F.concat("name", F.lit(":"), "sha256")
    folded = hashes.groupBy(folder.alias("folder")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(line)), "\n"), 256).alias("h"))
    return folded.agg(F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat("folder", F.lit(":"), "h"))), "\n"), 256)).first()[0]


def read_locked(spark: SparkSession, path: str, hashes: dict[str, str] | str, columns: list[str] | None = None) -> DataFrame:
    """Parquet files that are those of a manifest, with exactly the columns of its ledger.

    ``hashes`` has every file's hash by its relative path, or is the ``tree_hash`` of all: a file that was changed, added,
    taken away, renamed or moved is refused.
    """
    now = file_hashes(spark, path)
    if isinstance(hashes, str):
        if (found := tree_hash(now)) != hashes:
            raise ContractError(f"the files' hash is {found}, not {hashes}")
    else:
        found = {r.name: r.sha256 for r in now.collect()}  # one row for each file of the manifest
        if found != hashes:
            raise ContractError(f"hashes differ for {sorted(k for k in found.keys() | hashes.keys() if found.get(k) != hashes.get(k))}")
    df = spark.read.parquet(path)
    if columns is not None and set(df.columns) != set(columns):
        raise ContractError(f"columns differ: {sorted(set(df.columns) ^ set(columns))}")
    return df


def align(order: DataFrame, others: list[DataFrame], key: str, same: str | None = None) -> DataFrame:
    """``order`` with a ``position`` (its own, or that of the key) and the columns of the others, joined by key and in that order.

    Keys must be unique and equal on all sides, and the column ``same`` (a label) too where a table has it.
    """
    out = order if "position" in order.columns else with_position(order, [key])
    for other in others:
        for df in (order, other):
            if not repeated_keys(df, [key]).isEmpty():
                raise ContractError(f"{key} repeats")
        lost = order.select(key).join(other.select(key), key, "full_outer").count() - order.join(other.select(key), key, "left_semi").count()
        if lost:
            raise ContractError(f"{lost} keys are on one side only")
        if same and same in other.columns:
            both = order.select(key, F.col(same).alias("__a")).join(other.select(key, F.col(same).alias("__b")), key)
            if not both.filter(~F.col("__a").eqNullSafe(F.col("__b"))).isEmpty():
                raise ContractError(f"{same} differs")
            other = other.drop(same)
        clash = [c for c in other.columns if c in out.columns and c != key]
        if clash:
            raise ContractError(f"{clash} are there twice")
        out = out.join(other, key)
    return out


def append_ledger(df: DataFrame, path: str, version: str) -> None:
    """Rows added to a ledger under a version that it doesn't have yet."""
    spark = df.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p) and not spark.read.parquet(path).filter(F.col("version") == version).isEmpty():
        raise ContractError(f"version {version} is in the ledger")
    df.withColumn("version", F.lit(version)).write.mode("append").parquet(path)


# ---- manifests


def manifest_errors(m: dict) -> list[str]:
    """What is wrong with a protocol manifest: the order of its windows, versions, counts, leaks. Empty if nothing is."""
    out = [f"{k} is missing" for k in ("as_of", "feature_window", "label_window", "label_version", "split_version", "target_count") if not m.get(k)]
    if out:
        return out
    day = lambda x: date.fromisoformat(str(x)[:10])
    try:
        f0, f1, l0, l1, at = *map(day, m["feature_window"]), *map(day, m["label_window"]), day(m["as_of"])
    except (ValueError, TypeError):
        return ["a date can't be read"]
    if not f0 < f1 <= at:
        out.append("the feature window isn't before as_of")
    if not at <= l0 < l1:
        out.append("the label window isn't after as_of")
    if not isinstance(m["target_count"], int) or m["target_count"] < 1:
        out.append("target_count isn't a positive number")
    out += [f"{k} must be false" for k in ("label_used_in_features", "test_used_in_fit") if m.get(k)]
    out += [f"{k} isn't a SHA-256" for k, v in m.get("hashes", {}).items() if not re.fullmatch(r"[0-9a-f]{64}", str(v))]
    return out


# ---- columns


def views(columns: Iterable[str], rules: dict[str, str]) -> dict[str, list[str]]:
    """For each named pattern the columns that it removes from the full view, and 'slim', what no pattern removes.

    The views are disjoint and together the full one; a column goes to the first pattern that matches.
    """
    out: dict[str, list[str]] = {name: [] for name in [*rules, "slim"]}
    for c in columns:
        out[next((name for name, p in rules.items() if re.search(p, c)), "slim")].append(c)
    return out


def visibility(spark: SparkSession, sources: dict[str, tuple[str, str | None]], as_of: str) -> DataFrame:
    """(column, source, until, visible): a column is visible if its source ends at or before ``as_of``."""
    rows = [(c, source, until) for c, (source, until) in sources.items()]
    df = spark.createDataFrame(rows, "column string, source string, until string")
    return df.withColumn("visible", F.coalesce(F.col("until").cast("date") <= F.lit(as_of).cast("date"), F.lit(False)))


def window_errors(columns: dict[str, str | None], as_of: str, forbidden: str = r"(label|target|future|^y$)") -> list[str]:
    """Candidate columns (name -> last event time that it has seen) that may not be used at ``as_of``."""
    bad = [f"{c} is named like a label" for c in columns if re.search(forbidden, c, re.IGNORECASE)]
    return bad + [f"{c} has seen {until}" for c, until in columns.items() if until is None or str(until)[:10] > as_of]


def data_visibility(sources: dict[str, tuple[DataFrame, str, list[str]]], as_of: str) -> DataFrame:
    """(column, source, until, visible) of the columns made from each source, named with its rows, its time column and those columns: a
    column is visible if the last row that the source really has is from before ``as_of``. Sources without a row or a time are not."""
    out = None
    for name, (df, time, columns) in sources.items():
        until = df.agg(F.max(F.to_date(time)).alias("until"))
        part = until.select(F.explode(F.array(*map(F.lit, columns))).alias("column"), F.lit(name).alias("source"), "until")
        out = part if out is None else out.unionByName(part)
    return out.withColumn("visible", F.coalesce(F.col("until") < F.lit(as_of).cast("date"), F.lit(False)))


def window_evidence(df: DataFrame, time: str, columns: dict[str, Column], as_of: str, forbidden: str = r"(?i)(label|target|future|^y$)") -> DataFrame:
    """(column, rows, first, last, error) of candidate columns, each with the condition on the rows that it is made of: one pass over the
    rows. An error is a name like a label's, a row from ``as_of`` on, a row without a time, or no row at all; null if there is none."""
    cell = lambda c, x: F.when(F.coalesce(c, F.lit(False)), x)
    each = [F.struct(F.lit(n).alias("column"), F.count(cell(c, F.lit(1))).alias("rows"), F.count(cell(c & F.col(time).isNull(), F.lit(1))).alias("bare"), F.min(cell(c, F.col(time))).alias("first"), F.max(cell(c, F.col(time))).alias("last")) for n, c in columns.items()]
    found = df.agg(F.array(*each).alias("x")).select(F.inline("x"))
    late = F.col("last") >= F.lit(as_of).cast("timestamp_ntz")
    error = F.when(F.col("column").rlike(forbidden), "named like a label").when(F.col("rows") == 0, "made of nothing").when(F.col("bare") > 0, "a row without a time").when(late, "a row from the label's time")
    return found.select("column", "rows", F.to_date("first").alias("first"), F.to_date("last").alias("last"), error.alias("error"))


def manifest_faults(manifests: DataFrame) -> DataFrame:
    """(rule, violations) of a table of protocol manifests (feature_from, feature_to, as_of, label_from, label_to, label_version,
    split_version, target_count, label_used_in_features, test_used_in_fit), half-open windows: the rules of ``manifest_errors`` for any number of them."""
    c = F.col
    text = lambda name: F.coalesce(F.length(F.trim(c(name))) > 0, F.lit(False))
    return assertions(manifests, {
        "feature window before as_of": (c("feature_from") < c("feature_to")) & (c("feature_to") <= c("as_of")), "label window after as_of": (c("as_of") <= c("label_from")) & (c("label_from") < c("label_to")),
        "label version": text("label_version"), "split version": text("split_version"), "target count": c("target_count") > 0,
        "no label in features": ~F.coalesce(c("label_used_in_features"), F.lit(False)), "no test in the fit": ~F.coalesce(c("test_used_in_fit"), F.lit(False)),
    })


def view_contents(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """(view, column, present, different): what each view of ``views`` holds of the rows, in one pass."""
    found = views(df.columns, rules)
    each = [F.struct(F.lit(v).alias("view"), F.lit(c).alias("column"), F.count(F.col(c)).alias("present"), F.count_distinct(F.col(c)).alias("different")) for v, cs in found.items() for c in cs]
    return df.agg(F.array(*each).alias("x")).select(F.inline("x"))


def uniform(seed: int, name: str, key: Column) -> Column:
    """A number in [0, 1) by a hash of (seed, name, key)."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:{name}:"), key.cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)


def synthetic_like(df: DataFrame, key: str, columns: list[str], seed: int = 42, points: int = 21) -> DataFrame:
    """A row for each of ``df`` with its key and, for each column, a value drawn from the column's own distribution: the
    interpolated quantile at a hash of (seed, column, key). The columns are independent of each other and of the real row."""
    from .windows import exact_quantiles

    out = df.select(key)
    for c in columns:
        held = exact_quantiles(df, c, {f"q{i}": i / (points - 1) for i in range(points)}).drop("n").first()  # one row
        if held[0] is None:
            out = out.withColumn(c, F.lit(None).cast("double"))
            continue
        place = uniform(seed, c, F.col(key)) * (points - 1)
        at = lambda i: F.get(F.array(*(F.lit(float(q)) for q in held)), i.cast("int"))  # noqa: E731, B023
        low = F.floor(place)
        out = out.withColumn(c, at(low) + (place - low) * (at(low + 1) - at(low)))
    return out


# ---- results


def assertions(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, violations): rows for which a rule isn't true; one pass for all rules."""
    row = df.agg(*(F.count_if(~F.coalesce(c, F.lit(False))).alias(name) for name, c in rules.items()))
    return row.select(F.explode(F.create_map(*(x for name in rules for x in (F.lit(name), F.col(name))))).alias("rule", "violations"))


def require(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    if bad := assertions(df, rules).filter("violations > 0").collect():
        raise ContractError("; ".join(f"{r.rule}: {r.violations}" for r in bad))
    return df


def recomputed(old: DataFrame, new: DataFrame, keys: list[str], values: list[str], tolerance: float = 1e-9) -> DataFrame:
    """(column, compared, only_old, only_new, apart, largest) of a result and its independent recomputation."""
    a, b = (df.select(*keys, *(F.col(v).cast("double").alias(f"__{s}{v}") for v in values), F.lit(True).alias(f"__{s}")) for df, s in ((old, "o"), (new, "n")))
    j = a.join(b, keys, "full_outer")
    far = lambda v: F.when(F.col(f"__o{v}").isNull() != F.col(f"__n{v}").isNull(), float("inf")).otherwise(F.abs(F.col(f"__o{v}") - F.col(f"__n{v}")))
    both = F.col("__o").isNotNull() & F.col("__n").isNotNull()
    parts = F.array(*(F.struct(F.lit(v).alias("column"), F.when(both, F.coalesce(far(v), F.lit(0.0))).alias("d")) for v in values))
    return (j.select("__o", "__n", F.explode(parts).alias("p")).groupBy("p.column")
            .agg(F.count("p.d").alias("compared"), F.count_if(F.col("__n").isNull()).alias("only_old"), F.count_if(F.col("__o").isNull()).alias("only_new"), F.count_if(F.col("p.d") > tolerance).alias("apart"), F.max("p.d").alias("largest")))


def jitter(run: Callable[[int], float], seeds: Iterable[int]) -> dict[str, float]:
    """Spread of a metric over seeds: a change within three times the range isn't one."""
    values = [run(s) for s in seeds]
    mean = sum(values) / len(values)
    return {"mean": mean, "std": (sum((v - mean) ** 2 for v in values) / len(values)) ** 0.5, "range": max(values) - min(values)}


def prediction_errors(df: DataFrame, id_col: str, p: str, label: str) -> list[str]:
    """What a checker of predictions must refuse: repeated ids, missing or impossible probabilities, labels not 0 or 1."""
    n, ids, missing, outside, labels, classes = df.agg(
        F.count("*"), F.count_distinct(id_col), F.count_if(F.col(p).isNull() | F.isnan(p)), F.count_if((F.col(p) < 0) | (F.col(p) > 1)), F.count_if(~F.coalesce(F.col(label).isin(0, 1), F.lit(False))), F.count_distinct(label)).first()
    checks = {"repeated id": n != ids, "missing probability": missing, "probability out of range": outside, "label": labels, "a single class": classes < 2}
    return [name for name, bad in checks.items() if bad]
