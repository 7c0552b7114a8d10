"""Temporal URL lists: captures are judged by the entries that were active when they were fetched.

A list entry is dated: it adds or removes a pattern (a host with all its subdomains, or a path
prefix on one host) from a list as of a time. Entries of one list and pattern become validity intervals
[from, until), the as-of join finds, for every key that a capture's URL can match (its host and
each parent domain, and each directory of its path), the intervals that hold at the fetch time.
Hosts are compared in lower case, paths as they are written. A URL's keys go only as deep as the
deepest pattern of the lists, which changes no result and keeps very long URLs linear.
An allow entry outweighs a block entry of the same or a shorter pattern, so the longest active
pattern decides and allow wins a tie.

All steps are built-in expressions. The intervals of a list and pattern are one row, in the order of time; captures
meet it by an equi-join on the pattern and find the interval that holds by halving, so a pattern with many changes
costs a capture their logarithm. Captures of a hot key, one with a ``HOT_SHARE`` of all, are dealt over as many keys as
it has such shares, for which that key's row alone is repeated; what was matched is aggregated by
capture partially before any shuffle.

Defined results: a null or malformed URL has no host, matches nothing and is kept; a null fetch
time is never in an interval; entries with a null pattern or time are void; of entries of one
list, pattern and time the removal counts; repeated entries count once, repeated captures stay
repeated; an empty list keeps everything; output columns replace input columns of their name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, table

#: A key with this share of all probes, and LEAST_HOT of them, is hot: there are at most 1 / HOT_SHARE such keys.
HOT_SHARE, LEAST_HOT = 1 / 1000, 1000


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and a final dot; null if there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@\s]+?)\.?(?::\d*)?(?:[/?#]|$)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)


def intervals(entries: DataFrame) -> DataFrame:
    """(list, action, pattern, change, at) -> (list, action, pattern, valid_from, valid_until); open ends are null."""
    good = entries.filter("pattern is not null and at is not null and change in ('add', 'remove')").withColumn("pattern", canonical(F.col("pattern")))
    one = good.groupBy("list", "action", "pattern", "at").agg(F.max("change").alias("change"))
    w = Window.partitionBy("list", "action", "pattern").orderBy("at")
    runs = one.withColumn("before", F.lag("change").over(w)).filter("before is null or before <> change")
    return runs.withColumn("valid_until", F.lead("at").over(w)).filter("change = 'add'").select("list", "action", "pattern", F.col("at").alias("valid_from"), "valid_until")


def canonical(pattern: Column) -> Column:
    """A pattern with its host in lower case."""
    host = F.substring_index(pattern, "/", 1)
    return F.concat(F.lower(host), F.substr(pattern, F.length(host) + 1))


def as_of(runs: Column, time: Column) -> Column:
    """Of (valid_from, valid_until) in the order of time the last that begins at or before ``time``, found by halving; null if it is over by then."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(runs) + 1)).cast("int"))
    half = lambda s: F.floor((s["low"] + s["high"]) / 2).cast("int")
    # low begins at or before the time, high after it
    narrow = lambda s, _: F.when(s["high"] - s["low"] <= 1, s).otherwise(F.when(F.get(runs, half(s))["valid_from"] <= time, F.struct(half(s).alias("low"), s["high"].alias("high"))).otherwise(F.struct(s["low"].alias("low"), half(s).alias("high"))))
    found = F.aggregate(steps, F.struct(F.lit(-1).alias("low"), F.size(runs).alias("high")), narrow, lambda s: F.when(s["low"] >= 0, F.get(runs, s["low"])))
    return F.when(found["valid_until"].isNull() | (time < found["valid_until"]), found)


def depths(spans: DataFrame) -> tuple[int, int]:
    """The most labels and the most directories that a pattern has."""
    host = F.substring_index("pattern", "/", 1)
    return spans.agg(F.coalesce(F.max(F.size(F.split(host, r"\."))), F.lit(0)), F.coalesce(F.max(F.size(F.split("pattern", "/")) - 1), F.lit(0))).first()


def keys_of(host: Column, path: Column, labels: int, directories: int) -> Column:
    """The patterns that can cover a URL: its host and parent domains; its host with each directory."""
    parts = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(max(labels, 1)))), lambda i: F.call_function("substring_index", host, F.lit("."), -i))
    # 'a/b/' has the directories '/', '/a/' and '/a/b/'. What is left of a cut path is cut no further.
    cut = F.substring_index(path, "/", directories + 1)
    depth = F.length(cut) - F.length(F.replace(cut, F.lit("/"), F.lit("")))
    folders = F.transform(F.sequence(F.lit(1), F.greatest(F.least(depth, F.lit(directories)), F.lit(1))), lambda i: F.concat(host, F.call_function("substring_index", cut, F.lit("/"), i), F.lit("/")))
    return F.array_distinct(F.concat(domains, folders) if directories else domains)


def filter_urls(captures: DataFrame, entries: DataFrame, url_col: str = "url", time_col: str = "fetched") -> DataFrame:
    """``captures`` with ``matched`` (the deciding pattern), ``matched_list``, ``decision`` (block, allow or null) and ``kept``."""
    made = ["matched", "matched_list", "decision", "kept"]
    keep = [c for c in captures.columns if c not in made]
    spans = intervals(entries)
    labels, directories = depths(spans)
    runs = spans.groupBy("list", "action", "pattern").agg(F.sort_array(F.collect_list(F.struct("valid_from", "valid_until"))).alias("runs"))
    # One row for each different capture, so that repeated captures meet the lists once.
    seen = captures.select(F.col(url_col).alias("__rl_url"), F.col(time_col).alias("__rl_time")).filter("__rl_url is not null and __rl_time is not null").distinct()
    parsed = seen.withColumns({"__rl_host": host_of(F.col("__rl_url")), "__rl_path": path_of(F.col("__rl_url"))}).filter("__rl_host is not null")
    probes = parsed.withColumn("__rl_key", F.explode(keys_of(F.col("__rl_host"), F.col("__rl_path"), labels, directories))).drop("__rl_host", "__rl_path")
    counts = probes.groupBy("__rl_key").agg(F.count("*").alias("n"))
    counts = cut(counts.join(runs.select(F.col("pattern").alias("__rl_key")).distinct(), "__rl_key", "left_semi"))
    least = max(LEAST_HOT, int((counts.agg(F.sum("n")).first()[0] or 0) * HOT_SHARE))
    hot = F.broadcast(counts.filter(F.col("n") >= least).select("__rl_key", F.ceil(F.col("n") / least).cast("int").alias("__rl_salts")))  # 1 / HOT_SHARE rows at most
    dealt = probes.join(hot, "__rl_key", "left").withColumn("__rl_salt", F.pmod(F.xxhash64("__rl_url", "__rl_time"), F.coalesce("__rl_salts", F.lit(1))).cast("int"))
    held = runs.withColumnRenamed("pattern", "__rl_key").join(hot, "__rl_key", "left").withColumn("__rl_salt", F.explode(F.sequence(F.lit(0), F.coalesce("__rl_salts", F.lit(1)) - 1))).drop("__rl_salts")
    hits = dealt.join(held, ["__rl_key", "__rl_salt"]).filter(as_of(F.col("runs"), F.col("__rl_time")).isNotNull()).withColumnRenamed("__rl_key", "pattern")
    # allow > block; of equal patterns the list first in name order is named.
    weight = F.struct(F.length("pattern").alias("n"), (F.col("action") == "allow").cast("int").alias("allow"), "pattern", "list", "action")
    best = hits.groupBy("__rl_url", "__rl_time").agg(F.max(weight).alias("__rl_best"))
    out = captures.select(*keep).join(best, (F.col(url_col) == F.col("__rl_url")) & (F.col(time_col) == F.col("__rl_time")), "left")
    return out.select(*keep, F.col("__rl_best.pattern").alias("matched"), F.col("__rl_best.list").alias("matched_list"), F.col("__rl_best.action").alias("decision"), (~F.col("__rl_best.action").eqNullSafe("block")).alias("kept"))


def page_captures(pages: DataFrame) -> DataFrame:
    """The pages as captures; they carry no fetch time, so each gets a day of 2024 by its id."""
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(366)).cast("int")).alias("fetched"))


def host_entries(pages: DataFrame) -> DataFrame:
    """Dated list entries over the hosts that occur: by a host's hash it is blocked and later released,
    allowed, or one of its directories is blocked; and one domain is blocked as a whole."""
    hosts = pages.select(host_of(F.col("url")).alias("host")).filter("host is not null").distinct()
    h = F.conv(F.substring(F.md5("host"), 1, 4), 16, 10).cast("int")
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n)
    start = F.pmod(h, F.lit(200)).cast("int")
    rows = [
        (h % 4 == 0, "abuse", "block", F.col("host"), "add", day(start)),
        (h % 4 == 0, "abuse", "block", F.col("host"), "remove", day(start + 100)),
        (h % 8 == 4, "abuse", "block", F.col("host"), "add", day(start + 130)),
        (h % 6 == 0, "trusted", "allow", F.col("host"), "add", day(start + 20)),
        (h % 3 == 1, "paths", "block", F.concat("host", F.lit("/en/")), "add", day(start + 10)),
    ]
    made = F.array(*(F.when(c, F.struct(F.lit(name).alias("list"), F.lit(action).alias("action"), pattern.alias("pattern"), F.lit(change).alias("change"), at.alias("at"))) for c, name, action, pattern, change, at in rows))
    out = hosts.select(F.explode(F.filter(made, lambda x: x.isNotNull())).alias("e")).select("e.*")
    fixed = pages.sparkSession.createDataFrame([("domains", "block", "example.org", "add", "2024-06-01")], "list string, action string, pattern string, change string, at string")
    return out.unionByName(fixed.withColumn("at", F.col("at").cast("date")))


def op5_url_filters(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(page_captures(pages), host_entries(pages)).select("page_id", "url", "fetched", "matched", "matched_list", "decision", "kept")
