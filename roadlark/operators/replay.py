"""The five-step rule replayed at every date: rates, knots, sharpened groups, extra weight in the warning zone, drift from an anchor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clip, knots
from ..sources.shared import checkpoint
from .windows import exact_quantiles, running, with_position

MAX_FOLDS = 1000


def share_below(df: DataFrame, train: DataFrame, by: list[str], value: str, name: str, ties: list[str] | None = None) -> DataFrame:
    """``df`` with the share of its group's values in ``train`` that are strictly below its own; 0.5 in a group without any,
    null for null. Rows are dealt by ranges of the value, and those of equal values by ``ties``, so no task holds a group."""
    ties = ties or []
    held = train.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__one")).withColumn("__kind", F.lit(1))
    probe = df.withColumns({"__one": F.lit(0).cast("long"), "__kind": F.lit(0)})
    run = running(probe.unionByName(held, allowMissingColumns=True), [*by, value, "__kind", *ties], {"__below": "__one"})
    start = run.groupBy(*by).agg(F.min("__below").alias("__start"), F.sum("__one").alias("__all"))
    share = F.when(F.col("__all") == 0, 0.5).otherwise((F.col("__below") - F.col("__start")) / F.greatest("__all", F.lit(1)))
    return run.filter("__kind = 0").join(start, by, "left").select(*df.columns, F.when(F.col(value).isNotNull(), share).alias(name))


def _once(value: Column, f) -> Column:
    """f of a value that is worked out once, however often and inside whatever loops f names it."""
    return F.transform(F.array(value), f)[0]


def code_rates(counts: DataFrame, exposure: DataFrame, roster: DataFrame, start: str, end: str, lookback: int, blind: tuple[str, ...]) -> DataFrame:
    """``roster`` with km (an array by day from ``start`` on) and rates (code -> an array by day): events per 1000 km over the ``lookback``
    days before each date. There is no rate without events or kilometres, and none of a ``blind`` code without the equipment it needs."""
    days = F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))
    within = F.col("day").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    dated = lambda x: F.map_from_entries(F.transform(x, lambda e: F.struct(e["day"], e["v"])))
    dense = lambda x: _once(x, lambda m: F.transform(days, lambda d: F.coalesce(F.try_element_at(m, d), F.lit(0.0))))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    frame = lambda v, i: F.slice(v, F.greatest(i - lookback, F.lit(0)) + 1, F.least(i, F.lit(lookback)))
    before = lambda x: _once(dense(dated(x)), lambda v: F.transform(v, lambda _, i: total(frame(v, i))))
    daily = lambda df, by, v: df.filter(within).groupBy(*by, "day").agg(F.sum(F.col(v).cast("double")).alias("v")).filter("v is not null").repartition("key")
    by_code = lambda x: F.map_from_entries(F.transform(F.array_distinct(F.transform(x, lambda e: e["code"])), lambda c: F.struct(c, before(F.filter(x, lambda e: e["code"] == c)))))
    km = daily(exposure, ["key"], "km").groupBy("key").agg(before(F.collect_list(F.struct("day", "v"))).alias("km"))  # a row for each date
    n = daily(counts.filter("code is not null"), ["key", "code"], "n").groupBy("key").agg(_once(F.collect_list(F.struct("code", "day", "v")), by_code).alias("rates"))
    own = roster.join(km, "key", "left").join(n, "key", "left").withColumn("km", F.coalesce("km", F.transform(days, lambda d: F.lit(0.0))))
    sees = lambda code: ~code.isin(*blind) | F.coalesce("equipped", F.lit(False)) if blind else F.lit(True)
    rate = lambda x, k: F.when((x > 0) & (k > 0), x / k * 1000)
    return own.withColumn("rates", F.transform_values(F.map_filter("rates", lambda code, _: sees(code)), lambda _, v: F.zip_with(v, F.col("km"), rate)))


def fit_knots(train: DataFrame, least: int = 5) -> DataFrame:
    """(machine, code, k50, k75, k95): values at the rounded ranks of codes with ``least`` rates or more; halves round to even."""
    placed = with_position(train.select("machine", "code", "rate", "key"), ["machine", "code", "rate", "key"], "__pos")
    size = placed.groupBy("machine", "code").agg(F.min("__pos").alias("__first"), F.count("*").alias("__size")).filter(F.col("__size") >= least)
    at = lambda p: F.least(F.col("__size") - 1, F.bround(F.lit(p / 100) * F.col("__size")).cast("long"))
    pick = lambda p: F.max(F.when(F.col("__pos") - F.col("__first") == at(p), F.col("rate")))
    # A row for each machine and code, as in the weights and rules below.
    return placed.join(F.broadcast(size), ["machine", "code"]).groupBy("machine", "code").agg(*(pick(p).alias(f"k{p}") for p in (50, 75, 95)))


def fit_weights(train: DataFrame, roster: DataFrame, top: int, least_top: int = 3, least_rest: int = 5) -> DataFrame:
    """(machine, code, w): by how much the mean log rate of the ``top`` keys of the teacher exceeds that of the rest, where it
    does and both have rates enough, with sum 1 for each machine."""
    first = roster.withColumn("__rn", F.row_number().over(Window.partitionBy("machine").orderBy(F.desc_nulls_last("teacher"), "key"))).filter(F.col("__rn") <= top)
    t = train.join(first.select("machine", "key", F.lit(True).alias("__top")), ["machine", "key"], "left").withColumn("__top", F.coalesce("__top", F.lit(False)))
    side = lambda c: F.when(c, F.log1p("rate"))
    up, rest = side(F.col("__top")), side(~F.col("__top"))
    g = t.groupBy("machine", "code").agg((F.avg(up) - F.avg(rest)).alias("w"), F.count(up).alias("a"), F.count(rest).alias("b"))
    g = g.filter((F.col("a") >= least_top) & (F.col("b") >= least_rest) & (F.col("w") > 0)).select("machine", "code", "w")
    return g.join(g.groupBy("machine").agg(F.sum("w").alias("__all")), "machine").select("machine", "code", (F.col("w") / F.col("__all")).alias("w"))


def group_rules(fitted: DataFrame, codes: DataFrame, unscored: tuple[str, ...]) -> DataFrame:
    """(machine, groups): for each scored group the knots of its codes, groups and codes in order."""
    own = fitted.join(codes, "code").filter(~F.col("grp").isin(*unscored) if unscored else F.lit(True))
    g = own.groupBy("machine", "grp").agg(F.array_sort(F.collect_list(F.struct("code", "k50", "k75", "k95"))).alias("rules"))
    return g.groupBy("machine").agg(F.array_sort(F.collect_list(F.struct("grp", "rules"))).alias("g")).select("machine", F.col("g.rules").alias("groups"))


def points_lost(rates: Column, groups: Column, days: Column) -> Column:
    """By day (``days``: their places in the arrays of ``rates``), of each group's 10 points, dealt evenly to its codes with a
    rate and knots, the worst code's loss and a quarter of the mean loss of the others."""
    f = lambda x, k: F.when(x >= k["k95"], 1.0).otherwise(knots(x, k["k50"], k["k75"], k["k95"]))
    losses = F.transform(groups, lambda g: F.transform(g, lambda k: F.transform(F.try_element_at(rates, k["code"]), lambda x: f(x, k))))
    none = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("top"), F.lit(0.0).alias("sum"))
    add = lambda s, x: F.when(x.isNull(), s).otherwise(F.struct((s["n"] + 1).alias("n"), F.greatest(s["top"], x).alias("top"), (s["sum"] + x).alias("sum")))
    rest = lambda s: F.when(s["n"] > 1, 0.25 * (s["sum"] - s["top"]) / (s["n"] - 1)).otherwise(0.0)
    points = lambda s: F.when(s["n"] > 0, 10 / s["n"] * (s["top"] + rest(s))).otherwise(0.0)
    on = lambda i: lambda lost, g: lost + F.aggregate(g, none, lambda s, by_day: add(s, F.get(by_day, i)), points)
    return _once(losses, lambda all_: F.transform(days, lambda i: F.aggregate(all_, F.lit(0.0), on(i))))


def _doors(values: Column, leave: float, again: float, start: float) -> Column:
    """An array of values -> whether in the zone after each; what is not in at first stays off."""
    first = F.when(F.get(values, 0) >= start, "in").otherwise("off")

    def step(s: Column, x: Column) -> Column:
        now = F.coalesce(s["now"], first)
        nxt = F.when((now == "in") & (x < leave), "out").when((now == "out") & (x > again), "in").otherwise(now)
        return F.struct(nxt.alias("now"), F.concat(s["all"], F.array(nxt == "in")).alias("all"))

    return F.aggregate(values, F.struct(F.lit(None).cast("string").alias("now"), F.array().cast("array<boolean>").alias("all")), step, lambda s: s["all"])


def replay_rules(counts: DataFrame, exposure: DataFrame, roster: DataFrame, codes: DataFrame, start: str, end: str, main: str, lookback: int = 20, blind: tuple[str, ...] = (), unscored: tuple[str, ...] = (), top: int = 50,
                 cap: float = 4.0, gate: float = 0.6, middle: float = 0.5, leave: float = 0.45, again: float = 0.55, half_km: float = 100.0, whole: float = 1.0) -> DataFrame:
    """(key, day, zone, raw, score) for every key of the roster and date in [start, end].

    ``counts`` (key, code, day, n), ``exposure`` (key, day, km), ``roster`` (key, fold, teacher, final, equipped), ``codes``
    (code, grp). Each key is scored by the machine fitted at ``main`` to the other folds. In the zone, where teacher and loss are high,
    up to ``cap`` points more are lost, by the weighted shares below the rates. The zone is open by day before ``main`` and
    has hysteresis from then on. Few kilometres shrink the value to the machine's median, the anchor, and ``score`` is the key's
    ``final`` moved by how far the value has drifted since ``main``.

    ``whole`` is what the two shares add up to: 1; the known quirk of the rule in use is 100. Membership of the zone is over
    ``middle`` in the fit and at least that in the replay, as there.

    A key is a row with arrays by day. Only what needs an order over all keys is taken apart by day: the losses of keys whose teacher
    is high, as no others can be in the zone, and the rates of days in the zone, as nowhere else anything more is lost.
    """
    place = F.date_diff(F.lit(main).cast("date"), F.lit(start).cast("date"))
    dates = F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))
    panel = checkpoint(code_rates(counts, exposure, roster, start, end, lookback, blind).select("key", "fold", "teacher", "final", "km", "rates"))
    now = checkpoint(panel.select("key", "fold", "teacher", F.transform_values("rates", lambda _, v: F.get(v, place)).alias("rates")))
    folds = [r.fold for r in now.select("fold").distinct().limit(MAX_FOLDS + 1).collect()]
    if len(folds) > MAX_FOLDS:
        raise ValueError(f"more than {MAX_FOLDS} folds")
    others = F.explode(F.filter(F.array(*(F.lit(f) for f in folds)), lambda m: m != F.col("fold")) if folds else F.array(F.col("fold"))).alias("machine")
    train_people = now.select("key", "teacher", others)
    train = now.select("key", "fold", F.explode("rates").alias("code", "rate")).filter("rate is not null").select("key", "code", "rate", others)
    weights = fit_weights(train, train_people, top)
    rules = group_rules(fit_knots(train), codes, unscored)

    # A seat is a key before a machine: its own over all days, or at ``main`` one of those that it helps to fit.
    places = F.sequence(F.lit(0), F.size("km") - 1)
    live = panel.select("key", "teacher", "rates", F.col("fold").alias("machine"), F.lit(False).alias("fit"), places.alias("days"))
    fits = now.withColumn("rates", F.transform_values("rates", lambda _, v: F.array(v))).select("key", "teacher", "rates", others, F.lit(True).alias("fit"), F.array(F.lit(0)).alias("days"))
    seats = live.unionByName(fits)
    seats = seats.join(F.broadcast(rules), "machine", "left")
    lost = points_lost(F.col("rates"), F.coalesce("groups", F.array()), F.col("days"))
    seats = checkpoint(seats.select("machine", "key", "fit", "teacher", lost.alias("lost")))
    seats = share_below(seats, train_people, ["machine"], "teacher", "__share", ["key", "fit"])
    seats = seats.select("machine", "key", "fit", "lost", F.coalesce(F.col("__share") > gate, F.lit(False)).alias("high"))
    by_seat = ["machine", "key", "fit"]

    losses = seats.filter("high").select(*by_seat, F.posexplode("lost").alias("place", "lost"))
    fitted = seats.filter("fit").select("machine", F.col("lost")[0].alias("lost"))
    shares = share_below(losses, fitted, ["machine"], "lost", "__share", ["key", "fit", "place"])
    v = shares.groupBy(*by_seat).agg(F.array_sort(F.collect_list(F.struct("place", F.col("__share").alias("v")))).alias("v"))  # a row for each date
    before, then = (F.transform(F.filter("v", c), lambda x: x["v"]) for c in (lambda x: x["place"] < place, lambda x: x["place"] >= place))
    zone = F.when(F.col("fit"), F.transform("v", lambda x: x["v"] > middle)).otherwise(F.concat(F.transform(before, lambda x: x >= middle), _doors(then, leave, again, middle)))
    zones = checkpoint(v.select(*by_seat, zone.alias("zone")).filter(F.exists("zone", lambda z: z)))

    in_zone = zones.join(panel.select("key", F.explode("rates").alias("code", "__by_day")), "key").join(F.broadcast(weights), ["machine", "code"])
    in_zone = in_zone.select(*by_seat, "code", "w", "__by_day", F.posexplode("zone").alias("place", "__in")).filter("__in").withColumn("rate", F.get("__by_day", F.when(F.col("fit"), place).otherwise(F.col("place"))))
    shares = share_below(in_zone.filter("rate is not null").select(*by_seat, "code", "w", "place", "rate"), train, ["machine", "code"], "rate", "__share", ["key", "fit", "place"])
    extra = shares.groupBy(*by_seat, "place").agg(F.least(F.lit(cap), F.sum(F.col("__share") * F.col("w"))).alias("extra"))
    extra = extra.groupBy(*by_seat).agg(F.map_from_entries(F.collect_list(F.struct("place", "extra"))).alias("extra"))  # a row for each date
    seats = checkpoint(seats.join(zones, by_seat, "left").join(extra, by_seat, "left"))

    more = lambda i: F.when(F.get("zone", i), F.coalesce(F.try_element_at("extra", i), F.lit(0.0))).otherwise(0.0)
    value = lambda i: F.greatest(F.lit(0.0), 100 - F.get("lost", i) - more(i))
    anchors = exact_quantiles(seats.filter("fit").withColumn("value", value(F.lit(0))), "value", {"anchor": 0.5}, "machine").drop("n")
    live = panel.select("key", "final", "km").join(seats.filter("not fit"), "key").join(F.broadcast(anchors), "machine", "left")

    def raw(i: Column) -> Column:
        km = F.get("km", i)
        share = km / (km + half_km)
        return F.when(km <= 0, F.col("anchor")).otherwise(share * value(i) + (whole - share) * F.col("anchor"))

    live = live.filter((place >= 0) & (place < F.size("km"))).withColumn("__base", raw(place))
    out = live.select("*", F.posexplode(dates).alias("__place", "day")).withColumns({"zone": F.coalesce(F.get("zone", F.col("__place")), F.lit(False)), "raw": raw(F.col("__place"))})
    return out.select("key", "day", "zone", "raw", F.round(clip(F.col("final") + F.col("raw") - F.col("__base"), 0.0, 100.0), 3).alias("score"))
