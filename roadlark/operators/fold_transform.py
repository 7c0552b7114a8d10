"""One object for all that is learnt from the training rows of a fold: cohort statistics, pruning, imputation, categories."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import number
from ..sources.files import ContractError
from ..sources.shared import checkpoint
from .aggregates import cohort_relative
from .cleaning import _quantiles, finalize_columns

MISSING = "__MISSING__"
#: Values of one text column that may become columns of their own.
MAX_CATEGORIES = 1000


@dataclass
class FoldTransform:
    """Fitted by ``fit`` on training rows; ``transform`` makes the same columns of any rows and learns nothing from them."""

    numbers: list[str]
    categories: dict[str, list[str]]
    medians: dict[str, float]
    dropped: list[tuple[str, str, str]]
    sources: list[str] = field(default_factory=list)
    group: str | None = None
    ratio: str | None = None
    split: float | None = None
    pool: DataFrame | None = None
    least: int = 30
    rows: int = 0
    fingerprint: str = ""

    @classmethod
    def fit(cls, train: DataFrame, key: str, numbers: list[str], texts: list[str], sources: list[str] | None = None, group: str | None = None, ratio: str | None = None, limit: float = 0.95, least: int = 30) -> FoldTransform:
        """``sources`` get a z-score and a percentile in the cohort of their ``group`` and of the side of ``ratio``'s median that a row is on ('na' without
        one); cohorts of fewer than ``least`` rows take the statistics of all. Then twins, constants and correlated numbers are dropped in
        the order given, and texts with less than two values; numbers get their medians for missing ones, 0 if there is none."""
        found = cls([], {}, {}, [], sources or [], group, ratio, None, None, least)
        if found.sources:
            if ratio:
                found.split = (_quantiles(train.select(F.lit(0).alias("c"), number(F.col(ratio)).alias("v")), [0.5]).get(0) or [None])[0]
            found.pool = checkpoint(train.select(found._cohort().alias("__cohort"), *(number(F.col(s)).alias(s) for s in found.sources)))
        made = checkpoint(found._with_cohorts(train))
        named = [*numbers, *(f"{s}_cohort_{k}" for s in found.sources for k in ("z", "pct"))]
        found.numbers, found.dropped = finalize_columns(made.select(*(number(F.col(c)).alias(c) for c in named)), named, limit) if named else ([], [])
        long = made.select(F.inline(F.array(*(F.struct(F.lit(i).alias("c"), number(F.col(c)).alias("v")) for i, c in enumerate(found.numbers))))) if found.numbers else None
        middle = _quantiles(long, [0.5]) if found.numbers else {}
        found.medians = {c: middle[i][0] if i in middle else 0.0 for i, c in enumerate(found.numbers)}
        for c in texts:
            values = [r.v for r in made.select(F.coalesce(F.col(c).cast("string"), F.lit(MISSING)).alias("v")).distinct().orderBy("v").limit(MAX_CATEGORIES + 1).collect()]
            if len(values) > MAX_CATEGORIES:
                raise ContractError(f"{c} has more than {MAX_CATEGORIES} values")
            if len([v for v in values if v != MISSING]) > 1:
                found.categories[c] = values
            else:
                found.dropped.append((c, "one_value", ""))
        n, total = train.agg(F.count("*"), F.sum(F.xxhash64(key).cast("decimal(38,0)"))).first()
        found.rows, found.fingerprint = n, f"{n}:{total}"
        return found

    def _cohort(self) -> Column:
        side = F.lit("na")
        if self.ratio and self.split is not None:
            side = F.when(number(F.col(self.ratio)).isNull(), "na").when(number(F.col(self.ratio)) > self.split, "hi").otherwise("lo")
        return F.concat(F.coalesce(F.col(self.group).cast("string"), F.lit("unknown")) if self.group else F.lit("all"), F.lit("|"), side)

    def _with_cohorts(self, df: DataFrame) -> DataFrame:
        """``df`` with the cohort columns: its rows take their place among the pool's, which alone count."""
        for s in self.sources:
            rows = df.withColumns({"__cohort": self._cohort(), "__x": number(F.col(s)), "__train": F.lit(False)})
            pool = self.pool.select("__cohort", F.col(s).alias("__x"), F.lit(True).alias("__train"))
            placed = cohort_relative(rows.unionByName(pool, allowMissingColumns=True), "__cohort", "__x", "__train", self.least).filter(~F.col("__train"))
            df = placed.select(*df.columns, F.col("z").alias(f"{s}_cohort_z"), F.col("pct").alias(f"{s}_cohort_pct"))
        return df

    @property
    def columns(self) -> list[str]:
        return [*self.numbers, *(f"{c}={v}" for c, values in self.categories.items() for v in values)]

    def transform(self, df: DataFrame, keep: list[str]) -> DataFrame:
        """``keep`` and the fitted columns: numbers without gaps, 0 / 1 for the known values of texts, all 0 for others."""
        made = self._with_cohorts(df)
        filled = [F.coalesce(number(F.col(c)), F.lit(float(self.medians[c]))).alias(c) for c in self.numbers]
        flags = [(F.coalesce(F.col(c).cast("string"), F.lit(MISSING)) == v).cast("int").alias(f"{c}={v}") for c, values in self.categories.items() for v in values]
        return made.select(*keep, *filled, *flags)
