"""Model features: splitting, screening, imputation, selection, scaling."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanpanel import schemas as S
from loanpanel.functions.dates import lenient_timestamp
from loanpanel.functions.stats import quantiles, safe_corr

DATETIME_COLUMNS = ["ORIG_DATE", "FORECLOSURE_DATE", "MATR_DT", "quarter", "macro_quarter"]


def coerce_dates(df: DataFrame, cols: Sequence[str] = DATETIME_COLUMNS) -> DataFrame:
    return df.withColumns({c: lenient_timestamp(F.col(c)) for c in cols if c in df.columns})


def time_split(df: DataFrame, split: str | dt.date = "2020-12-31",
               column: str = "macro_quarter") -> tuple[DataFrame, DataFrame]:
    """Rows up to and including the split date, and rows after it (null dates in neither)."""
    day = F.lit(str(split)).cast("date")
    return df.where(F.col(column) <= day), df.where(F.col(column) > day)


def _valid(event: str, duration: str) -> Column:
    return (F.col(duration) > 0) & F.col(event).isin(0, 1)


def valid_survival(df: DataFrame, event: str = "survival_event",
                   duration: str = "survival_time") -> DataFrame:
    """Rows with a known 0/1 event and a positive duration."""
    return df.where(_valid(event, duration))


def screen_features(df: DataFrame, event: str = "survival_event",
                    duration: str = "survival_time") -> DataFrame:
    """``(feature, variance, infinite, keep)`` for every numeric candidate column, one pass.

    Kept: positive finite variance over all rows, no infinite value among valid rows.
    """
    cols = [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in (event, duration)
            and not any(p in f.name for p in S.NON_FEATURE_PATTERNS)]
    inf = float("inf")
    row = df.agg(
        *[F.var_samp(c).alias(f"v{i}") for i, c in enumerate(cols)],
        *[F.count_if((F.abs(c) == inf) & _valid(event, duration)).alias(f"i{i}")
          for i, c in enumerate(cols)])
    cells = [F.struct(F.lit(c).alias("feature"), F.nanvl(F.col(f"v{i}"), F.lit(None)).alias("variance"),
                      F.col(f"i{i}").alias("infinite")) for i, c in enumerate(cols)]
    keep = (F.coalesce(F.col("variance"), F.lit(0.0)) > 0) & (F.col("infinite") == 0)
    return row.select(F.inline(F.array(*cells))).withColumn("keep", keep)


def feature_names(df: DataFrame, event: str = "survival_event",
                  duration: str = "survival_time") -> list[str]:
    """Names kept by :func:`screen_features`, in column order."""
    kept = {r["feature"] for r in screen_features(df, event, duration).where("keep").collect()}
    return [c for c in df.columns if c in kept]


def fit_medians(df: DataFrame, cols: Sequence[str]) -> dict[str, float]:
    """Exact median per column (one number each); 0.0 for a column without values."""
    med = {r["column"]: r["quantile"] for r in quantiles(df, cols, [0.5]).collect()}
    return {c: med.get(c, 0.0) for c in cols}


def fill_features(df: DataFrame, medians: Mapping[str, float]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(m)) for c, m in medians.items()})


def macro_features(columns: Sequence[str], components: Sequence[str] = (),
                   keywords: Sequence[str] = S.MACRO_NAME_KEYWORDS) -> list[str]:
    """Macro columns: the components that were joined, plus names holding a keyword."""
    return [c for c in columns if c in components or any(k in c for k in keywords)]


def rank_features(df: DataFrame, cols: Sequence[str], event: str = "survival_event",
                  top: int | None = None) -> DataFrame:
    """Features by absolute correlation with the event, largest first; one aggregation."""
    row = df.agg(*[safe_corr(c, event).alias(c) for c in cols])
    ranked = (row.unpivot([], list(cols), "feature", "corr")
              .withColumn("abs_corr", F.abs("corr")).orderBy(F.desc_nulls_last("abs_corr"), "feature"))
    return ranked.limit(top) if top else ranked


def select_features(df: DataFrame, cols: Sequence[str], top: int,
                    event: str = "survival_event") -> list[str]:
    """All columns when there are at most ``top``, else exactly the ``top`` best ranked."""
    if len(cols) <= top:
        return list(cols)
    return [r["feature"] for r in rank_features(df, cols, event, top).collect()]


@dataclass(frozen=True)
class Scaler:
    """Column means and population deviations of the training rows."""

    mean: dict[str, float]
    scale: dict[str, float]

    @classmethod
    def fit(cls, df: DataFrame, cols: Sequence[str]) -> Scaler:
        row = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
                     *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(cols)]).first()
        return cls({c: row[f"m{i}"] for i, c in enumerate(cols)},
                   {c: row[f"s{i}"] or 1.0 for i, c in enumerate(cols)})

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c) - m) / self.scale[c] for c, m in self.mean.items()})
