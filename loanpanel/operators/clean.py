"""Cleaning of parsed performance records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanpanel import schemas as S
from loanpanel.functions.dates import mmyyyy_to_date
from loanpanel.functions.stats import attach_group_row, present, quantiles
from loanpanel.session import stored


def type_columns(df: DataFrame) -> DataFrame:
    """Cast the numeric columns and parse the 'MMYYYY' date columns; bad values -> null."""
    fix = {c: F.col(c).try_cast("double") for c in S.NUMERIC_COLUMNS if c in df.columns}
    fix |= {c: mmyyyy_to_date(F.col(c)) for c in S.DATE_COLUMNS if c in df.columns}
    return df.withColumns(fix)


def fill_categorical(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    cols = [c for c in (cols or S.CATEGORICAL_COLUMNS) if c in df.columns]
    return df.fillna({c: S.MISSING for c in cols})


def fill_median(df: DataFrame, cols: Sequence[str] | None = None,
                by: Sequence[str] = ("data_quarter",)) -> DataFrame:
    """Null numerics -> exact median of their group (0.0 when the group has no value)."""
    cols = [c for c in (cols or S.NUMERIC_COLUMNS) if c in df.columns]
    by = list(by)
    med = quantiles(df, cols, [0.5], by)
    wide = (med.groupBy(*by).pivot("column", cols).agg(F.max("quantile"))
            .toDF(*by, *[f"__med_{c}" for c in cols]))
    out = attach_group_row(df, wide, by)
    fixed = {c: F.coalesce(present(c), F.col(f"__med_{c}"), F.lit(0.0)) for c in cols}
    return out.withColumns(fixed).select(*df.columns)


def clean(df: DataFrame, by: Sequence[str] = ("data_quarter",),
          extra: Sequence[str] = (), typed: str | None = None) -> DataFrame:
    """Raw strings -> the cleaned table, plus the grouping columns and ``extra`` ones.

    Lines are parsed and typed once: the medians' two scans and the result read the stored columns.
    They lie at ``typed``, else below the shared folder, and are left there.
    """
    keep = [c for c in dict.fromkeys([*S.CLEAN_COLUMNS, *by, *extra]) if c in df.columns]
    return fill_median(stored(fill_categorical(type_columns(df.select(*keep))), "typed", typed), by=by)
