"""End-to-end jobs: raw files to master tables, master to the panel with macro factors."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from loanpanel import schemas as S
from loanpanel.operators import clean as C
from loanpanel.operators import macro as M
from loanpanel.operators import panel as P
from loanpanel.session import remove_path, scratch_path
from loanpanel.sources import raw, sinks


def clean_quarters(spark: SparkSession, folder: str, quarters: Sequence[str], out: str,
                   name: str = "{}.csv") -> None:
    """Raw quarter files -> cleaned Parquet by quarter; quarters without a file are skipped.

    The copy of the typed lines goes when the cleaned ones are written.
    """
    df = raw.read_raw(spark, raw.quarter_glob(folder, quarters, name))
    keep = df.select(*S.CLEAN_COLUMNS, "data_quarter", *raw.INGEST_ORDER)
    typed = scratch_path(spark, "typed")
    try:
        sinks.write_master(C.clean(keep, extra=raw.INGEST_ORDER, typed=typed), out, rebalance=False)
    finally:
        remove_path(spark, typed)


def build_master(spark: SparkSession, cleaned: DataFrame, master: str, static: str,
                 ingest: Sequence[str] = raw.INGEST_ORDER) -> DataFrame:
    """Cleaned observations -> quarterly master and static master; returns the joined panel."""
    tv = P.encode_time_varying(cleaned, extra=ingest)
    sinks.write_master(P.dedup_last(tv, ingest), master)
    sinks.append_static(spark, P.static_covariates(cleaned, ["data_quarter", *ingest]), static)
    return P.join_static(sinks.read_master(spark, master), sinks.read_static(spark, static))


def add_macro(panel: DataFrame, observations: DataFrame,
              domains: Mapping[str, Sequence[str]] = S.MACRO_DOMAINS) -> DataFrame:
    """Panel with the components of the macro series in ``(series_id, date, value)`` rows."""
    monthly = M.monthly_average(M.valid_observations(observations))
    wide = M.wide_by_month(monthly, [s for ss in domains.values() for s in ss])
    components, _ = M.principal_components(wide, domains)
    return M.join_macro(M.add_act_period(panel), components)
