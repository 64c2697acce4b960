"""Macro factors against delinquency."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loanpanel.functions.dates import quarter_start
from loanpanel.functions.stats import attach_group_row, breaks_below, quantiles_of_counts
from loanpanel.operators.delinquency import means_by
from loanpanel.operators.loan_bitmaps import sums_and_loans


def factor_columns(panel: DataFrame, first_only: bool = False) -> list[str]:
    return [c for c in panel.columns if "_PC1" in c or (not first_only and "_PC2" in c)]


def quarterly_factors(panel: DataFrame, factors: Sequence[str] | None = None) -> DataFrame:
    """Mean of the factors (all of the panel's by default) by quarter, with the quarter's start date."""
    factors = list(factors or factor_columns(panel))
    out = means_by(panel, ["data_quarter"], {f"avg_{c}": c for c in factors})
    return out.withColumn("quarter_start", quarter_start(F.col("data_quarter")))


def stress_factor(columns: Sequence[str]) -> str:
    """The factor named stress or financial, else the first."""
    named = [c for c in columns if "stress" in c.lower() or "financial" in c.lower()]
    return (named or list(columns))[0]


def delinquency_by_decile(panel: DataFrame, factor: str) -> DataFrame:
    """Delinquency rate by decile of a factor; deciles are right-closed, null is its own group."""
    cells = panel.groupBy(factor).agg(
        F.sum("any_delinquent").alias("d"), F.count("any_delinquent").alias("n"),
        F.count("*").alias("rows"))
    f = F.col(factor)
    counts = cells.where(f.isNotNull()).select(F.lit(factor).alias("column"), f.alias("value"),
                                               F.col("rows").alias("n"))
    breaks = quantiles_of_counts(counts, [i / 10 for i in range(1, 10)])
    cut = breaks.agg(F.sort_array(F.collect_list("quantile")).alias("cut"))
    decile = F.concat(F.lit("Q"), (1 + breaks_below(f, F.col("cut"), 9)).cast("string"))
    return (attach_group_row(cells, cut, []).groupBy(F.when(f.isNotNull(), decile).alias("decile"))
            .agg((F.sum("d") / F.sum("n")).alias("dlq_rate"),
                 (F.sum(f * F.col("rows")) / F.sum(F.when(f.isNotNull(), F.col("rows")))).alias("avg_stress"))
            .orderBy("avg_stress"))


def factor_and_delinquency(panel: DataFrame, factor: str = "housing_market_PC1") -> DataFrame:
    return means_by(panel, ["data_quarter"], {"factor_avg": factor, "dlq_rate": "any_delinquent"})


def factor_impact(panel: DataFrame, factor: str = "credit_markets_PC1") -> DataFrame:
    """Delinquent rows per active loan by quarter against a factor, with linear trend.

    The trend and correlation appear on every row; they are null below three quarters.
    """
    sums = sums_and_loans(panel, ["data_quarter"], {
        "factor_sum": F.col(factor), "factor_n": F.col(factor).isNotNull().cast("int"),
        "dlq_count": F.col("any_delinquent")}, "active_loans")
    quarters = sums.select(
        "data_quarter", F.try_divide("factor_sum", "factor_n").alias("factor_avg"), "dlq_count", "active_loans",
        (F.try_divide("dlq_count", "active_loans") * 100).alias("dlq_pct"))
    every = Window.partitionBy()  # one row per quarter
    sxx, syy, sxy = [f("dlq_pct", "factor_avg").over(every) for f in (F.regr_sxx, F.regr_syy, F.regr_sxy)]
    slope = F.try_divide(sxy, F.nullif(sxx, F.lit(0.0)))
    level = F.avg("dlq_pct").over(every) - slope * F.avg("factor_avg").over(every)
    corr = F.try_divide(sxy, F.nullif(F.sqrt(sxx * syy), F.lit(0.0)))
    enough = F.count("*").over(every) > 2
    return quarters.withColumns({
        "slope": F.when(enough, slope), "intercept": F.when(enough, level),
        "corr": F.when(enough, corr)}).orderBy("data_quarter")
