"""Panel structure: sizes, spans, balance, missing values, key figures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanpanel.functions.stats import small_total
from loanpanel.operators.cycles import factor_columns
from loanpanel.operators.panel import _distinct

FIRST_ATTRIBUTES = ["ORIG_DATE", "CSCORE_B", "DTI", "ORIG_RATE", "ORIG_UPB", "OLTV",
                    "PURPOSE", "STATE", "PROP"]
TIME_VARYING = ["balance_ratio", "credit_score_change", "rate_change"]
def loan_summary(panel: DataFrame, factors: Sequence[str] | None = None) -> DataFrame:
    """One row per loan: origination attributes, worst outcome, panel span, variation.

    ``factors`` are the macro factors to average, by default every one in the panel.
    Columns the panel lacks are left out.  One aggregation keyed by loan.
    """
    have = set(panel.columns)
    factors = factor_columns(panel) if factors is None else factors
    first = [c for c in FIRST_ATTRIBUTES if c in have]
    varying = [c for c in TIME_VARYING if c in have]
    factors = [c for c in factors if c in have]
    seen = F.struct("time", "data_quarter")
    aggs = [F.min_by(F.struct(*first), seen).alias("__first"),
            F.max("event").alias("event_max"),
            F.max("any_delinquent").alias("any_delinquent_max"),
            F.count("time").alias("time_count"), F.min("time").alias("time_min"),
            F.max("time").alias("time_max"), F.min("data_quarter").alias("first_quarter"),
            F.max("data_quarter").alias("last_quarter")]
    out = ["event_max", "any_delinquent_max", "time_count", "time_min", "time_max",
           "first_quarter", "last_quarter"]
    if varying:
        aggs.append(F.max_by(F.struct(*varying), seen).alias("__last"))
    for c in varying:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std")]
        out += [F.col(f"__last.{c}").alias(f"{c}_last"), f"{c}_mean", f"{c}_std"]
    aggs += [F.avg(c).alias(f"{c}_mean") for c in factors]
    out += [f"{c}_mean" for c in factors]
    if "serious_delinquent" in have:
        aggs.append(F.max("serious_delinquent").alias("serious_delinquent_max"))
        out.append("serious_delinquent_max")
    return panel.groupBy("LOAN_ID").agg(*aggs).select("LOAN_ID", "__first.*", *out)


def panel_overview(panel: DataFrame) -> DataFrame:
    loans = panel.groupBy("LOAN_ID").agg(
        F.count("*").alias("obs"), F.count("time").alias("times"), F.min("time").alias("t0"),
        F.max("time").alias("t1"))
    quarters = panel.agg(_distinct("data_quarter").alias("n"), F.min("data_quarter").alias("a"),
                         F.max("data_quarter").alias("z"))
    q = quarters.select(F.struct("n", "a", "z")).scalar()
    return (loans.agg(F.count("*").alias("loans"), F.sum("obs").alias("observations"),
                      F.avg("obs").alias("avg_observations"),
                      F.min("times").alias("min_observations"),
                      F.max("times").alias("max_observations"),
                      F.min("t0").alias("min_time"), F.max("t1").alias("max_time"))
            .withColumns({"quarters": q.getField("n"), "first_quarter": q.getField("a"),
                          "last_quarter": q.getField("z")}))


def observation_counts(panel: DataFrame) -> DataFrame:
    """``(obs, loans)``: how many loans have each panel length."""
    per_loan = panel.groupBy("LOAN_ID").agg(F.count("*").alias("obs"))
    return per_loan.groupBy("obs").agg(F.count("*").alias("loans"))


def panel_balance(panel: DataFrame) -> DataFrame:
    """Every panel length with its share of loans, shortest first."""
    counts = observation_counts(panel)  # one row per panel length
    pct = F.col("loans") / small_total("loans") * 100
    return counts.withColumn("pct", pct).orderBy("obs")


def event_transitions(panel: DataFrame) -> DataFrame:
    """Loans by number of distinct event values."""
    per_loan = panel.groupBy("LOAN_ID").agg(_distinct("event").alias("unique_events"))
    counts = per_loan.groupBy("unique_events").agg(F.count("*").alias("loans"))
    return counts.withColumn("pct", F.col("loans") / small_total("loans") * 100).orderBy("unique_events")


def event_complexity(panel: DataFrame) -> DataFrame:
    return panel.groupBy("LOAN_ID").agg(F.count("event").alias("total_obs"),
                                        _distinct("event").alias("unique_events"))


def modal_length(panel: DataFrame, balanced_above: float = 0.8) -> DataFrame:
    """Most common panel length (the shorter on a tie) and the share of loans at it."""
    counts = observation_counts(panel).withColumn("total", small_total("loans"))
    mode = counts.orderBy(F.desc("loans"), "obs").limit(1)
    share = F.col("loans") / F.col("total")
    return mode.select(
        F.col("obs").alias("modal_length"), F.col("loans").alias("modal_loans"),
        (share * 100).alias("modal_pct"),
        F.when(share > balanced_above, "Strongly Balanced").otherwise("Unbalanced")
        .alias("panel_type"))


def delinquency_rates(panel: DataFrame) -> DataFrame:
    """Share of delinquent loan-months and of ever-delinquent loans, in percent."""
    loans = panel.groupBy("LOAN_ID").agg(
        F.sum("any_delinquent").alias("d"), F.count("any_delinquent").alias("n"),
        F.max("any_delinquent").alias("ever"))
    return loans.agg((F.sum("d") / F.sum("n") * 100).alias("overall_pct"),
                     (F.avg("ever") * 100).alias("ever_pct"))


def missing_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Percentage of nulls for every column that has any, from one scan."""
    cols = list(cols or df.columns)
    row = df.agg(*[(F.count_if(F.col(c).isNull()) / F.count("*") * 100).alias(c) for c in cols])
    return row.unpivot([], cols, "column", "missing_pct").where("missing_pct > 0")


def key_insights(panel: DataFrame) -> DataFrame:
    """One row: panel size and span, delinquency, score drift and volatility, factor count."""
    loans = panel.groupBy("LOAN_ID").agg(
        F.count("*").alias("obs"), F.count("time").alias("times"), F.min("time").alias("t0"),
        F.max("time").alias("t1"), F.sum("any_delinquent").alias("d"),
        F.count("any_delinquent").alias("n"), F.max("any_delinquent").alias("ever"),
        F.sum("credit_score_change").alias("cs"), F.count("credit_score_change").alias("cn"),
        F.stddev_samp("credit_score_change").alias("csd"))
    factors = sum("_PC1" in c for c in panel.columns)
    return loans.agg(
        F.count("*").alias("loans"), F.sum("obs").alias("observations"),
        F.avg("obs").alias("avg_observations"), F.min("times").alias("min_length"),
        F.max("times").alias("max_length"), F.min("t0").alias("min_time"),
        F.max("t1").alias("max_time"), (F.sum("d") / F.sum("n") * 100).alias("overall_dlq_pct"),
        (F.avg("ever") * 100).alias("ever_dlq_pct"),
        (F.sum("cs") / F.sum("cn")).alias("avg_credit_change"),
        F.avg("csd").alias("credit_volatility"), F.lit(factors).alias("economic_factors"))
