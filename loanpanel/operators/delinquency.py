"""Delinquency over time, first delinquency, transitions, gaps and exits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from loanpanel.functions.stats import histogram, quantiles, running_sum, small_total
from loanpanel.operators.loan_bitmaps import sums_and_loans


def _by_loan() -> WindowSpec:
    """A loan's rows by age.

    (LOAN_ID, time) is unique within a quarter after deduplication, so the window is bounded
    by the loan's age in months times the quarters that report it.
    """
    return Window.partitionBy("LOAN_ID").orderBy("time", "data_quarter")


def quarterly_delinquency(panel: DataFrame) -> DataFrame:
    """Delinquency rates and active loans by quarter; loans are counted by bitmaps where they are numbered."""
    flags = ["any_delinquent", "serious_delinquent"]
    quarters = sums_and_loans(panel, ["data_quarter"], {
        **{c: F.col(c) for c in flags}, **{f"n_{c}": F.col(c).isNotNull().cast("int") for c in flags}}, "active_loans")
    rates = [F.try_divide(c, f"n_{c}").alias(f"{c}_rate") for c in flags]
    return quarters.select("data_quarter", *rates, "active_loans").orderBy("data_quarter")


def first_delinquency(panel: DataFrame) -> DataFrame:
    """Age at the first delinquency of every ever-delinquent loan."""
    return (panel.where("any_delinquent = 1").groupBy("LOAN_ID")
            .agg(F.min("time").alias("first_dlq_time")))


def first_delinquency_histogram(panel: DataFrame, bins: int = 30) -> DataFrame:
    """Histogram of the age at first delinquency, with the median on every row."""
    first = first_delinquency(panel)
    median = quantiles(first, ["first_dlq_time"], [0.5]).agg(F.max("quantile")).scalar()
    return histogram(first, "first_dlq_time", bins).withColumn("median", median)


def naive_survival(panel: DataFrame, step: int = 2) -> DataFrame:
    """``1 - loans delinquent by t / loans seen by t`` at t = 0, step, 2*step, ...

    Each loan enters once with its first age and its first delinquent age, so the panel is
    aggregated a single time instead of being filtered per time point.
    """
    loans = panel.groupBy("LOAN_ID").agg(
        F.min("time").alias("seen"), F.min(F.when(F.col("any_delinquent") == 1, F.col("time"))).alias("dlq"),
        F.max("time").alias("last"))
    cells = loans.groupBy("seen", "dlq").agg(F.count("*").alias("n"), F.max("last").alias("last"))

    def point(c):
        return (F.ceil(F.greatest(F.col(c), F.lit(0)) / step) * step).cast("long")

    seen = cells.select(point("seen").alias("time"), F.col("n").alias("seen"), F.lit(0).alias("dlq"))
    dlq = (cells.where("dlq IS NOT NULL")
           .select(point("dlq").alias("time"), F.lit(0).alias("seen"), F.col("n").alias("dlq")))
    spine = (cells.agg(F.floor(F.max("last")).alias("last"))
             .select(F.explode(F.sequence(F.lit(0), F.col("last"), F.lit(step))).alias("time"),
                     F.col("last"), F.lit(0).alias("seen"), F.lit(0).alias("dlq")))
    points = (seen.unionByName(dlq).unionByName(spine.drop("last"))
              .groupBy("time").agg(F.sum("seen").alias("seen"), F.sum("dlq").alias("dlq")))
    last = cells.agg(F.floor(F.max("last"))).scalar()
    totals = running_sum(points, "time", ["seen", "dlq"]).where(F.col("time") <= last)
    rate = F.coalesce(1 - F.try_divide(F.col("dlq"), F.col("seen")), F.lit(1.0))
    return totals.select("time", F.col("seen").alias("loans_seen"),
                         F.col("dlq").alias("loans_delinquent"),
                         rate.alias("survival")).orderBy("time")


def transition_matrix(panel: DataFrame) -> DataFrame:
    """Counts and row percentages of moves between delinquency states."""
    moves = (panel.select("LOAN_ID", "any_delinquent",
                          F.lag("any_delinquent").over(_by_loan()).alias("dlq_lag"))
             .where("dlq_lag IS NOT NULL")
             .groupBy("dlq_lag", "any_delinquent").agg(F.count("*").alias("count")))
    total = F.sum("count").over(Window.partitionBy("dlq_lag"))
    return (moves.withColumn("total_from_state", total)
            .withColumn("transition_pct", F.col("count") / F.col("total_from_state") * 100))


def gaps(panel: DataFrame) -> DataFrame:
    """Rows that do not follow the loan's previous row by exactly one month."""
    gap = (F.col("time") - F.lag("time").over(_by_loan())).alias("time_gap")
    return panel.select("LOAN_ID", "time", gap).where("time_gap <> 1")


def gap_summary(panel: DataFrame) -> DataFrame:
    return gaps(panel).agg(F.count("*").alias("gaps"),
                           F.count_distinct("LOAN_ID").alias("loans_with_gaps"),
                           F.avg("time_gap").alias("avg_gap"), F.max("time_gap").alias("max_gap"))


def loan_exits(panel: DataFrame) -> DataFrame:
    """Last age, status and event of every loan."""
    last = F.max_by(F.struct("any_delinquent", "event"), F.struct("time", "data_quarter"))
    return (panel.groupBy("LOAN_ID").agg(F.max("time").alias("last_observed_time"), last.alias("z"))
            .select("LOAN_ID", "last_observed_time", F.col("z.any_delinquent").alias("final_status"),
                    F.col("z.event").alias("final_event")))


def exit_analysis(panel: DataFrame, early_below: float = 0.9) -> DataFrame:
    """Early exits by final status: loans last seen before ``early_below`` of the longest age."""
    cells = (loan_exits(panel).groupBy("last_observed_time", "final_status")
             .agg(F.count("*").alias("n")))
    # one row per last age and status
    longest = F.max("last_observed_time").over(Window.partitionBy())
    early = F.col("last_observed_time") < F.col("longest") * early_below
    return (cells.withColumn("longest", longest).withColumn("total", small_total("n")).where(early)
            .groupBy("final_status")
            .agg(F.sum("n").alias("early_exits"),
                 (F.sum("n") / F.max("total") * 100).alias("pct_of_loans")))


def means_by(panel: DataFrame, keys: Sequence[str], cols: dict[str, str]) -> DataFrame:
    """Mean of several columns by a low-cardinality key, sorted by it."""
    aggs = [F.avg(c).alias(name) for name, c in cols.items()]
    return panel.groupBy(*keys).agg(*aggs).orderBy(*keys)


def by_age(panel: DataFrame) -> DataFrame:
    """Delinquency rate and mean score, balance and rate change by loan age."""
    return means_by(panel, ["time"], {
        "dlq_rate": "any_delinquent", "avg_credit_change": "credit_score_change",
        "avg_balance_ratio": "balance_ratio", "avg_rate_change": "rate_change"})


def balance_by_age_and_status(panel: DataFrame) -> DataFrame:
    return means_by(panel, ["time", "any_delinquent"], {"avg_balance_ratio": "balance_ratio"})
