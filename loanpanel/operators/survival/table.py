"""Loan-level survival data, risk table and cumulative hazard."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanpanel.functions.dates import month_of_act_period
from loanpanel.functions.stats import running_sum

Z95 = 1.959963984540054  # two-sided 95% normal quantile


def survival_table(panel: DataFrame, covariates: Sequence[str] = ()) -> DataFrame:
    """One row per loan: first event or censoring time, event flag, covariates at that row.

    With ``act_period`` in the panel, ``macro_quarter`` is the start of that row's quarter.
    """
    is_event = F.coalesce(F.col("event"), F.lit(0)) == 1
    row = [F.col("time").alias("survival_time"), *[F.col(c) for c in covariates]]
    dated = "act_period" in panel.columns
    if dated:
        row.append(F.col("act_period").alias("macro_quarter"))
    # the first event row, without an event the last row; the later quarter is the later row
    seen = F.struct("time", "data_quarter")
    out = (panel.groupBy("LOAN_ID")
           .agg(F.max("event").alias("survival_event"),
                F.min_by(F.struct(*row), F.when(is_event, seen)).alias("first_event"),
                F.max_by(F.struct(*row), seen).alias("last"))
           .select("LOAN_ID", "survival_event", F.coalesce("first_event", "last").alias("r"))
           .select("LOAN_ID", "survival_event", "r.*"))
    # read after the choice, one month per loan
    return out.withColumn("macro_quarter", F.trunc(month_of_act_period(F.col("macro_quarter")), "quarter")) if dated else out


def survival_summary(df: DataFrame, event: str = "survival_event",
                     duration: str = "survival_time") -> DataFrame:
    return df.agg(F.count("*").alias("rows"), F.avg(event).alias("event_rate"),
                  F.min(duration).alias("min_duration"), F.max(duration).alias("max_duration"))


def risk_table(df: DataFrame, event: str = "survival_event",
               duration: str = "survival_time") -> DataFrame:
    """``(time, at_risk, events, censored)``: the rows are aggregated by time first."""
    cells = df.groupBy(F.col(duration).alias("time")).agg(
        F.count("*").alias("at_risk"), F.sum(event).alias("events"))
    cells = cells.withColumn("censored", F.col("at_risk") - F.col("events"))
    return running_sum(cells, "time", ["at_risk"], descending=True)


def _tied_sums(n: Column, d: Column) -> tuple[Column, Column]:
    """Sums of 1/k and 1/k^2 for k = n-d+1 .. n without listing d terms.

    Terms up to 100 are added one by one, the rest by the Euler-Maclaurin series, whose
    first omitted term is below 1e-14 there.
    """
    small = F.when((d > 0) & (n - d < 100), F.sequence(n - d + 1, F.least(n, F.lit(100))))
    first = F.coalesce(F.aggregate(small, F.lit(0.0), lambda s, k: s + F.lit(1.0) / k), F.lit(0.0))
    second = F.coalesce(F.aggregate(small, F.lit(0.0), lambda s, k: s + F.lit(1.0) / (k * k)), F.lit(0.0))
    m, x = F.greatest(n - d, F.lit(100)).cast("double"), n.cast("double")
    tail1 = (F.log(x / m) + (1 / x - 1 / m) / 2 - (1 / (x * x) - 1 / (m * m)) / 12
             + (F.pow(x, F.lit(-4.0)) - F.pow(m, F.lit(-4.0))) / 120)
    tail2 = ((1 / m - 1 / x) + (1 / (x * x) - 1 / (m * m)) / 2
             - (F.pow(x, F.lit(-3.0)) - F.pow(m, F.lit(-3.0))) / 6
             + (F.pow(x, F.lit(-5.0)) - F.pow(m, F.lit(-5.0))) / 30)
    far = (d > 0) & (n > 100)
    return (first + F.when(far, tail1).otherwise(0.0), second + F.when(far, tail2).otherwise(0.0))


def nelson_aalen(risk: DataFrame, tie_corrected: bool = True) -> DataFrame:
    """Cumulative hazard with 95% limits from a :func:`risk_table`.

    Tied events count as if they came one after another (``1/n + 1/(n-1) + ...``); with
    ``tie_corrected=False`` the increment is ``d/n``.  Limits use the log transform.
    """
    n, d = F.col("at_risk"), F.col("events")
    if tie_corrected:
        step, var = _tied_sums(n, d)
    else:
        step, var = d / n, (n - d) * d / F.pow(n, F.lit(3.0))
    cum = running_sum(risk.select("time", "at_risk", "events", step.alias("cum_hazard"), var.alias("v")),
                      "time", ["cum_hazard", "v"])
    h = F.col("cum_hazard")
    width = Z95 * F.try_divide(F.sqrt("v"), h)
    return cum.select("time", "at_risk", "events", "cum_hazard",
                      F.coalesce(h * F.exp(-width), F.lit(0.0)).alias("ci_lower"),
                      F.coalesce(h * F.exp(width), F.lit(0.0)).alias("ci_upper"))
