"""Model comparison and likelihood-ratio test."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanpanel.operators.survival.cox import CoxModel


def model_row(name: str, model: CoxModel, c_index: float) -> tuple:
    return (name, len(model.beta), model.rows, model.events, c_index, model.aic_partial,
            model.log_likelihood - model.penalty)


def metrics_table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """One row per model; build the rows with :func:`model_row`."""
    return spark.createDataFrame(
        rows, "model string, features int, observations long, events long, c_index double, "
              "partial_aic double, log_likelihood double")


def compare(table: DataFrame, base: str, full: str) -> DataFrame:
    """Gains of ``full`` over ``base`` with verdicts and the likelihood-ratio test."""
    pick = {m: F.struct(*[F.max(F.when(F.col("model") == name, F.col(c))).alias(c)
                          for c in ("features", "c_index", "partial_aic", "log_likelihood")]).alias(m)
            for m, name in (("a", base), ("b", full))}
    row = table.agg(*pick.values())
    dc = F.col("b.c_index") - F.col("a.c_index")
    da = F.col("a.partial_aic") - F.col("b.partial_aic")
    df = F.col("b.features") - F.col("a.features")
    lr = 2 * (F.col("b.log_likelihood") - F.col("a.log_likelihood"))
    out = row.select(
        dc.alias("c_index_gain"), da.alias("aic_gain"),
        F.when(dc > 0.01, "MEANINGFUL").when(dc > 0.005, "MODEST").otherwise("MINIMAL").alias("c_index_verdict"),
        F.when(da > 2, "SUBSTANTIAL").when(da > 0, "MINOR").otherwise("NOT JUSTIFIED").alias("aic_verdict"),
        F.when(df > 0, lr).alias("lr_statistic"), F.when(df > 0, df).alias("lr_df"))
    (stat, k), = out.select("lr_statistic", "lr_df").collect()
    p = chi2_tail(stat, k) if k else None
    return (out.withColumn("p_value", F.lit(p).cast("double"))
            .withColumn("significant", F.col("p_value") < 0.05))


def chi2_tail(x: float, df: int) -> float:
    """P(chi-square with ``df`` degrees of freedom > x), by the recurrence in half steps."""
    if x <= 0:
        return 1.0
    half = x / 2
    a, tail = (0.5, math.erfc(math.sqrt(half))) if df % 2 else (1.0, math.exp(-half))
    while a < df / 2:
        tail += math.exp(a * math.log(half) - half - math.lgamma(a + 1))
        a += 1
    return min(1.0, tail)
