"""Macro series: monthly wide table, per-domain components, join to the panel."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loanpanel import schemas as S
from loanpanel.functions.dates import act_period
from loanpanel.session import cut


def valid_observations(obs: DataFrame) -> DataFrame:
    """``(series_id, date, value)`` text rows -> typed rows; '.', null and bad text dropped.

    Dates of four-digit years may come typed; they are not written out and read again.
    """
    day = F.col("date")
    if dict(obs.dtypes)["date"] == "date":
        day = F.when(F.year(day).between(1, 9999), day)
    else:
        day = F.try_to_date(day.cast("string"), "yyyy-MM-dd")
    return (obs.select("series_id", day.alias("date"),
                       F.nullif(F.col("value"), F.lit(".")).try_cast("double").alias("value"))
            .where("date IS NOT NULL AND value IS NOT NULL")
            .withColumn("act_period", F.date_format("date", "MMyyyy")))


def monthly_average(obs: DataFrame) -> DataFrame:
    return (obs.groupBy("series_id", F.trunc("date", "month").alias("month"))
            .agg(F.avg("value").alias("value")))


def wide_by_month(monthly: DataFrame, series: Sequence[str]) -> DataFrame:
    """One row per month, one column per series: a pivot instead of a chain of outer joins."""
    return (monthly.groupBy("month").pivot("series_id", list(series)).agg(F.max("value"))
            .withColumn("act_period", F.date_format("month", "MMyyyy"))
            .select("month", "act_period", *series))


def fill_gaps(wide: DataFrame, series: Sequence[str]) -> DataFrame:
    """Long ``(month, act_period, series_id, value)`` with gaps filled forward, then backward."""
    long = wide.unpivot(["month", "act_period"], list(series), "series_id", "value")
    w = Window.partitionBy("series_id").orderBy("month")  # one row per month: bounded
    past = F.last("value", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first("value", True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return long.withColumn("value", F.coalesce(past, ahead))


def domain_check(filled: DataFrame, domains: Mapping[str, Sequence[str]] = S.MACRO_DOMAINS) -> DataFrame:
    """Per domain: series with data, nulls left after filling, and whether it can be used."""
    pairs = [F.struct(F.lit(d).alias("domain"), F.lit(s).alias("s"))
             for d, ss in domains.items() for s in ss]
    per_series = filled.groupBy("series_id").agg(
        F.count("value").alias("n"), F.count_if(F.col("value").isNull()).alias("nulls"))
    member = F.filter(F.array(*pairs), lambda p: p.s == F.col("series_id"))
    live = F.col("n") > 0
    return (per_series.select(F.explode(member).alias("m"), "n", "nulls")
            .groupBy(F.col("m.domain").alias("domain"))
            .agg(F.count_if(live).alias("series"),
                 F.coalesce(F.sum(F.when(live, F.col("nulls"))), F.lit(0)).alias("nulls_left"))
            .withColumn("usable", (F.col("series") >= 2) & (F.col("nulls_left") == 0)))


def scale_series(filled: DataFrame) -> DataFrame:
    """Z-scores per series with the population deviation (a constant series becomes 0)."""
    w = Window.partitionBy("series_id")
    sd = F.stddev_pop("value").over(w)
    z = (F.col("value") - F.avg("value").over(w)) / F.when(sd == 0, 1.0).otherwise(sd)
    return filled.withColumn("z", z)


def principal_components(wide: DataFrame, domains: Mapping[str, Sequence[str]] = S.MACRO_DOMAINS,
                         keep_single_above: float = 0.6) -> tuple[DataFrame, list[dict]]:
    """Monthly component scores per domain and their loadings.

    Returns ``(act_period, month, <domain>_PC1[, <domain>_PC2])`` and one dict per kept
    component.  The second component is dropped when the first explains more than
    ``keep_single_above``.  All domains are fitted from one aggregate over the months; only
    the covariance sums (at most a few hundred numbers) reach the driver.  The sign of a
    component makes its largest loading positive, the first of equal ones deciding.
    """
    names = [s for ss in domains.values() for s in ss]
    # one row per month, written once because the fit and the join both read it
    z = cut(scale_series(fill_gaps(wide, names)).groupBy("month", "act_period")
            .pivot("series_id", names).agg(F.max("z")))
    pairs = {d: list(combinations_with_replacement(ss, 2)) for d, ss in domains.items()}
    stats = z.agg(
        *[F.count(s).alias(f"n_{s}") for s in names], F.count("*").alias("months"),
        *[F.avg(F.col(a) * F.col(b)).alias(f"c_{a}_{b}") for ps in pairs.values() for a, b in ps],
    ).first()
    scores, loadings = [], []
    for domain, series in domains.items():
        live = [s for s in series if stats[f"n_{s}"] > 0]
        if len(live) < 2 or any(stats[f"n_{s}"] < stats["months"] for s in live):
            continue
        cov = np.array([[stats[f"c_{a}_{b}"] if (a, b) in pairs[domain] else stats[f"c_{b}_{a}"]
                         for b in live] for a in live])
        values, vectors = np.linalg.eigh(cov)
        share = values[::-1] / values.sum() if values.sum() > 0 else np.zeros(len(live))
        for i in range(1 if share[0] > keep_single_above else 2):
            v = vectors[:, -1 - i]
            lead = v[np.flatnonzero(np.abs(v) >= np.abs(v).max() * (1 - 1e-9))[0]]
            v = v if lead > 0 else -v
            name = f"{domain}_PC{i + 1}"
            scores.append(sum((F.col(s) * float(x) for s, x in zip(live, v)), F.lit(0.0)).alias(name))
            loadings += [{"component": name, "series_id": s, "loading": float(x),
                          "share": float(share[i])} for s, x in zip(live, v)]
    return z.select("act_period", "month", *scores), loadings


def add_act_period(panel: DataFrame, origination: str = "ORIG_DATE", time: str = "time") -> DataFrame:
    """Calendar month of each observation; text dates are parsed leniently."""
    orig = F.col(origination)
    if dict(panel.dtypes)[origination] == "string":
        orig = F.try_to_date(orig, "yyyy-MM-dd")
    return panel.withColumn("act_period", act_period(orig, F.col(time)))


def join_macro(panel: DataFrame, components: DataFrame) -> DataFrame:
    """Left join on the month.

    The monthly table has one row per month of a four-digit year, at most 119,988, so it is
    broadcast.
    """
    return panel.join(F.broadcast(components.drop("month")), "act_period", "left")
