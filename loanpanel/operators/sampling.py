"""Loan-level stratified sampling with exact counts and reproducible draws."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanpanel.functions import codes
from loanpanel.functions.stats import (attach_group_row, breaks_below, describe, quantiles,
                                       small_total)
from loanpanel.operators.panel import _distinct
from loanpanel.session import cut

STRATA = ["orig_year", "credit_tier", "ltv_tier", "ever_defaults", "geo_tier"]


def loan_characteristics(panel: DataFrame, quarters: Sequence[str] | None = None) -> DataFrame:
    """One row per loan active in ``quarters``: first-seen attributes and any default."""
    if quarters is not None:
        panel = panel.where(F.col("data_quarter").isin(list(quarters)))
    first = F.struct("ORIG_DATE", "data_quarter", "CSCORE_B", "OLTV", "STATE", "PURPOSE")
    seen = F.struct("time", "data_quarter")
    return (panel.groupBy("LOAN_ID")
            .agg(F.min_by(first, seen).alias("f"), F.max("event").alias("ever_defaults"))
            .select("LOAN_ID", F.col("f.ORIG_DATE").alias("actual_orig_date"),
                    F.col("f.data_quarter").alias("first_observed"),
                    F.col("f.CSCORE_B").alias("credit_score"), F.col("f.OLTV").alias("ltv"),
                    F.col("f.STATE").alias("state"), F.col("f.PURPOSE").alias("loan_purpose"),
                    "ever_defaults"))


def add_strata(loans: DataFrame) -> DataFrame:
    return loans.withColumns({
        "orig_year": F.year("actual_orig_date"),
        "credit_tier": codes.credit_tier(F.col("credit_score")),
        "ltv_tier": codes.ltv_tier(F.col("ltv")),
        "geo_tier": codes.geo_tier(F.col("state")),
    })


Quota = Callable[[DataFrame], DataFrame]  # adds ``quota`` to rows (stratum, size)


def _share(target: int) -> Column:
    """At least one per stratum, at most all of it, else its share of ``target`` rounded down."""
    return F.least(F.greatest(F.floor(target * F.col("size") / small_total("size")), F.lit(1)), F.col("size"))


def proportional_quota(target: int) -> Quota:
    return lambda sizes: sizes.withColumn("quota", _share(target))


def exact_quota(target: int) -> Quota:
    """The proportional quota, with what rounding leaves given to the largest fractions.

    Everything when there are no more than ``target`` rows.  Ties go by stratum name.
    """
    def quota(sizes: DataFrame) -> DataFrame:
        share = target * F.col("size") / small_total("size")
        rows = sizes.withColumns({"total": small_total("size"), "low": _share(target),
                                  "fraction": share - F.floor(share)})
        # a stratum raised to one has had its share
        place = F.row_number().over(Window.orderBy(F.col("share_below_one"), F.desc("fraction"), "stratum"))
        rows = (rows.withColumn("share_below_one", share < 1).withColumn("place", place)
                .withColumn("left", F.lit(target) - small_total("low")))
        more = F.least(F.col("low") + (F.col("place") <= F.col("left")).cast("int"), F.col("size"))
        return rows.select("stratum", "size", F.when(F.col("total") <= target, F.col("size")).otherwise(more).alias("quota"))
    return quota


def strata_targets(loans: DataFrame, target: int, strata: Sequence[str] = STRATA) -> DataFrame:
    """Size, share and sample size of every stratum."""
    sizes = loans.groupBy(*strata).agg(F.count("*").alias("size"))
    return sizes.select(*strata, "size", (F.col("size") / small_total("size")).alias("share"),
                        _share(target).alias("target"))


def stratified_ids(loans: DataFrame, strata: Sequence[str], quota: Quota, seed: int = 42,
                   key: str = "LOAN_ID") -> DataFrame:
    """Exactly ``quota`` keys per stratum, those with the smallest seeded hash.

    The keys are written once.  A stratum may hold most of them, so it is never ordered as one
    group: keys are counted per (stratum, hash prefix), whole prefixes below the quota are
    taken, and only the prefix that crosses it is ranked.
    """
    name = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in strata])
    draws = cut(loans.select(key, name.alias("stratum"),
                             F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))).alias("h"))
                .withColumn("prefix", F.substring("h", 1, 3)))
    cells = draws.groupBy("stratum", "prefix").agg(F.count("*").alias("n"))
    sizes = quota(cells.groupBy("stratum").agg(F.sum("n").alias("size"))).select("stratum", "quota")
    by_prefix = Window.partitionBy("stratum").orderBy("prefix")  # at most 4096 rows each
    plan = (cells.withColumn("upto", F.sum("n").over(by_prefix)).join(sizes, "stratum")
            .withColumn("take", F.col("quota") - F.col("upto") + F.col("n")).where("take > 0")
            .select("stratum", "prefix", "n", "take"))
    whole = draws.join(plan.where("take >= n"), ["stratum", "prefix"]).select(key)
    rank = F.row_number().over(Window.partitionBy("stratum", "prefix").orderBy("h", key))
    part = (draws.join(plan.where("take < n"), ["stratum", "prefix"])
            .withColumn("rank", rank).where(F.col("rank") <= F.col("take")).select(key))
    return whole.unionByName(part)


def stratified_sample(panel: DataFrame, target: int = 150_000, seed: int = 42,
                      quarters: Sequence[str] | None = None) -> DataFrame:
    """Loan ids sampled in proportion to their strata."""
    loans = add_strata(loan_characteristics(panel, quarters))
    return stratified_ids(loans, STRATA, proportional_quota(target), seed)


def full_history(panel: DataFrame, ids: DataFrame) -> DataFrame:
    """Every row of the sampled loans."""
    return panel.join(ids, "LOAN_ID", "left_semi")


def loan_info(panel: DataFrame) -> DataFrame:
    return panel.groupBy("LOAN_ID").agg(
        F.max("event").alias("max_event"),
        F.max("any_delinquent").alias("ever_delinquent"),
        F.count("data_quarter").alias("n_observations"),
        F.min("data_quarter").alias("first_quarter"),
        F.max("data_quarter").alias("last_quarter"),
        F.min("time").alias("min_time"), F.max("time").alias("max_time"))


def balanced_sample(panel: DataFrame, target: int = 75_000, seed: int = 42) -> DataFrame:
    """Loan ids with the population's share of ever-delinquent loans.

    Loans whose status is never known belong to neither stratum, but count in the share.
    """
    loans = panel.groupBy("LOAN_ID").agg(F.max("any_delinquent").alias("ever_delinquent"))

    def quota(sizes: DataFrame) -> DataFrame:
        is_ever = F.col("stratum") == "1"
        ever_size = small_total(F.when(is_ever, F.col("size")).otherwise(0))
        ever = F.least(F.floor(target * ever_size / small_total("size")), ever_size)
        return sizes.withColumn("quota", F.when(is_ever, ever).when(
            F.col("stratum") == "0", F.least(F.lit(target) - ever, F.col("size"))).otherwise(0))

    return stratified_ids(loans, ["ever_delinquent"], quota, seed)


def smart_sample(df: DataFrame, target: int = 500_000, event: str = "survival_event",
                 duration: str = "survival_time", key: str = "LOAN_ID",
                 seed: int = 42) -> DataFrame:
    """``target`` rows stratified by event and duration quartile; all rows when there are few enough.

    Equal quartile breaks are merged; a row without a duration is in a group of its own.
    ``key`` identifies a row.
    """
    breaks = quantiles(df, [duration], [0.25, 0.5, 0.75])
    cuts = breaks.agg(F.sort_array(F.collect_list("quantile")).alias("__cut"))
    rows = attach_group_row(df.select(key, event, duration), cuts, [])
    quartile = F.when(F.col(duration).isNotNull(), breaks_below(F.col(duration), F.col("__cut"), 3))
    ids = stratified_ids(rows.withColumn("__q", quartile), [event, "__q"], exact_quota(target), seed, key)
    return df.join(ids, key, "left_semi")


# --- checks on a sample ----------------------------------------------------

def loan_default_rate(panel: DataFrame) -> DataFrame:
    loans = panel.groupBy("LOAN_ID").agg(F.max("event").alias("event"))
    return loans.agg(F.count("*").alias("loans"), F.count_if(F.col("event") == 1).alias("defaulted"),
                     (F.count_if(F.col("event") == 1) / F.count("*")).alias("default_rate"))


def origination_years(panel: DataFrame) -> DataFrame:
    first = F.min_by("ORIG_DATE", F.struct("time", "data_quarter"))
    return (panel.groupBy("LOAN_ID").agg(first.alias("d"))
            .groupBy(F.year("d").alias("orig_year")).agg(F.count("*").alias("count"))
            .orderBy("orig_year"))


def describe_credit(panel: DataFrame, column: str = "CSCORE_B") -> DataFrame:
    """Distribution of the first-seen credit score over loans."""
    first = F.min_by(column, F.struct("time", "data_quarter")).alias(column)
    return describe(panel.groupBy("LOAN_ID").agg(first), [column])


def coverage(panel: DataFrame) -> DataFrame:
    """States and quarters in the panel, counted over their distinct pairs."""
    pairs = panel.select("STATE", "data_quarter").distinct()
    return pairs.agg(_distinct("STATE").alias("states"),
                     _distinct("data_quarter").alias("quarters"),
                     F.min("data_quarter").alias("first_quarter"),
                     F.max("data_quarter").alias("last_quarter"))


def sample_quality(original: DataFrame, sample: DataFrame, event: str = "survival_event") -> DataFrame:
    """Event rate before and after sampling and their absolute difference."""
    kept = sample.agg(F.avg(event)).scalar()
    return (original.agg(F.avg(event).alias("original_rate"))
            .select("original_rate", kept.alias("sample_rate"),
                    F.abs(F.col("original_rate") - kept).alias("difference")))
