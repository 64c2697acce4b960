"""Exact concordance index without forming pairs."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanpanel.functions.stats import running_sum

CELLS_PER_RANGE = 50_000  # cells that one task counts in memory
LEAST_LEVELS = 3


def concordance(df: DataFrame, risk: str, event: str = "survival_event",
                duration: str = "survival_time", by: Sequence[str] = ()) -> DataFrame:
    """One row ``(by..., concordant, tied, pairs, c_index, left_out)``; a higher ``risk`` should fail sooner.

    With ``by``, a few groups, pairs are formed within each and there is a row for each; all groups
    share the jobs and the ranges below. Rows of a null group count nowhere.

    A pair is comparable when one member has the event and the other is later, or equally
    late and censored.  Rows without risk, event or duration are counted in ``left_out``.

    Rows are counted per (risk, time, event) cell, cells are dealt to at most 2^k ranges of risk.
    Pairs of different ranges part at one of the k levels of halving: there, events of upper
    halves meet the later rows of lower halves by running sums over time.  A risk with more cells
    than a range should hold is a range of its own; its pairs are all tied and come from running
    sums over time as well.  Pairs within the other ranges come from a sorted count, so no task
    holds all rows or times, however few the risks.  Counts are doubles, so above 2^53 they are
    rounded.
    """
    risk, t, e = F.col(risk).cast("double"), F.col(duration).cast("double"), F.col(event).cast("int")
    known = risk.isNotNull() & t.isNotNull() & e.isNotNull()
    cells = ((df.dropna(subset=list(by)) if by else df)
             .select(*by, *[F.when(known, c).alias(name) for c, name in ((risk, "risk"), (t, "t"), (e, "e"))])
             .groupBy(*by, "risk", "t", "e").agg(F.count("*").alias("n")).persist())
    totals = None
    try:
        splits, levels, left_out = _ranges(cells, by)
        placed = (Bucketizer(splits=splits, inputCol="risk", outputCol="range")
                  .transform(cells.where("risk IS NOT NULL")).withColumn("range", F.col("range").cast("int")))
        # ranges of one risk: [c, the next double)
        alone = F.col("range").isin([i for i, (a, b) in enumerate(zip(splits, splits[1:])) if b == np.nextafter(a, np.inf)])
        # kept for its six uses below, which would count the cells again each
        totals = (placed.groupBy(*by, "range", "t")
                  .agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("e")).alias("d")).persist())
        every = totals.groupBy(*by, "t").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
        none = F.lit(None).cast("double")
        schema = "".join(f"`{c}` {t}, " for c, t in df.select(*by).dtypes)

        def within(pdf: pd.DataFrame) -> pd.DataFrame:
            counts = _within(pdf)
            for i, c in enumerate(by):
                counts.insert(i, c, pdf[c].iloc[0])
            return counts

        sums = (_across(totals, levels, by).select(*by, F.col("value").alias("concordant"), none.alias("tied"), none.alias("pairs"))
                .union(_later_pairs(every, by).select(*by, none, none, "value"))
                .union(_later_pairs(totals.where(alone), by, ["range"]).select(*by, none, "value", none))
                .union(placed.where(~alone).groupBy(*by, "range").applyInPandas(within, schema + "concordant double, tied double")
                       .select(*by, "concordant", "tied", none)))
        found = {tuple(x[:len(by)]): [v or 0.0 for v in x[len(by):]] for x in sums.groupBy(*by).agg(
            F.sum("concordant"), F.sum("tied"), F.sum("pairs")).collect()}
    finally:
        cells.unpersist()
        if totals is not None:
            totals.unpersist()
    rows = []
    for group, out in (left_out if by else {(): left_out}).items():
        concordant, tied, pairs = found.get(group, (0.0, 0.0, 0.0))
        rows.append((*group, concordant, tied, pairs, (concordant + 0.5 * tied) / pairs if pairs else None, out))
    return df.sparkSession.createDataFrame(
        rows, schema + "concordant double, tied double, pairs double, c_index double, left_out long")


def _ranges(cells: DataFrame, by: Sequence[str] = ()) -> tuple[list[float], int, int | dict[tuple, int]]:
    """Splits of the risks, the levels of halving they need, and the rows without a value (by group).

    A value that is two cuts or more has more cells than a range should: it is cut off on both sides.
    The splits of all groups are taken together, so none has more cells in a range than alone.
    """
    def cuts(levels: int) -> Column:
        probs = [i / 2**levels for i in range(1, 2**levels)]
        return F.percentile_approx("risk", probs, 10 * 2**levels)

    most = 8  # levels that the first look covers
    looks = cells.groupBy(*by).agg(F.count("risk").alias("count"), F.sum(F.when(F.col("risk").isNull(), F.col("n"))).alias("out"),
                                   cuts(most).alias("cuts")).collect()
    left_out = {tuple(x[:len(by)]): x["out"] or 0 for x in looks}
    levels = max(LEAST_LEVELS, (-(-max((x["count"] for x in looks), default=0) // CELLS_PER_RANGE) - 1).bit_length())
    found = [x["cuts"] for x in looks]
    if levels > most:
        found = [x["cuts"] for x in cells.groupBy(*by).agg(cuts(levels).alias("cuts")).collect()]
    else:
        step = 2 ** (most - levels)
        found = [x and x[step - 1::step] for x in found]
    found = [[c for c in x or [] if np.isfinite(c)] for x in found]
    inner = set()
    for x in found:
        inner |= set(x) | {float(np.nextafter(c, np.inf)) for c in x if x.count(c) > 1}
    levels = max(levels, (len(inner) - 1).bit_length()) if by else levels  # as many halvings as all splits need
    return [-float("inf"), *sorted(inner), float("inf")], levels, left_out if by else left_out[()]


def _later_pairs(totals: DataFrame, by: Sequence[str] = (), apart: Sequence[str] = ()) -> DataFrame:
    """By group, comparable pairs of (by, apart, t, n, d): events times the rows later, or as late and censored."""
    sums = running_sum(totals.withColumn("later", F.col("n")), "t", ["later"], descending=True, by=[*by, *apart])
    return sums.groupBy(*by).agg(_product_sum(F.col("d"), F.col("later") - F.col("d")).alias("value"))


def _product_sum(a: Column, b: Column) -> Column:
    """Sum of products of counts, exact before the last step."""
    whole = "decimal(19,0)"
    return F.sum(a.cast(whole) * b.cast(whole)).cast("double")


def _across(totals: DataFrame, levels: int, by: Sequence[str] = ()) -> DataFrame:
    """By group, concordant pairs whose members lie in different ranges, from (by, range, t, n, d)."""
    level = F.explode(F.sequence(F.lit(0), F.lit(levels)))  # the last half may hold one range more
    halves = totals.withColumn("level", level).select(
        *by, "level", F.expr("shiftright(range, level + 1)").alias("half"), "t",
        F.expr("shiftright(range, level) % 2 = 1").alias("upper"), "n", "d")
    cells = halves.groupBy(*by, "level", "half", "t").agg(
        F.sum(F.when(~F.col("upper"), F.col("n")).otherwise(0)).alias("later"),
        F.sum(F.when(~F.col("upper"), F.col("d")).otherwise(0)).alias("lower_d"),
        F.sum(F.when(F.col("upper"), F.col("d")).otherwise(0)).alias("upper_d"))
    sums = running_sum(cells, "t", ["later"], descending=True, by=[*by, "level", "half"])
    return sums.groupBy(*by).agg(_product_sum(F.col("upper_d"), F.col("later") - F.col("lower_d")).alias("value"))


def c_index(df: DataFrame, risk: str, event: str = "survival_event",
            duration: str = "survival_time") -> float:
    return concordance(df, risk, event, duration).first()["c_index"]


def _rank(t: np.ndarray, e: np.ndarray) -> np.ndarray:
    _, i = np.unique(t, return_inverse=True)
    return 2 * i + (1 - e)


def _within(pdf: pd.DataFrame) -> pd.DataFrame:
    """Concordant and tied pairs inside one risk range.

    A pair with ranks a < b splits at the highest bit where they differ; per bit level one
    running sum over rows sorted by risk counts all such pairs.
    """
    rank = _rank(pdf["t"].to_numpy(), pdf["e"].to_numpy())
    risk, n = pdf["risk"].to_numpy(), pdf["n"].to_numpy(dtype=float)
    order = np.argsort(risk, kind="stable")
    rank, risk, n = rank[order], risk[order], n[order]
    event = rank % 2 == 0
    concordant = tied = 0.0
    for bit in range(int(rank.max()).bit_length()):
        group = np.argsort(rank >> (bit + 1), kind="stable")  # keeps the risk order inside
        prefix, s = rank[group] >> (bit + 1), risk[group]
        high = (rank[group] >> bit) & 1 == 1
        weight = np.where(high, n[group], 0.0)
        upto = np.concatenate([[0.0], np.cumsum(weight)])
        new_prefix = np.r_[True, prefix[1:] != prefix[:-1]]
        new_risk = new_prefix | np.r_[True, s[1:] != s[:-1]]
        at = np.arange(len(s))
        start = np.maximum.accumulate(np.where(new_prefix, at, 0))
        first = np.maximum.accumulate(np.where(new_risk, at, 0))
        last = np.r_[at[1:][new_risk[1:]], len(s)][np.cumsum(new_risk) - 1]
        mine = np.where(event[group] & ~high, n[group], 0.0)
        concordant += float((mine * (upto[first] - upto[start])).sum())
        tied += float((mine * (upto[last] - upto[first])).sum())
    return pd.DataFrame({"concordant": [concordant], "tied": [tied]})
