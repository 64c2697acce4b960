"""Within-loan variation, cross-sectional views, correlations, descriptive tables."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loanpanel.functions.stats import correlation_pairs, describe, histogram
from loanpanel.session import cut

KEY_VARIABLES = ["credit_score_change", "balance_ratio", "rate_change"]
PANEL_VARIABLES = [*KEY_VARIABLES, "any_delinquent"]
ORIGINATION_VARIABLES = ["CSCORE_B", "DTI", "ORIG_RATE", "ORIG_UPB", "OLTV"]


def panel_length_histogram(panel: DataFrame, bins: int = 30) -> DataFrame:
    """Histogram of observations per loan with the mean length on every row."""
    per_loan = panel.groupBy("LOAN_ID").agg(F.count("*").alias("obs"))
    mean = per_loan.agg(F.avg("obs")).scalar()
    return histogram(per_loan, "obs", bins).withColumn("mean_obs", mean)


def within_loan_std(panel: DataFrame, cols: Sequence[str] = KEY_VARIABLES) -> DataFrame:
    """Sample deviation of each variable per loan (null for a single value)."""
    return panel.groupBy("LOAN_ID").agg(*[F.stddev_samp(c).alias(c) for c in cols])


def mean_within_std(panel: DataFrame, cols: Sequence[str] = KEY_VARIABLES) -> DataFrame:
    row = within_loan_std(panel, cols).agg(*[F.avg(c).alias(c) for c in cols])
    return row.unpivot([], list(cols), "variable", "mean_within_std")


def describe_within(panel: DataFrame, cols: Sequence[str] = PANEL_VARIABLES) -> DataFrame:
    return describe(within_loan_std(panel, cols), cols)


def describe_static(panel: DataFrame, cols: Sequence[str] = ORIGINATION_VARIABLES) -> DataFrame:
    """Distribution over loans of their first-seen origination values."""
    first = F.min_by(F.struct(*cols), F.struct("time", "data_quarter")).alias("f")
    return describe(panel.groupBy("LOAN_ID").agg(first).select("f.*"), cols)


def describe_varying(panel: DataFrame, cols: Sequence[str] = PANEL_VARIABLES) -> DataFrame:
    return describe(panel, cols)


def density_by_outcome(summary: DataFrame, value: str, bins: int = 30) -> DataFrame:
    """Density histogram of a loan-level value for never and ever delinquent loans."""
    known = summary.where(F.col("any_delinquent_max").isNotNull())
    return histogram(known, value, bins, ["any_delinquent_max"])


def delinquency_by_length(summary: DataFrame, bins: int = 10) -> DataFrame:
    """Delinquency rate by equal-width, right-closed bins of panel length (empty bin -> 0)."""
    cells = summary.groupBy("time_count").agg(
        F.sum("any_delinquent_max").alias("d"), F.count("any_delinquent_max").alias("n"),
        F.count("*").alias("loans"))
    edge = cells.agg(F.struct(F.min("time_count").alias("lo"), F.max("time_count").alias("hi"))).scalar()
    lo, hi = edge.getField("lo"), edge.getField("hi")
    place = F.greatest(F.ceil((F.col("time_count") - lo) * bins / (hi - lo)), F.lit(1))
    # one distinct length: it sits on the middle edge of the range widened around it
    spot = F.when(hi > lo, place).otherwise((bins + 1) // 2)
    rates = (cells.groupBy(spot.alias("bin"))
             .agg(F.sum("loans").alias("loans"), (F.sum("d") / F.sum("n") * 100).alias("rate")))
    spine = (cells.agg(F.min("time_count").alias("a"), F.max("time_count").alias("z"))
             .select("a", "z", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin")))
    step = (F.col("z") - F.col("a")) / bins
    return (spine.join(rates, "bin", "left")
            .select("bin", (F.col("a") + (F.col("bin") - 1) * step).alias("lo"),
                    (F.col("a") + F.col("bin") * step).alias("hi"),
                    F.coalesce("loans", F.lit(0)).alias("loans"),
                    F.coalesce("rate", F.lit(0.0)).alias("dlq_pct")))


def top_states(summary: DataFrame, top: int = 15) -> DataFrame:
    """States with the most loans, their delinquency rate and mean original balance."""
    return (summary.where("STATE IS NOT NULL").groupBy("STATE")
            .agg(F.count("any_delinquent_max").alias("loan_count"),
                 F.avg("any_delinquent_max").alias("dlq_rate"),
                 F.avg("ORIG_UPB").alias("avg_balance"))
            .orderBy(F.desc("loan_count"), "STATE").limit(top))


def overall_correlation(panel: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return correlation_pairs(panel, _analysis_columns(panel, cols))


def within_correlation(panel: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Correlation after subtracting each loan's mean of a variable, over rows that have both.

    Rows are reduced to sums per loan and those are added up, so no row waits for its loan's mean.
    Within a loan the co-moments are taken about the means of the rows that have both variables,
    and moved to the loan's own means; they are merged as such, which keeps their digits whatever
    the variables' size.
    """
    cols = _analysis_columns(panel, cols)
    pairs = list(combinations(cols, 2))
    sums = []
    for i, (a, b) in enumerate(pairs):
        sums += [F.regr_count(a, b).alias(f"n{i}"), F.regr_avgx(b, a).alias(f"a{i}"), F.regr_avgy(b, a).alias(f"b{i}"),
                 F.regr_sxx(b, a).alias(f"aa{i}"), F.regr_syy(b, a).alias(f"bb{i}"), F.regr_sxy(b, a).alias(f"ab{i}")]
    # rows are dealt by loan, since a loan's sums take more room than its rows
    loans = panel.select("LOAN_ID", *cols).repartition("LOAN_ID").groupBy("LOAN_ID").agg(*[F.avg(c).alias(f"mean_{c}") for c in cols], *sums)
    totals = []
    for i, (a, b) in enumerate(pairs):
        n, da, db = F.col(f"n{i}"), F.col(f"a{i}") - F.col(f"mean_{a}"), F.col(f"b{i}") - F.col(f"mean_{b}")
        for name, moment, moved in (("aa", f"aa{i}", n * da * da), ("bb", f"bb{i}", n * db * db), ("ab", f"ab{i}", n * da * db)):
            totals.append(F.sum(F.col(moment) + moved).alias(f"{name}{i}"))
        totals += [F.sum("n%d" % i).alias(f"n{i}"), F.sum(n * da).alias(f"da{i}"), F.sum(n * db).alias(f"db{i}")]
    row = loans.agg(*totals)
    cells = []
    for i, (a, b) in enumerate(pairs):
        n, sa, sb = F.col(f"n{i}"), F.col(f"da{i}"), F.col(f"db{i}")  # the centred values' sums, zero but for missing pairs
        aa, bb, ab = (F.col(f"{m}{i}") - F.try_divide(x, n) for m, x in (("aa", sa * sa), ("bb", sb * sb), ("ab", sa * sb)))
        corr = F.try_divide(ab, F.nullif(F.sqrt(aa * bb), F.lit(0.0)))
        cells.append(F.struct(F.lit(a).alias("var_a"), F.lit(b).alias("var_b"), corr.alias("corr")))
    return row.select(F.inline(F.array(*cells)))


def correlation_difference(panel: DataFrame, target: str = "any_delinquent",
                           cols: Sequence[str] | None = None) -> DataFrame:
    """Overall and within-loan correlation of each variable with ``target``."""
    def with_target(pairs: DataFrame, name: str) -> DataFrame:
        other = F.when(F.col("var_a") == target, F.col("var_b")).otherwise(F.col("var_a"))
        return (pairs.where((F.col("var_a") == target) | (F.col("var_b") == target))
                .select(other.alias("variable"), F.col("corr").alias(name)))
    cols = _analysis_columns(panel, cols)
    panel = cut(panel.select("LOAN_ID", *cols))  # read twice
    both = (with_target(overall_correlation(panel, cols), "overall")
            .join(with_target(within_correlation(panel, cols), "within"), "variable"))
    return both.withColumn("difference", F.col("overall") - F.col("within"))


def _analysis_columns(panel: DataFrame, cols: Sequence[str] | None) -> list[str]:
    if cols is not None:
        return list(cols)
    return ([c for c in PANEL_VARIABLES if c in panel.columns]
            + [c for c in panel.columns if "_PC1" in c])
