"""Macro series, components and their relation to delinquency."""

from __future__ import annotations

from pyspark.sql import functions as F

from loanpanel.operators import cycles as CY
from loanpanel.operators import loan_bitmaps as LB
from loanpanel.operators import macro as M
from loanpanel.plans.pipeline import add_macro, build_master, clean_quarters
from loanpanel.session import remove_path, scratch_path, settings, shuffles_freed
from loanpanel.sources import raw, sinks
from verification import inputs as I
from verification import sql as Q
from verification.queries_panel import raw_lines
from verification.registry import query, r, rounded

SERIES = [s for ss in I.DOMAINS.values() for s in ss]


def monthly(spark, d):
    return M.monthly_average(M.valid_observations(I.macro_obs(spark, d)))


def wide(spark, d):
    return M.wide_by_month(monthly(spark, d), SERIES)


@query("macro_observations", Q.MACRO + """SELECT series_id, date, cast(value AS double) AS value, strftime(date, '%m%Y') AS act_period
 FROM macro_obs WHERE value IS NOT NULL AND value <> '.'""")
def macro_observations(spark, d):
    """One JSON response document per series, written, read back and exploded."""
    path = scratch_path(spark, "macro_json")
    obs = I.macro_obs(spark, d).withColumn("date", F.col("date").cast("string"))
    # a series' months are split over response pages, so no document holds a whole series
    pages = obs.groupBy("series_id", F.substring("date", 1, 7).alias("page")).agg(
        F.collect_list(F.struct("date", "value")).alias("observations"))
    pages.drop("page").write.json(path)
    docs = spark.read.schema("series_id string, observations array<struct<date:string,value:string>>").json(path)
    return M.valid_observations(raw.explode_observations(docs))


@query("macro_monthly", Q.MACRO + f"SELECT series_id, month, {r('value', 'value')} FROM monthly")
def macro_monthly(spark, d):
    return rounded(monthly(spark, d))


@query("macro_wide", Q.MACRO + "SELECT month, act_period, " + ", ".join(r(s, s) for s in SERIES) + " FROM wide")
def macro_wide(spark, d):
    return rounded(wide(spark, d))


def long_sql(table: str, name: str) -> str:
    return " UNION ALL ".join(f"SELECT month, act_period, '{s}' AS series_id, {r(s, name)} FROM {table}" for s in SERIES)


@query("macro_filled", Q.MACRO + long_sql("filled", "value"))
def macro_filled(spark, d):
    return rounded(M.fill_gaps(wide(spark, d), SERIES))


@query("macro_domain_check", Q.MACRO + " UNION ALL ".join(
    f"SELECT '{dom}' AS domain, cast({' + '.join(f'(count({s}) > 0)::int' for s in ss)} AS bigint) AS series, "
    f"cast({' + '.join(f'CASE WHEN count({s}) > 0 THEN count(*) - count({s}) ELSE 0 END' for s in ss)} AS bigint) AS nulls_left, "
    f"({' + '.join(f'(count({s}) > 0)::int' for s in ss)}) >= 2 AND "
    f"({' + '.join(f'CASE WHEN count({s}) > 0 THEN count(*) - count({s}) ELSE 0 END' for s in ss)}) = 0 AS usable FROM filled"
    for dom, ss in I.DOMAINS.items()))
def macro_domain_check(spark, d):
    return M.domain_check(M.fill_gaps(wide(spark, d), SERIES), I.DOMAINS)


@query("macro_scaled", Q.MACRO + long_sql("scaled", "z"))
def macro_scaled(spark, d):
    return rounded(M.scale_series(M.fill_gaps(wide(spark, d), SERIES)).select("month", "act_period", "series_id", "z"))


FACTORS = ["alpha_PC1", "alpha_PC2", "beta_PC1", "beta_PC2"]


@query("macro_pca", Q.MACRO + "SELECT month, act_period, " + ", ".join(r(c, c) for c in FACTORS) + " FROM pcs")
def macro_pca(spark, d):
    return rounded(I.macro_components(spark, d))


@query("macro_join", Q.PANEL_MACRO + f"SELECT LOAN_ID, time, act_period, {', '.join(r(c, c) for c in FACTORS)} FROM panel_macro")
def macro_join(spark, d):
    return rounded(I.panel_macro(spark, d).select("LOAN_ID", "time", "act_period", *FACTORS))


@query("quarter_macro", Q.PANEL_MACRO + "SELECT data_quarter, " + ", ".join(r(f"avg({c})", f"avg_{c}") for c in FACTORS)
       + ", make_date(cast(substring(data_quarter, 1, 4) AS int), 3 * cast(substring(data_quarter, 6, 1) AS int) - 2, 1) AS quarter_start"
       " FROM panel_macro GROUP BY data_quarter")
def quarter_macro(spark, d):
    return rounded(CY.quarterly_factors(I.panel_macro(spark, d)))


@query("stress_decile", Q.PANEL_MACRO.rstrip() + """, b AS (SELECT quantile_cont(alpha_PC1, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS cut FROM panel_macro)
 SELECT CASE WHEN alpha_PC1 IS NULL THEN NULL ELSE concat('Q', 1 + len(list_filter(cut, lambda x: alpha_PC1 > x))) END AS decile,
 """ + r("avg(any_delinquent)", "dlq_rate") + ", " + r("avg(alpha_PC1)", "avg_stress") + " FROM panel_macro, b GROUP BY 1")
def stress_decile(spark, d):
    panel = I.panel_macro(spark, d)
    return rounded(CY.delinquency_by_decile(panel, CY.stress_factor(CY.factor_columns(panel))))


@query("housing_dlq", Q.PANEL_MACRO + f"SELECT data_quarter, {r('avg(beta_PC1)', 'factor_avg')}, {r('avg(any_delinquent)', 'dlq_rate')} FROM panel_macro GROUP BY 1")
def housing_dlq(spark, d):
    return rounded(CY.factor_and_delinquency(I.panel_macro(spark, d), "beta_PC1"))


CREDIT_IMPACT = Q.PANEL_MACRO.rstrip() + f""", q AS (SELECT data_quarter, avg(alpha_PC1) AS factor_avg, cast(sum(any_delinquent) AS bigint) AS dlq_count,
 count(DISTINCT LOAN_ID) AS active_loans, 100 * sum(any_delinquent) / count(DISTINCT LOAN_ID) AS dlq_pct FROM panel_macro GROUP BY 1)
 SELECT data_quarter, {r('factor_avg', 'factor_avg')}, dlq_count, active_loans, {r('dlq_pct', 'dlq_pct')},
 {r('(SELECT regr_slope(dlq_pct, factor_avg) FROM q)', 'slope')}, {r('(SELECT regr_intercept(dlq_pct, factor_avg) FROM q)', 'intercept')},
 {r('(SELECT corr(dlq_pct, factor_avg) FROM q)', 'corr')} FROM q"""


@query("credit_impact", CREDIT_IMPACT)
def credit_impact(spark, d):
    return rounded(CY.factor_impact(I.panel_macro(spark, d), "alpha_PC1"))


@query("credit_impact_numbered", CREDIT_IMPACT)
def credit_impact_numbered(spark, d):
    """Active loans by bitmaps over dense loan numbers."""
    panel = LB.add_numbers(I.panel_macro(spark, d), LB.number_loans(I.loan_obs(spark, d)))
    return rounded(CY.factor_impact(panel, "alpha_PC1"))


# files of every quarter, one line per observation in ingest order, through the whole pipeline:
# nulls filled by quarter, first-of-month origination, keep-last within the quarter
@query("pipeline_panel", f"""WITH {Q.LOAN_OBS},
 m AS (SELECT data_quarter, median(CSCORE_B) AS a, median(CURR_SCOREB) AS b FROM loan_obs GROUP BY 1),
 f AS (SELECT o.* REPLACE (coalesce(CSCORE_B, a, 0) AS CSCORE_B, coalesce(CURR_SCOREB, b, 0) AS CURR_SCOREB,
  coalesce(DLQ_STATUS, 'Missing') AS DLQ_STATUS, cast(date_trunc('month', ORIG_DATE) AS date) AS ORIG_DATE)
  FROM loan_obs o JOIN m USING (data_quarter)),
 p AS (SELECT {Q.ENCODE}, ORIG_DATE FROM (SELECT *, row_number() OVER (PARTITION BY LOAN_ID, LOAN_AGE, data_quarter
  ORDER BY seq1 DESC, seq2 DESC, seq3 DESC) AS rn FROM f WHERE LOAN_AGE >= 0) WHERE rn = 1),
 {Q.MACRO_CTE}
 SELECT data_quarter, count(*) AS n, cast(sum(event) AS bigint) AS events, cast(sum(any_delinquent) AS bigint) AS delinquent,
  {r('avg(balance_ratio)', 'balance')}, {r('avg(credit_score_change)', 'score_change')}, {r('avg(alpha_PC1)', 'alpha')}, {r('avg(beta_PC1)', 'beta')},
  min(act_period) AS first_month FROM (SELECT *, {Q.ACT_PERIOD} AS act_period FROM p) LEFT JOIN pcs USING (act_period) GROUP BY data_quarter""")
def pipeline_panel(spark, d):
    base = scratch_path(spark, "pipeline")
    lines = raw_lines(spark, d, ["LOAN_ID"]).withColumnRenamed("data_quarter", "quarter")
    # lines come dealt by loan, so this moves none of them again: a loan's lines of a quarter stand in one file, in
    # ingest order; the writer would sort by quarter anew, and lose the order, if the rows were not so sorted.
    # Adaptive execution must not split a large loan, or read the lines as they came, for want of a step that forbids it
    whole = dict.fromkeys(["spark.sql.adaptive.skewJoin.enabled", "spark.sql.adaptive.localShuffleReader.enabled"], "false")
    lines = lines.repartition("LOAN_ID").sortWithinPartitions("quarter", *I.INGEST)
    with shuffles_freed(spark), settings(spark, whole):
        lines.select("value", "quarter").write.partitionBy("quarter").option("compression", "gzip").text(f"{base}/raw")
    quarters = [f"{y}Q{q}" for y in range(1990, 2010) for q in (1, 2, 3, 4)]  # those without a file are skipped
    clean_quarters(spark, f"{base}/raw", quarters, f"{base}/clean", "quarter={}")
    remove_path(spark, f"{base}/raw")  # no longer read
    panel = build_master(spark, sinks.read_master(spark, f"{base}/clean"), f"{base}/master", f"{base}/static")
    panel = add_macro(panel, I.macro_obs(spark, d), I.DOMAINS)
    return rounded(panel.groupBy("data_quarter").agg(
        F.count("*").alias("n"), F.sum("event").alias("events"), F.sum("any_delinquent").alias("delinquent"),
        F.avg("balance_ratio").alias("balance"), F.avg("credit_score_change").alias("score_change"),
        F.avg("alpha_PC1").alias("alpha"), F.avg("beta_PC1").alias("beta"), F.min("act_period").alias("first_month")))
