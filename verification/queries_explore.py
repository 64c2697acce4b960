"""Sampling, panel statistics, descriptive tables."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanpanel.operators import delinquency as D
from loanpanel.operators import loan_bitmaps as LB
from loanpanel.operators import overview as O
from loanpanel.operators import sampling as SA
from loanpanel.operators import variation as V
from loanpanel.session import cut, scratch_path
from loanpanel.sources import sinks
from verification import inputs as I
from verification import sql as Q
from verification.registry import query, r, rounded

BUCKETS = 16  # of tables stored by loan

QUARTERS = ", ".join(f"'{q}'" for q in I.OBSERVATION_QUARTERS)
SEEN = "ORDER BY time, data_quarter"
CHARS = f"""chars AS (SELECT LOAN_ID, first(ORIG_DATE {SEEN}) AS actual_orig_date, first(data_quarter {SEEN}) AS first_observed,
 first(CSCORE_B {SEEN}) AS credit_score, first(OLTV {SEEN}) AS ltv, first(STATE {SEEN}) AS state,
 first(PURPOSE {SEEN}) AS loan_purpose, max(event) AS ever_defaults
 FROM panel WHERE data_quarter IN ({QUARTERS}) GROUP BY LOAN_ID)"""
STRATA = """strata AS (SELECT *, cast(year(actual_orig_date) AS int) AS orig_year,
 CASE WHEN credit_score < 620 THEN 'VeryLow' WHEN credit_score < 680 THEN 'Low' WHEN credit_score < 740 THEN 'Mid'
      WHEN credit_score < 800 THEN 'High' ELSE 'VeryHigh' END AS credit_tier,
 CASE WHEN ltv < 70 THEN 'LowLTV' WHEN ltv < 85 THEN 'MidLTV' ELSE 'HighLTV' END AS ltv_tier,
 CASE WHEN state IN ('CA', 'NY', 'FL', 'TX') THEN 'Major'
      WHEN state IN ('WA', 'OR', 'NV', 'AZ', 'CO', 'IL', 'MI', 'OH', 'PA', 'NJ', 'VA', 'NC', 'GA') THEN 'Large'
      ELSE 'Other' END AS geo_tier FROM chars)"""
BASE = f"WITH {Q.PANEL_CTE},\n{CHARS},\n{STRATA}"
KEYS = "orig_year, credit_tier, ltv_tier, ever_defaults, geo_tier"
TARGETS = f"""targets AS (SELECT {KEYS}, count(*) AS size, count(*) / sum(count(*)) OVER () AS share,
 least(greatest(cast(floor(500 * count(*) / sum(count(*)) OVER ()) AS bigint), 1), count(*)) AS target FROM strata GROUP BY ALL)"""
SAMPLE = f"""{BASE}, sample AS (SELECT LOAN_ID FROM (SELECT LOAN_ID,
 row_number() OVER (PARTITION BY {KEYS} ORDER BY md5('42:' || LOAN_ID), LOAN_ID) AS k,
 count(*) OVER (PARTITION BY {KEYS}) AS n, count(*) OVER () AS total FROM strata)
 WHERE k <= least(greatest(floor(500 * n / total), 1), n))"""


def chars(spark, d):
    return SA.loan_characteristics(I.panel(spark, d), I.OBSERVATION_QUARTERS)


@query("loan_chars", BASE + " SELECT * FROM chars")
def loan_chars(spark, d):
    return chars(spark, d)


@query("strata", BASE + f" SELECT LOAN_ID, {KEYS} FROM strata")
def strata(spark, d):
    return SA.add_strata(chars(spark, d)).select("LOAN_ID", *SA.STRATA)


@query("strata_targets", f"{BASE}, {TARGETS} SELECT {KEYS}, size, {r('share', 'share')}, target FROM targets")
def strata_targets(spark, d):
    return rounded(SA.strata_targets(SA.add_strata(chars(spark, d)), 500))


def sample_ids(spark, d):
    return SA.stratified_sample(I.panel(spark, d), 500, 42, I.OBSERVATION_QUARTERS)


@query("stratified_sample", SAMPLE + " SELECT LOAN_ID FROM sample")
def stratified_sample(spark, d):
    return sample_ids(spark, d)


@query("sample_panel", SAMPLE + f" SELECT {Q.TV_COLUMNS} FROM panel SEMI JOIN sample USING (LOAN_ID)")
def sample_panel(spark, d):
    tv = I.time_varying(spark, d, across_quarters=True)
    return rounded(SA.full_history(tv, sample_ids(spark, d)))


@query("loan_default_rate", Q.PANEL.rstrip() + ", l AS (SELECT LOAN_ID, max(event) AS e FROM panel GROUP BY 1) "
       "SELECT count(*) AS loans, count(*) FILTER (e = 1) AS defaulted, "
       + r("count(*) FILTER (e = 1) / count(*)", "default_rate") + " FROM l")
def loan_default_rate(spark, d):
    return rounded(SA.loan_default_rate(I.panel(spark, d)))


@query("orig_year_dist", Q.PANEL + """SELECT cast(year(ORIG_DATE) AS int) AS orig_year, count(DISTINCT LOAN_ID) AS count
 FROM panel GROUP BY 1""")
def orig_year_dist(spark, d):
    return SA.origination_years(I.panel(spark, d))


def describe_sql(source: str, cols: list[str]) -> str:
    """Long description table of ``cols`` of the CTE ``source``."""
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS count, {r(f'avg({c})', 'mean')}, {r(f'stddev_samp({c})', 'std')}, "
        f"{r(f'min({c})::double', 'min')}, {r(f'quantile_cont({c}, 0.25)', 'p25')}, {r(f'quantile_cont({c}, 0.5)', 'p50')}, "
        f"{r(f'quantile_cont({c}, 0.75)', 'p75')}, {r(f'max({c})::double', 'max')} FROM {source}" for c in cols)


FIRSTS = Q.PANEL.rstrip() + ", f AS (SELECT " + ", ".join(
    f"first({c} {SEEN}) AS {c}" for c in V.ORIGINATION_VARIABLES) + " FROM panel GROUP BY LOAN_ID) "


@query("describe_credit", FIRSTS + describe_sql("f", ["CSCORE_B"]))
def describe_credit(spark, d):
    return rounded(SA.describe_credit(I.panel(spark, d)))


@query("describe_static", FIRSTS + describe_sql("f", V.ORIGINATION_VARIABLES))
def describe_static(spark, d):
    return rounded(V.describe_static(I.panel(spark, d)))


@query("describe_varying", Q.PANEL + describe_sql("(SELECT * REPLACE (any_delinquent::double AS any_delinquent) FROM panel)", V.PANEL_VARIABLES))
def describe_varying(spark, d):
    return rounded(V.describe_varying(I.panel(spark, d)))


WITHIN = Q.PANEL.rstrip() + ", w AS (SELECT " + ", ".join(
    f"stddev_samp({c}) AS {c}" for c in V.PANEL_VARIABLES) + " FROM panel GROUP BY LOAN_ID) "


@query("describe_within", WITHIN + describe_sql("w", V.PANEL_VARIABLES))
def describe_within(spark, d):
    return rounded(V.describe_within(I.panel(spark, d)))


@query("within_std_mean", WITHIN + " UNION ALL ".join(
    f"SELECT '{c}' AS variable, {r(f'avg({c})', 'mean_within_std')} FROM w" for c in V.KEY_VARIABLES))
def within_std_mean(spark, d):
    return rounded(V.mean_within_std(I.panel(spark, d)))


@query("coverage", Q.PANEL + """SELECT count(DISTINCT STATE) AS states, count(DISTINCT data_quarter) AS quarters,
 min(data_quarter) AS first_quarter, max(data_quarter) AS last_quarter FROM panel""")
def coverage(spark, d):
    return SA.coverage(I.panel(spark, d))


INFO = """SELECT LOAN_ID, max(event) AS max_event, max(any_delinquent) AS ever_delinquent,
 count(data_quarter) AS n_observations, min(data_quarter) AS first_quarter, max(data_quarter) AS last_quarter,
 min(time) AS min_time, max(time) AS max_time FROM panel GROUP BY LOAN_ID"""


@query("loan_info", Q.PANEL + INFO)
def loan_info(spark, d):
    return SA.loan_info(I.panel(spark, d))


@query("balanced_sample", Q.PANEL.rstrip() + f""", info AS ({INFO}),
 n AS (SELECT count(*) AS total, count(*) FILTER (ever_delinquent = 1) AS ever FROM info),
 q AS (SELECT least(floor(300 * ever / total), ever) AS dlq FROM n)
 SELECT LOAN_ID FROM (SELECT LOAN_ID, ever_delinquent, dlq,
   row_number() OVER (PARTITION BY ever_delinquent ORDER BY md5('42:' || LOAN_ID), LOAN_ID) AS k
   FROM info, q WHERE ever_delinquent IS NOT NULL)
 WHERE k <= CASE WHEN ever_delinquent = 1 THEN dlq ELSE 300 - dlq END""")
def balanced_sample(spark, d):
    return SA.balanced_sample(I.panel(spark, d), 300)


def summary_sql() -> str:
    firsts = ", ".join(f"first({c} {SEEN}) AS {c}" for c in O.FIRST_ATTRIBUTES)
    varying = ", ".join(
        f"{r(f'last({c} {SEEN})', c + '_last')}, {r(f'avg({c})', c + '_mean')}, {r(f'stddev_samp({c})', c + '_std')}"
        for c in O.TIME_VARYING)
    factors = ", ".join(r(f"avg({c})", f"{c}_mean") for c in ["alpha_PC1", "alpha_PC2", "beta_PC1"])
    return (f"SELECT LOAN_ID, {firsts}, max(event) AS event_max, max(any_delinquent) AS any_delinquent_max, "
            "count(time) AS time_count, min(time) AS time_min, max(time) AS time_max, min(data_quarter) AS first_quarter, "
            f"max(data_quarter) AS last_quarter, {varying}, {factors}, "
            "max(serious_delinquent) AS serious_delinquent_max FROM panel_macro GROUP BY LOAN_ID")


@query("loan_summary", Q.PANEL_MACRO + summary_sql().replace("first(ORIG_RATE ORDER BY time, data_quarter) AS ORIG_RATE",
                                                            "round(first(ORIG_RATE ORDER BY time, data_quarter), 6) + 0e0 AS ORIG_RATE"))
def loan_summary(spark, d):
    return rounded(O.loan_summary(I.panel_macro(spark, d), ["alpha_PC1", "alpha_PC2", "beta_PC1"]))


LOANS = Q.PANEL.rstrip() + """, l AS (SELECT LOAN_ID, count(*) AS obs, count(time) AS times, min(time) AS t0,
 max(time) AS t1, max(any_delinquent) AS ever, any_value(STATE) AS STATE, any_value(ORIG_UPB) AS ORIG_UPB,
 any_value(CSCORE_B) AS CSCORE_B, avg(credit_score_change) AS change, stddev_samp(credit_score_change) AS csd FROM panel GROUP BY 1) """


@query("panel_overview", LOANS + "SELECT count(*) AS loans, cast(sum(obs) AS bigint) AS observations, "
       + r("avg(obs)", "avg_observations") + """, min(times) AS min_observations, max(times) AS max_observations,
 min(t0) AS min_time, max(t1) AS max_time, (SELECT count(DISTINCT data_quarter) FROM panel) AS quarters,
 (SELECT min(data_quarter) FROM panel) AS first_quarter, (SELECT max(data_quarter) FROM panel) AS last_quarter FROM l""")
def panel_overview(spark, d):
    return rounded(O.panel_overview(I.panel(spark, d)))


@query("panel_balance", LOANS + "SELECT obs, count(*) AS loans, "
       + r("100.0 * count(*) / sum(count(*)) OVER ()", "pct") + " FROM l GROUP BY obs ORDER BY obs")
def panel_balance(spark, d):
    return rounded(O.panel_balance(I.panel(spark, d)))


EVENTS = Q.PANEL.rstrip() + """, e AS (SELECT LOAN_ID, count(event) AS total_obs,
 count(DISTINCT event) + max(CASE WHEN event IS NULL THEN 1 ELSE 0 END) AS unique_events FROM panel GROUP BY 1) """


@query("event_transitions", EVENTS + "SELECT cast(unique_events AS bigint) AS unique_events, count(*) AS loans, "
       + r("100.0 * count(*) / sum(count(*)) OVER ()", "pct") + " FROM e GROUP BY 1")
def event_transitions(spark, d):
    return rounded(O.event_transitions(I.panel(spark, d)))


@query("event_complexity", EVENTS + "SELECT LOAN_ID, total_obs, cast(unique_events AS bigint) AS unique_events FROM e")
def event_complexity(spark, d):
    return O.event_complexity(I.panel(spark, d))


QUARTER_DLQ = Q.PANEL + (
    f"SELECT data_quarter, {r('avg(any_delinquent)', 'any_delinquent_rate')}, "
    f"{r('avg(serious_delinquent)', 'serious_delinquent_rate')}, count(DISTINCT LOAN_ID) AS active_loans FROM panel GROUP BY 1")


@query("quarter_dlq", QUARTER_DLQ)
def quarter_dlq(spark, d):
    return rounded(D.quarterly_delinquency(I.panel(spark, d)))


@query("quarter_dlq_numbered", QUARTER_DLQ)
def quarter_dlq_numbered(spark, d):
    """Active loans by bitmaps over dense loan numbers."""
    return rounded(D.quarterly_delinquency(LB.add_numbers(I.panel(spark, d), LB.number_loans(I.loan_obs(spark, d)))))


@query("loan_counts", Q.PANEL + """SELECT 'quarter' AS level, data_quarter AS value, count(DISTINCT LOAN_ID) AS loans FROM panel GROUP BY data_quarter
 UNION ALL SELECT 'state', STATE, count(DISTINCT LOAN_ID) FROM panel GROUP BY STATE
 UNION ALL SELECT 'year', substring(data_quarter, 1, 4), count(DISTINCT LOAN_ID) FROM panel GROUP BY 2
 UNION ALL SELECT 'all', NULL, count(DISTINCT LOAN_ID) FROM panel""")
def loan_counts(spark, d):
    """Bitmaps by quarter and state from two batches of loans, the second appended twice, counted at four levels."""
    panel, path = cut(I.panel(spark, d).select("LOAN_ID", "data_quarter", "STATE")), scratch_path(spark, "bitmaps")
    late = F.col("data_quarter") >= "1995Q1"
    numbers = None
    for batch in (panel.where(~late), panel.where(late)):
        new = cut(LB.number_loans(batch, numbers))
        numbers = new if numbers is None else numbers.unionByName(new)
        bitmaps = LB.loan_bitmaps(LB.add_numbers(batch, numbers), ["data_quarter", "STATE"])
        LB.append_bitmaps(bitmaps, path)
    LB.append_bitmaps(bitmaps, path)
    stored = spark.read.parquet(path).withColumn("year", F.substring("data_quarter", 1, 4))
    levels = {"quarter": "data_quarter", "state": "STATE", "year": "year"}
    counts = [LB.count_loans(stored, [c]).select(F.lit(level).alias("level"), F.col(c).alias("value"), "loans")
              for level, c in levels.items()]
    whole = LB.count_loans(stored).select(F.lit("all").alias("level"), F.lit(None).cast("string").alias("value"), "loans")
    return reduce(DataFrame.unionByName, [*counts, whole])


def histogram_sql(source: str, value: str, by: str | None = None, bins: int = 30, extra: str = "") -> str:
    """Left-closed equal-width bins with empty bins kept."""
    g = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    match = f"x.{by} = b.{by} AND " if by else ""
    return f"""bounds AS (SELECT {g}CASE WHEN min({value}) = max({value}) THEN min({value}) - 0.5e0 ELSE min({value}) END AS low,
   CASE WHEN min({value}) = max({value}) THEN 1e0 ELSE max({value}) - min({value}) END AS span, count({value}) AS total
   FROM {source} {group}),
 placed AS (SELECT {('b.' + by + ', ') if by else ''}cast(least(floor(({value} - low) * {bins} / span), {bins - 1}) AS int) AS bin, count(*) AS n
   FROM {source} x JOIN bounds b ON {match}{value} IS NOT NULL GROUP BY ALL)
 SELECT {('s.' + by + ', ') if by else ''}s.bin, round(low + s.bin * (span / {bins}), 6) + 0e0 AS lo,
   round(low + (s.bin + 1) * (span / {bins}), 6) + 0e0 AS hi, cast(coalesce(n, 0) AS bigint) AS count,
   round(coalesce(n, 0) / (total * (span / {bins})), 6) + 0e0 AS density{extra}
 FROM (SELECT *, cast(unnest(range({bins})) AS int) AS bin FROM bounds WHERE total > 0) s
 LEFT JOIN placed p ON {f's.{by} = p.{by} AND ' if by else ''}s.bin = p.bin"""


@query("first_dlq_time", Q.PANEL.rstrip() + """, f AS (SELECT LOAN_ID, min(time) AS first_dlq_time FROM panel
 WHERE any_delinquent = 1 GROUP BY 1), """ + histogram_sql(
     "f", "first_dlq_time", extra=", round((SELECT median(first_dlq_time) FROM f), 6) + 0e0 AS median"))
def first_dlq_time(spark, d):
    return rounded(D.first_delinquency_histogram(I.panel(spark, d)))


@query("obs_per_loan_hist", LOANS.rstrip() + ", " + histogram_sql(
    "l", "obs", extra=", round((SELECT avg(obs) FROM l), 6) + 0e0 AS mean_obs"))
def obs_per_loan_hist(spark, d):
    return rounded(V.panel_length_histogram(I.panel(spark, d)))


KNOWN = LOANS.rstrip() + ", k AS (SELECT *, ever AS any_delinquent_max FROM l WHERE ever IS NOT NULL), "


@query("density_by_outcome", KNOWN + histogram_sql("k", "CSCORE_B", "any_delinquent_max"))
def density_by_outcome(spark, d):
    return rounded(V.density_by_outcome(O.loan_summary(I.panel(spark, d)), "CSCORE_B"))


@query("density_credit_change", KNOWN + histogram_sql("k", "change", "any_delinquent_max"))
def density_credit_change(spark, d):
    return rounded(V.density_by_outcome(O.loan_summary(I.panel(spark, d)), "credit_score_change_mean"))


@query("naive_survival", Q.PANEL.rstrip() + """, l AS (SELECT LOAN_ID, min(time) AS seen,
 min(time) FILTER (any_delinquent = 1) AS dlq, max(time) AS last FROM panel GROUP BY 1),
 t AS (SELECT unnest(range(0, cast((SELECT floor(max(last)) FROM l) AS bigint) + 1, 2)) AS time)
 SELECT time, count(*) FILTER (seen <= time) AS loans_seen, count(*) FILTER (dlq <= time) AS loans_delinquent,
 round(CASE WHEN count(*) FILTER (seen <= time) = 0 THEN 1 ELSE 1 - count(*) FILTER (dlq <= time) / count(*) FILTER (seen <= time) END, 6) + 0e0 AS survival
 FROM t, l GROUP BY time""")
def naive_survival(spark, d):
    return rounded(D.naive_survival(I.panel(spark, d)))


LAGGED = Q.PANEL.rstrip() + """, g AS (SELECT LOAN_ID, time, any_delinquent, lag(any_delinquent) OVER w AS dlq_lag,
 time - lag(time) OVER w AS time_gap FROM panel WINDOW w AS (PARTITION BY LOAN_ID ORDER BY time, data_quarter)) """


MOVES = LAGGED + """SELECT dlq_lag, any_delinquent, count(*) AS count,
 cast(sum(count(*)) OVER (PARTITION BY dlq_lag) AS bigint) AS total_from_state,
 round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY dlq_lag), 6) + 0e0 AS transition_pct
 FROM g WHERE dlq_lag IS NOT NULL GROUP BY dlq_lag, any_delinquent"""


@query("transition_matrix", MOVES)
def transition_matrix(spark, d):
    return rounded(D.transition_matrix(I.panel(spark, d)))


@query("moves_by_loan", MOVES)
def moves_by_loan(spark, d):
    """The panel stored in buckets of the loan: the lag moves no rows."""
    stored = sinks.write_by_loan(I.panel(spark, d), f"panel_{uuid.uuid4().hex}", BUCKETS)
    return rounded(D.transition_matrix(stored))


@query("time_gaps", LAGGED + "SELECT LOAN_ID, time, time_gap FROM g WHERE time_gap <> 1")
def time_gaps(spark, d):
    return D.gaps(I.panel(spark, d))


@query("gap_summary", LAGGED + f"""SELECT count(*) AS gaps, count(DISTINCT LOAN_ID) AS loans_with_gaps,
 {r('avg(time_gap)', 'avg_gap')}, max(time_gap) AS max_gap FROM g WHERE time_gap <> 1""")
def gap_summary(spark, d):
    return rounded(D.gap_summary(I.panel(spark, d)))


@query("by_time", Q.PANEL + f"""SELECT time, {r('avg(any_delinquent)', 'dlq_rate')}, {r('avg(credit_score_change)', 'avg_credit_change')},
 {r('avg(balance_ratio)', 'avg_balance_ratio')}, {r('avg(rate_change)', 'avg_rate_change')} FROM panel GROUP BY 1""")
def by_time(spark, d):
    return rounded(D.by_age(I.panel(spark, d)))


@query("by_time_dlq", Q.PANEL + f"SELECT time, any_delinquent, {r('avg(balance_ratio)', 'avg_balance_ratio')} FROM panel GROUP BY 1, 2")
def by_time_dlq(spark, d):
    return rounded(D.balance_by_age_and_status(I.panel(spark, d)))


EXITS = Q.PANEL.rstrip() + f""", x AS (SELECT LOAN_ID, max(time) AS last_observed_time,
 last(any_delinquent {SEEN}) AS final_status, last(event {SEEN}) AS final_event FROM panel GROUP BY 1) """


@query("loan_exits", EXITS + "SELECT * FROM x")
def loan_exits(spark, d):
    return D.loan_exits(I.panel(spark, d))


@query("exit_analysis", EXITS + """SELECT final_status, count(*) AS early_exits,
 round(100.0 * count(*) / (SELECT count(*) FROM x), 6) + 0e0 AS pct_of_loans FROM x
 WHERE last_observed_time < 0.9 * (SELECT max(last_observed_time) FROM x) GROUP BY 1""")
def exit_analysis(spark, d):
    return rounded(D.exit_analysis(I.panel(spark, d)))


@query("panel_mode", LOANS + """, c AS (SELECT obs, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM l GROUP BY obs)
 SELECT obs AS modal_length, n AS modal_loans, round(100 * share, 6) + 0e0 AS modal_pct,
 CASE WHEN share > 0.8 THEN 'Strongly Balanced' ELSE 'Unbalanced' END AS panel_type FROM c ORDER BY n DESC, obs LIMIT 1""")
def panel_mode(spark, d):
    return rounded(O.modal_length(I.panel(spark, d)))


@query("dlq_rates", LOANS + f"""SELECT {r('100 * (SELECT avg(any_delinquent) FROM panel)', 'overall_pct')},
 {r('100 * avg(ever)', 'ever_pct')} FROM l""")
def dlq_rates(spark, d):
    return rounded(O.delinquency_rates(I.panel(spark, d)))


@query("dlq_by_length", LOANS + """, e AS (SELECT min(times) AS a, max(times) AS z FROM l),
 b AS (SELECT CASE WHEN a = z THEN 5 ELSE cast(greatest(ceil((times - a) * 10 / (z - a)), 1) AS int) END AS bin, count(*) AS loans, 100 * avg(ever) AS rate FROM l, e GROUP BY 1)
 SELECT s.bin, round(a + (s.bin - 1) * ((z - a) / 10), 6) + 0e0 AS lo, round(a + s.bin * ((z - a) / 10), 6) + 0e0 AS hi,
 cast(coalesce(loans, 0) AS bigint) AS loans, round(coalesce(rate, 0), 6) + 0e0 AS dlq_pct
 FROM (SELECT *, cast(unnest(range(1, 11)) AS int) AS bin FROM e) s LEFT JOIN b USING (bin)""")
def dlq_by_length(spark, d):
    return rounded(V.delinquency_by_length(O.loan_summary(I.panel(spark, d))))


@query("top_states", LOANS + f"""SELECT STATE, count(ever) AS loan_count, {r('avg(ever)', 'dlq_rate')},
 {r('avg(ORIG_UPB)', 'avg_balance')} FROM l WHERE STATE IS NOT NULL GROUP BY 1 ORDER BY loan_count DESC, STATE LIMIT 15""")
def top_states(spark, d):
    return rounded(V.top_states(O.loan_summary(I.panel(spark, d))))


def corr_sql(source: str, cols: list[str], name: str = "corr") -> str:
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    return " UNION ALL ".join(
        f"SELECT '{a}' AS var_a, '{b}' AS var_b, {r(f'corr({a}, {b})', name)} FROM {source}" for a, b in pairs)


CORR_COLUMNS = [*V.PANEL_VARIABLES, "alpha_PC1", "beta_PC1"]
CENTRED = Q.PANEL_MACRO.rstrip() + ", centred AS (SELECT " + ", ".join(
    f"{c} - avg({c}) OVER (PARTITION BY LOAN_ID) AS {c}" for c in CORR_COLUMNS) + " FROM panel_macro) "


@query("corr_overall", Q.PANEL_MACRO + corr_sql("panel_macro", CORR_COLUMNS))
def corr_overall(spark, d):
    return rounded(V.overall_correlation(I.panel_macro(spark, d)))


@query("corr_within", CENTRED + corr_sql("centred", CORR_COLUMNS))
def corr_within(spark, d):
    return rounded(V.within_correlation(I.panel_macro(spark, d)))


@query("corr_difference", CENTRED + " UNION ALL ".join(
    f"SELECT '{c}' AS variable, {r(f'(SELECT corr(any_delinquent, {c}) FROM panel_macro)', 'overall')}, "
    f"{r(f'(SELECT corr(any_delinquent, {c}) FROM centred)', 'within')}, "
    f"{r(f'(SELECT corr(any_delinquent, {c}) FROM panel_macro) - (SELECT corr(any_delinquent, {c}) FROM centred)', 'difference')}"
    for c in CORR_COLUMNS if c != "any_delinquent"))
def corr_difference(spark, d):
    return rounded(V.correlation_difference(I.panel_macro(spark, d)))


MISSING = ["CSCORE_B", "PURPOSE", "dlq_status_original", "any_delinquent", "serious_delinquent", "credit_score_change"]


@query("missing_profile", Q.PANEL_MACRO + "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {r(f'100 * count(*) FILTER ({c} IS NULL) / count(*)', 'missing_pct')} FROM panel_macro"
    for c in [*"LOAN_ID time event dlq_severity balance_ratio rate_change data_quarter ORIG_DATE DTI ORIG_RATE ORIG_UPB OLTV STATE PROP alpha_PC1 beta_PC1".split(), *MISSING, "alpha_PC2", "beta_PC2", "act_period"])
       + ") WHERE missing_pct > 0")
def missing_profile(spark, d):
    return rounded(O.missing_profile(I.panel_macro(spark, d).drop("month")))


@query("insights", LOANS + f"""SELECT count(*) AS loans, cast(sum(obs) AS bigint) AS observations, {r('avg(obs)', 'avg_observations')},
 min(times) AS min_length, max(times) AS max_length, min(t0) AS min_time, max(t1) AS max_time,
 {r('100 * (SELECT avg(any_delinquent) FROM panel)', 'overall_dlq_pct')}, {r('100 * avg(ever)', 'ever_dlq_pct')},
 {r('(SELECT avg(credit_score_change) FROM panel)', 'avg_credit_change')}, {r('avg(csd)', 'credit_volatility')}, 2 AS economic_factors FROM l""")
def insights(spark, d):
    return rounded(O.key_insights(I.panel_macro(spark, d)))
