"""Survival table, features, hazards, Cox models, concordance, forest."""

from __future__ import annotations

from pyspark.sql import functions as F

from loanpanel.operators import features as FE
from loanpanel.operators import sampling as SA
from loanpanel.operators.survival import compare as CM
from loanpanel.operators.survival import concordance as CC
from loanpanel.operators.survival import cox as CX
from loanpanel.operators.survival import forest as FO
from loanpanel.operators.survival import table as T
from loanpanel.session import cut
from loanpanel.plans.macro_effect import forest_effect as run_forest_effect
from loanpanel.plans.macro_effect import macro_effect as run_macro_effect
from verification import inputs as I
from verification import sql_survival as SS
from verification.registry import query, r, rounded

FACTORS = ["alpha_PC1", "alpha_PC2", "beta_PC1", "beta_PC2"]
OUTCOME = ["LOAN_ID", "survival_time", "survival_event"]


def surv(spark, d, cols=SS.STATIC):
    """Survival rows with the covariates ``cols``; those not asked for are not moved."""
    return T.survival_table(I.panel(spark, d), cols)


def surv_macro(spark, d, cols=SS.COVARIATES):
    return T.survival_table(I.panel_macro(spark, d), cols)


def valid(spark, d, cols=SS.STATIC):
    return FE.valid_survival(surv(spark, d, cols))


def scaled(spark, d, cols):
    """Standardised covariates, cached because the fits read them several times."""
    df = valid(spark, d, cols).select("LOAN_ID", "survival_time", "survival_event", *cols).persist()
    return FE.Scaler.fit(df, cols).transform(df), df


@query("survival_table", SS.SURV_MACRO + " SELECT LOAN_ID, survival_event, survival_time, macro_quarter, "
       + ", ".join(r(c, c) for c in SS.COVARIATES) + " FROM surv")
def survival_table(spark, d):
    return rounded(surv_macro(spark, d))


@query("survival_summary", SS.SURV + f""" SELECT count(*) AS rows, {r('avg(survival_event)', 'event_rate')},
 min(survival_time) AS min_duration, max(survival_time) AS max_duration FROM valid""")
def survival_summary(spark, d):
    return rounded(T.survival_summary(valid(spark, d)))


FILL = ["CSCORE_B", "credit_score_change", "alpha_PC1"]


@query("survival_clean", SS.SURV_MACRO + ", m AS (SELECT " + ", ".join(f"median({c}) AS m_{c}" for c in FILL)
       + " FROM valid) SELECT LOAN_ID, survival_event, survival_time, "
       + ", ".join(r(f"coalesce({c}, m_{c}, 0)", c) for c in FILL) + " FROM valid, m")
def survival_clean(spark, d):
    df = cut(FE.valid_survival(surv_macro(spark, d)).select("LOAN_ID", "survival_event", "survival_time", *FILL))
    return rounded(FE.fill_features(df, FE.fit_medians(df, FILL)))


@query("time_split", SS.SURV_MACRO + f""" SELECT CASE WHEN macro_quarter <= DATE '{I.SPLIT_DATE}' THEN 'train' ELSE 'test' END AS part,
 macro_quarter, count(*) AS n, cast(sum(survival_event) AS bigint) AS events FROM surv WHERE macro_quarter IS NOT NULL GROUP BY 1, 2""")
def time_split(spark, d):
    train, test = FE.time_split(surv_macro(spark, d), I.SPLIT_DATE)
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return both.groupBy("part", "macro_quarter").agg(
        F.count("*").alias("n"), F.sum("survival_event").alias("events"))


def with_odd_columns(df):
    """A constant, an infinite and an all-null column next to the covariates."""
    return (df.withColumn("flat", F.lit(1.0))
            .withColumn("wild", F.when(F.col("survival_time") == 3, F.lit(float("inf"))).otherwise(F.col("DTI")))
            .withColumn("empty", F.lit(None).cast("double")))


@query("feature_screen", SS.SURV_MACRO + " " + " UNION ALL ".join(
    [f"SELECT '{c}' AS feature, {r(f'var_samp({c})', 'variance', 4)}, cast(0 AS bigint) AS infinite, var_samp({c}) > 0 AS keep FROM surv" for c in SS.COVARIATES]
    + ["SELECT 'flat', 0e0, 0, false", "SELECT 'empty', NULL, 0, false",
       "SELECT 'wild', NULL, (SELECT count(*) FROM valid WHERE survival_time = 3), false"]))
def feature_screen(spark, d):
    return rounded(FE.screen_features(with_odd_columns(surv_macro(spark, d))), 4)


@query("feature_topk", SS.SURV_MACRO + " SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {r(f'corr({c}, survival_event)', 'corr')}, {r(f'abs(corr({c}, survival_event))', 'abs_corr')} FROM valid"
    for c in SS.COVARIATES) + ") ORDER BY abs_corr DESC, feature LIMIT 5")
def feature_topk(spark, d):
    return rounded(FE.rank_features(FE.valid_survival(surv_macro(spark, d)), SS.COVARIATES, top=5))


SPLIT = SS.SURV_MACRO + f", s AS (SELECT *, macro_quarter <= DATE '{I.SPLIT_DATE}' AS early FROM valid)"


@query("standardize", SPLIT + ", z AS (SELECT " + ", ".join(
    f"avg({c}) FILTER (early) AS m_{c}, stddev_pop({c}) FILTER (early) AS s_{c}" for c in SS.STATIC) + " FROM s) SELECT LOAN_ID, early, "
       + ", ".join(r(f"({c} - m_{c}) / s_{c}", c) for c in SS.STATIC) + " FROM s, z")
def standardize(spark, d):
    """Both periods scaled with the early period's moments."""
    df = FE.valid_survival(surv_macro(spark, d)).withColumn("early", F.col("macro_quarter") <= F.lit(I.SPLIT_DATE).cast("date"))
    df = cut(df.select("LOAN_ID", "early", *SS.STATIC))
    scaler = FE.Scaler.fit(df.where("early"), SS.STATIC)
    return rounded(scaler.transform(df).select("LOAN_ID", "early", *SS.STATIC))


@query("macro_features", SS.SURV_MACRO + " " + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {'true' if c in FACTORS else 'false'} AS is_macro, count({c}) AS known FROM surv" for c in SS.COVARIATES))
def macro_features(spark, d):
    df = surv_macro(spark, d)
    macro = FE.macro_features(SS.COVARIATES, FACTORS)
    known = df.agg(*[F.count(c).alias(c) for c in SS.COVARIATES]).unpivot([], SS.COVARIATES, "feature", "known")
    return known.withColumn("is_macro", F.col("feature").isin(macro))


# the floor of each share, at least one; what is left of 1,000 goes to the largest fractions
SMART = SS.SURV + """, q AS (SELECT quantile_cont(survival_time, [0.25, 0.5, 0.75]) AS cut FROM surv),
 s AS (SELECT LOAN_ID, survival_event, len(list_filter(cut, lambda b: survival_time > b)) AS quartile FROM surv, q),
 sizes AS (SELECT survival_event, quartile, count(*) AS n, 1000 * count(*) / sum(count(*)) OVER () AS share,
  sum(count(*)) OVER () AS total FROM s GROUP BY 1, 2),
 low AS (SELECT *, least(greatest(floor(share), 1), n) AS base,
  row_number() OVER (ORDER BY share < 1, share - floor(share) DESC, survival_event || '|' || quartile) AS place FROM sizes),
 quota AS (SELECT survival_event, quartile, CASE WHEN total <= 1000 THEN n ELSE least(n,
  base + (place <= 1000 - sum(base) OVER ())::int) END AS quota FROM low),
 k AS (SELECT LOAN_ID, survival_event FROM (SELECT *, row_number() OVER (PARTITION BY survival_event, quartile
  ORDER BY md5('42:' || LOAN_ID), LOAN_ID) AS k FROM s) JOIN quota USING (survival_event, quartile) WHERE k <= quota)"""


@query("smart_sample", SMART + " SELECT LOAN_ID FROM k")
def smart_sample(spark, d):
    return SA.smart_sample(cut(surv(spark, d).select(*OUTCOME)), 1000).select("LOAN_ID")


@query("sample_quality", SMART + " SELECT " + r("(SELECT avg(survival_event) FROM surv)", "original_rate") + ", "
       + r("(SELECT avg(survival_event) FROM k)", "sample_rate") + ", "
       + r("abs((SELECT avg(survival_event) FROM surv) - (SELECT avg(survival_event) FROM k))", "difference"))
def sample_quality(spark, d):
    df = cut(surv(spark, d).select(*OUTCOME))
    return rounded(SA.sample_quality(df, SA.smart_sample(df, 1000)))


# --- hazards ----------------------------------------------------------------

RISK = """g AS (SELECT survival_time AS time, count(*) AS c, cast(sum(survival_event) AS bigint) AS events FROM {src} GROUP BY 1),
 risk AS (SELECT time, cast(sum(c) OVER (ORDER BY time DESC) AS bigint) AS at_risk, events, c - events AS censored FROM g)"""
HAZARD = """inc AS (SELECT time, at_risk, events, list_sum(list_transform(range(events), lambda j: 1e0 / (at_risk - j))) AS a,
  list_sum(list_transform(range(events), lambda j: 1e0 / ((at_risk - j) * (at_risk - j)))) AS v FROM risk),
 cum AS (SELECT time, at_risk, events, sum(coalesce(a, 0)) OVER (ORDER BY time) AS h, sum(coalesce(v, 0)) OVER (ORDER BY time) AS v FROM inc)"""
LIMITS = (f"{r('h', 'cum_hazard')}, {r('CASE WHEN h > 0 THEN h * exp(-1.959963984540054 * sqrt(v) / h) ELSE 0 END', 'ci_lower')}, "
          f"{r('CASE WHEN h > 0 THEN h * exp(1.959963984540054 * sqrt(v) / h) ELSE 0 END', 'ci_upper')}")


@query("risk_table", SS.SURV + ", " + RISK.format(src="surv") + " SELECT * FROM risk")
def risk_table(spark, d):
    return T.risk_table(surv(spark, d))


@query("nelson_aalen", SS.SURV + ", " + RISK.format(src="valid") + ", " + HAZARD + f" SELECT time, at_risk, events, {LIMITS} FROM cum")
def nelson_aalen(spark, d):
    return rounded(T.nelson_aalen(T.risk_table(valid(spark, d))))


@query("nelson_aalen_plain", SS.SURV + ", " + RISK.format(src="valid") + f""", cum AS (SELECT time, at_risk, events,
  sum(events / at_risk) OVER (ORDER BY time) AS h, sum((at_risk - events) * events / power(at_risk, 3)) OVER (ORDER BY time) AS v FROM risk)
 SELECT time, at_risk, events, {LIMITS} FROM cum""")
def nelson_aalen_plain(spark, d):
    return rounded(T.nelson_aalen(T.risk_table(valid(spark, d)), tie_corrected=False))


PARTS = SS.SURV_MACRO + f""", part AS (SELECT *, CASE WHEN macro_quarter <= DATE '{I.SPLIT_DATE}' THEN 'train' ELSE 'test' END AS part FROM valid WHERE macro_quarter IS NOT NULL),
 g AS (SELECT part, survival_time AS time, count(*) AS c, cast(sum(survival_event) AS bigint) AS events FROM part GROUP BY 1, 2),
 risk AS (SELECT part, time, cast(sum(c) OVER (PARTITION BY part ORDER BY time DESC) AS bigint) AS at_risk, events FROM g),
 inc AS (SELECT *, list_sum(list_transform(range(events), lambda j: 1e0 / (at_risk - j))) AS a FROM risk)
 SELECT part, time, at_risk, events, round(sum(coalesce(a, 0)) OVER (PARTITION BY part ORDER BY time), 6) + 0e0 AS cum_hazard FROM inc"""


@query("nelson_aalen_split", PARTS)
def nelson_aalen_split(spark, d):
    parts = FE.time_split(FE.valid_survival(surv_macro(spark, d)), I.SPLIT_DATE)
    train, test = [T.nelson_aalen(T.risk_table(p)).withColumn("part", F.lit(n)) for p, n in zip(parts, ("train", "test"))]
    return rounded(train.unionByName(test).drop("ci_lower", "ci_upper"))


# --- Cox --------------------------------------------------------------------

PAIR = ["OLTV", "DTI"]
TRIPLE = ["OLTV", "DTI", "ORIG_RATE"]
FIXED = {"OLTV": 0.01, "DTI": -0.02}
FIXED_CTE = "fixed AS (SELECT 0.01 AS b0, -0.02 AS b1)"


@query("cox_loglik", SS.SURV + f", {FIXED_CTE},\n{SS.evaluate_cte('eb', 'fixed', PAIR, 'valid', 'breslow')},\n"
       f"{SS.evaluate_cte('ee', 'fixed', PAIR, 'valid', 'efron')},\nzero AS (SELECT 0e0 AS b0, 0e0 AS b1),\n"
       f"{SS.evaluate_cte('nb', 'zero', PAIR, 'valid', 'breslow')}\n" + " UNION ALL ".join(
           f"SELECT '{t}' AS ties, '{at}' AS at, n AS rows, events, {r('ll', 'log_likelihood')}, {r('g0', 'score_oltv')}, {r('g1', 'score_dti')} FROM {e}"
           for t, at, e in (("breslow", "fixed", "eb"), ("efron", "fixed", "ee"), ("breslow", "zero", "nb"))))
def cox_loglik(spark, d):
    """Partial log-likelihood and score at given coefficients."""
    df = cut(valid(spark, d).select("survival_time", "survival_event", *PAIR))
    rows = []
    for ties, at, beta in (("breslow", "fixed", FIXED), ("efron", "fixed", FIXED), ("breslow", "zero", dict.fromkeys(FIXED, 0.0))):
        e = CX.evaluate(df, beta, ties=ties)
        rows.append((ties, at, e.rows, e.events, float(e.log_likelihood), *map(float, e.gradient)))
    return rounded(spark.createDataFrame(
        rows, "ties string, at string, rows long, events long, log_likelihood double, score_oltv double, score_dti double"))


FIT3 = f"{SS.SURV}, {SS.scaled_cte(SS.STATIC)},\n{SS.fit_cte('fit', TRIPLE)}"


def fitted(spark, d, cols=TRIPLE):
    df, cached = scaled(spark, d, cols)
    return CX.fit_cox(df, cols), df, cached


@query("cox_fit", FIT3 + "\n" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {r(f'b{i}', 'coef', 8)}, {r(f'sqrt(v{i})', 'std_error', 8)} FROM fit" for i, c in enumerate(TRIPLE)))
def cox_fit(spark, d):
    model, _, cached = fitted(spark, d)
    cached.unpersist()
    se = [float(model.covariance[i, i]) ** 0.5 for i in range(len(TRIPLE))]
    return rounded(spark.createDataFrame(list(zip(model.features, model.beta.values(), se)),
                                         "feature string, coef double, std_error double"), 8)


@query("cox_metrics", FIT3 + f"""\nSELECT 3 AS features, n AS observations, events, {r('ll', 'log_likelihood')}, {r('pll', 'penalized_log_likelihood')},
 {r('-2*pll + 6', 'partial_aic')} FROM fit""")
def cox_metrics(spark, d):
    model, _, cached = fitted(spark, d)
    cached.unpersist()
    return rounded(CX.metrics(model, spark))


@query("hazard_ratios", FIT3 + "\n, h AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, b{i} AS b, 1.959963984540054*sqrt(v{i}) AS w FROM fit" for i, c in enumerate(TRIPLE))
       + f""") SELECT feature, {r('b', 'coef')}, {r('exp(b)', 'hazard_ratio')}, {r('exp(b-w)', 'ci_lower')}, {r('exp(b+w)', 'ci_upper')},
 {r('greatest(exp(b)-exp(b-w), 0)', 'err_low')}, {r('greatest(exp(b+w)-exp(b), 0)', 'err_high')} FROM h ORDER BY b DESC LIMIT 2""")
def hazard_ratios(spark, d):
    model, _, cached = fitted(spark, d)
    cached.unpersist()
    return rounded(model.hazard_ratios(spark, top=2))


BASE = """bg AS (SELECT survival_time AS time, sum(w) AS s, sum(survival_event) AS d FROM scored GROUP BY 1),
 bh AS (SELECT time, d / sum(s) OVER (ORDER BY time DESC) AS hazard FROM bg),
 base AS (SELECT time, hazard, sum(hazard) OVER (ORDER BY time) AS h FROM bh)"""
SCORED3 = FIT3 + ",\nscored AS (SELECT s.*, exp(" + " + ".join(f"b{i}*{c}" for i, c in enumerate(TRIPLE)) + ") AS w FROM std s, fit),\n" + BASE


@query("cox_baseline", SCORED3 + f"\nSELECT time, {r('hazard', 'hazard')}, {r('h', 'cum_hazard')}, {r('exp(-h)', 'survival')} FROM base")
def cox_baseline(spark, d):
    model, df, _ = fitted(spark, d)
    return rounded(model.baseline(df))


@query("cox_survival", SCORED3 + f"""\nSELECT LOAN_ID, time, {r('exp(-h*w)', 'survival_probability')}
 FROM (SELECT * FROM scored ORDER BY LOAN_ID LIMIT 5), base""")
def cox_survival(spark, d):
    """Predicted curves of the first five loans."""
    model, df, _ = fitted(spark, d)
    some = df.orderBy("LOAN_ID").limit(5)
    return rounded(model.survival_curves(some, model.baseline(df)).select("LOAN_ID", "time", "survival_probability"))


SCORED_FIXED = SS.SURV + ",\nscored AS (SELECT *, exp(0.01*OLTV - 0.02*DTI) AS w FROM valid),\n" + BASE


@query("cox_scores", SCORED_FIXED + f"""\nSELECT LOAN_ID, {r('w', 'partial_hazard')}, {r('w*(SELECT max(h) FROM base)', 'expected_cumulative_hazard')},
 {r('(SELECT max(h) FROM base)', 'baseline_cumulative_hazard')}, {r('survival_time - w*(SELECT max(h) FROM base)', 'residual')},
 {r('survival_event - h*w', 'martingale')} FROM scored JOIN base ON survival_time = time""")
def cox_scores(spark, d):
    """Hazard scores and residuals at given coefficients."""
    df = valid(spark, d)
    model = CX.CoxModel(FIXED, None, 0.0, 0, 0, 0.0, "efron")
    return rounded(model.scores(df, model.baseline(df)).select(
        "LOAN_ID", "partial_hazard", "expected_cumulative_hazard", "baseline_cumulative_hazard", "residual", "martingale"))


# --- concordance and comparison ----------------------------------------------

C_COLUMNS = "concordant::double AS concordant, tied::double AS tied, pairs::double AS pairs, cast(0 AS bigint) AS left_out, " + r("(concordant + 0.5*tied) / pairs", "c_index", 9)


@query("c_index", SS.SURV + ",\n" + SS.concordance_cte("c", "OLTV", "valid") + f"\nSELECT {C_COLUMNS} FROM c")
def c_index(spark, d):
    return rounded(CC.concordance(valid(spark, d), "OLTV"), 9)


@query("cox_c_index", SCORED3 + ",\n" + SS.concordance_cte("c", "w", "scored") + f"\nSELECT {r('(concordant + 0.5*tied) / pairs', 'c_index')}, pairs::double AS pairs FROM c")
def cox_c_index(spark, d):
    model, df, cached = fitted(spark, d)
    out = CC.concordance(df.withColumn("risk", model.partial_hazard()), "risk")
    cached.unpersist()
    return rounded(out.select("c_index", "pairs"))


def comparison(spark, d):
    full, df, cached = fitted(spark, d)
    base = CX.fit_cox(df, ["OLTV"])
    rows = [CM.model_row(n, m, CC.c_index(df.withColumn("risk", m.partial_hazard()), "risk"))
            for n, m in (("Base", base), ("Full", full))]
    cached.unpersist()
    return CM.metrics_table(spark, rows)


COMPARE = SCORED3 + ",\n" + ",\n".join([
    SS.fit_cte("one", ["OLTV"]), "scored1 AS (SELECT s.*, exp(b0*OLTV) AS w FROM std s, one)",
    SS.concordance_cte("cf", "w", "scored"), SS.concordance_cte("cb", "w", "scored1"),
    """models AS (SELECT 'Base' AS model, 1 AS features, n AS observations, events, (concordant + 0.5*tied) / pairs AS c_index,
 -2*pll + 2 AS partial_aic, pll AS log_likelihood FROM one, cb UNION ALL
 SELECT 'Full', 3, n, events, (concordant + 0.5*tied) / pairs, -2*pll + 6, pll FROM fit, cf)"""])


@query("model_compare", COMPARE + f"\nSELECT model, features, observations, events, {r('c_index', 'c_index')}, {r('partial_aic', 'partial_aic')},"
       f" {r('log_likelihood', 'log_likelihood')} FROM models")
def model_compare(spark, d):
    return rounded(comparison(spark, d))


@query("lr_test", COMPARE + f"""\n, v AS (SELECT b.c_index - a.c_index AS dc, a.partial_aic - b.partial_aic AS da, 2*(b.log_likelihood - a.log_likelihood) AS lr
 FROM models a, models b WHERE a.model = 'Base' AND b.model = 'Full')
 SELECT {r('dc', 'c_index_gain')}, {r('da', 'aic_gain')}, CASE WHEN dc > 0.01 THEN 'MEANINGFUL' WHEN dc > 0.005 THEN 'MODEST' ELSE 'MINIMAL' END AS c_index_verdict,
 CASE WHEN da > 2 THEN 'SUBSTANTIAL' WHEN da > 0 THEN 'MINOR' ELSE 'NOT JUSTIFIED' END AS aic_verdict, {r('lr', 'lr_statistic')}, 2 AS lr_df,
 {r('exp(-lr/2)', 'p_value')}, exp(-lr/2) < 0.05 AS significant FROM v""")
def lr_test(spark, d):
    return rounded(CM.compare(comparison(spark, d), "Base", "Full"))


@query("macro_effect")
def macro_effect(spark, d):
    """Models with and without the macro components, trained early and tested later."""
    result = run_macro_effect(surv_macro(spark, d), FACTORS, I.SPLIT_DATE)
    held_out = F.create_map(*[x for k, v in result.test_c_index.items() for x in (F.lit(k), F.lit(v))])
    return rounded(result.metrics.withColumn("test_c_index", held_out[F.col("model")]))


# with so few features none is dropped, so SQL can fit both models and score the held-out period
EFFECT2, EFFECT3 = ["OLTV", "ORIG_RATE"], ["OLTV", "ORIG_RATE", "alpha_PC1"]


def _effect_sql() -> str:
    filled = ", ".join(f"coalesce({c}, m_{c}, 0) AS {c}" for c in EFFECT3)
    moments = ", ".join(f"avg({c}) AS a_{c}, stddev_pop({c}) AS s_{c}" for c in EFFECT3)
    z = ", ".join(f"({c} - a_{c}) / s_{c} AS {c}" for c in EFFECT3)
    ctes = [SS.SURV_MACRO + f", me_known AS (SELECT *, macro_quarter <= DATE '{I.SPLIT_DATE}' AS early FROM valid WHERE macro_quarter IS NOT NULL)",
            "me_med AS (SELECT " + ", ".join(f"median({c}) AS m_{c}" for c in EFFECT3) + " FROM me_known WHERE early)",
            f"me_filled AS (SELECT LOAN_ID, survival_time, survival_event, early, {filled} FROM me_known, me_med)",
            f"me_mom AS (SELECT {moments} FROM me_filled WHERE early)",
            f"me_scaled AS (SELECT LOAN_ID, survival_time, survival_event, early, {z} FROM me_filled, me_mom)",
            "std AS (SELECT * FROM me_scaled WHERE early)"]
    rows = []
    for name, model, cols in (("Non-Macro", "two", EFFECT2), ("Full", "three", EFFECT3)):
        w = " + ".join(f"b{i}*{c}" for i, c in enumerate(cols))
        ctes += [SS.fit_cte(model, cols), f"w_{model} AS (SELECT s.*, exp({w}) AS w FROM me_scaled s, {model})"]
        for part in ("early", "NOT early"):
            ctes += [f"{model}_{part[:3].strip()} AS (SELECT * FROM w_{model} WHERE {part})",
                     SS.concordance_cte(f"c_{model}_{part[:3].strip()}", "w", f"{model}_{part[:3].strip()}")]
        rate = "(concordant + 0.5*tied) / pairs"
        rows.append(f"""SELECT '{name}' AS model, {len(cols)} AS features, n AS observations, events, (SELECT {r(rate, 'x')[:-5]} FROM c_{model}_ear) AS c_index,
 {r(f'-2*pll + {2 * len(cols)}', 'partial_aic')}, {r('pll', 'log_likelihood')}, (SELECT {r(rate, 'x')[:-5]} FROM c_{model}_NOT) AS test_c_index FROM {model}""")
    return ",\n".join(ctes) + "\n" + " UNION ALL ".join(rows)


@query("macro_effect_few", _effect_sql())
def macro_effect_few(spark, d):
    """The whole comparison over three features: medians, scaling, both fits, concordance on both periods."""
    df = surv_macro(spark, d, EFFECT3).select("LOAN_ID", "survival_time", "survival_event", "macro_quarter", *EFFECT3)
    result = run_macro_effect(df, ["alpha_PC1"], I.SPLIT_DATE)
    held_out = F.create_map(*[x for k, v in result.test_c_index.items() for x in (F.lit(k), F.lit(v))])
    return rounded(result.metrics.withColumn("test_c_index", held_out[F.col("model")]))


# --- many distinct times -------------------------------------------------------

# days from a fixed date to the order, with hundredths: nearly as many times as rows
DAYS = """WITH days AS (SELECT o_orderkey AS LOAN_ID,
 date_diff('day', DATE '1990-01-01', cast(o_orderdate AS date)) + (o_custkey % 100) / 1e2 AS survival_time,
 cast(o_orderstatus = 'F' AS int) AS survival_event, cast(50 + o_custkey % 50 AS double) AS OLTV,
 cast(10 + o_custkey % 41 AS double) AS DTI FROM orders)"""


def days(spark, d):
    return I.table(spark, d, "orders").selectExpr(
        "o_orderkey AS LOAN_ID", "datediff(cast(o_orderdate AS date), DATE '1990-01-01') + (o_custkey % 100) / 1e2 AS survival_time",
        "cast(o_orderstatus = 'F' AS int) AS survival_event", "cast(50 + o_custkey % 50 AS double) AS OLTV",
        "cast(10 + o_custkey % 41 AS double) AS DTI")


@query("risk_table_days", DAYS + ", " + RISK.format(src="days") + " SELECT * FROM risk")
def risk_table_days(spark, d):
    return T.risk_table(days(spark, d))


@query("nelson_aalen_days", DAYS + ", " + RISK.format(src="days") + ", " + HAZARD + f" SELECT time, at_risk, events, {LIMITS} FROM cum")
def nelson_aalen_days(spark, d):
    return rounded(T.nelson_aalen(T.risk_table(days(spark, d))))


@query("cox_loglik_days", DAYS + f", {FIXED_CTE},\n{SS.evaluate_cte('ee', 'fixed', PAIR, 'days', 'efron')}\n"
       f"SELECT n AS rows, events, {r('ll', 'log_likelihood', 4)}, {r('g0', 'score_oltv', 4)}, {r('g1', 'score_dti', 4)} FROM ee")
def cox_loglik_days(spark, d):
    e = CX.evaluate(days(spark, d), FIXED)
    return rounded(spark.createDataFrame([(e.rows, e.events, float(e.log_likelihood), *map(float, e.gradient))],
                                         "rows long, events long, log_likelihood double, score_oltv double, score_dti double"), 4)


@query("c_index_days", DAYS + ",\n" + SS.concordance_cte("c", "OLTV", "days") + f"\nSELECT {C_COLUMNS} FROM c")
def c_index_days(spark, d):
    return rounded(CC.concordance(days(spark, d), "OLTV"), 9)


MACRO3 = ["OLTV", "alpha_PC1", "beta_PC1"]


@query("hazard_ratios_macro", SS.SURV_MACRO + ",\nknown AS (SELECT * FROM valid WHERE alpha_PC1 IS NOT NULL AND beta_PC1 IS NOT NULL),\n"
       + f"{SS.scaled_cte(MACRO3, 'known')},\n{SS.fit_cte('fit', MACRO3)}\n" + " UNION ALL ".join(
           f"SELECT '{c}' AS feature, {r(f'b{i}', 'coef', 6)}, {r(f'exp(b{i})', 'hazard_ratio', 6)},"
           f" {r(f'exp(b{i} - 1.959963984540054*sqrt(v{i}))', 'ci_lower', 6)}, {r(f'exp(b{i} + 1.959963984540054*sqrt(v{i}))', 'ci_upper', 6)} FROM fit"
           for i, c in enumerate(MACRO3) if i))
def hazard_ratios_macro(spark, d):
    """Hazard ratios of the macro features of a model that has others too."""
    df = FE.valid_survival(surv_macro(spark, d)).where("alpha_PC1 IS NOT NULL AND beta_PC1 IS NOT NULL")
    df = cut(df.select("LOAN_ID", "survival_time", "survival_event", *MACRO3))
    df = FE.Scaler.fit(df, MACRO3).transform(df)
    model = CX.fit_cox(df, MACRO3)
    return rounded(model.hazard_ratios(spark, only=FACTORS).select("feature", "coef", "hazard_ratio", "ci_lower", "ci_upper"), 6)


@query("cox_fallback", f"{SS.SURV}, {SS.scaled_cte(['OLTV'])},\n{SS.fit_cte('fit', ['OLTV'], penalizer=0.0)}\n"
       f"SELECT 'OLTV' AS feature, {r('b0', 'coef')}, 3 AS attempt, 0e0 AS penalizer FROM fit")
def cox_fallback(spark, d):
    """Without a penalty, a repeated feature makes the information singular: fewer features are left."""
    df, cached = scaled(spark, d, ["OLTV"])
    model = CX.fit_cox_with_fallback(df.withColumn("again", F.col("OLTV")), ["OLTV", "again"], penalizer=0.0, minimal=1)
    cached.unpersist()
    return rounded(spark.createDataFrame([(c, b, model.attempt, model.penalizer) for c, b in model.beta.items()],
                                         "feature string, coef double, attempt int, penalizer double"))


# --- forest -----------------------------------------------------------------

def forest(spark, d):
    df = cut(valid(spark, d).select("LOAN_ID", "survival_time", "survival_event", *SS.STATIC))
    return FO.fit_forest(df, SS.STATIC), df


@query("rsf_bootstrap", SS.SURV + ", " + SS.bootstrap_cte(FO.ForestParams()) + " SELECT * FROM drawn")
def rsf_bootstrap(spark, d):
    """How often every tree draws every loan; loans not drawn are left out."""
    rows = valid(spark, d).select(F.col("LOAN_ID").alias("key"))
    return FO.bootstrap(rows, FO.ForestParams()).select(F.col("key").alias("LOAN_ID"), "tree", "w")


@query("rsf_fit")
def rsf_fit(spark, d):
    """Splits of the fitted forest, one row per inner node."""
    model, _ = forest(spark, d)
    return spark.createDataFrame(model.splits, "tree int, node int, feature int, cut double")


@query("rsf_score")
def rsf_score(spark, d):
    model, df = forest(spark, d)
    return rounded(model.score(df).select("LOAN_ID", "risk"))


@query("rsf_c_index")
def rsf_c_index(spark, d):
    model, df = forest(spark, d)
    return CC.concordance(model.score(df), "risk")


@query("rsf_avg_cumhaz")
def rsf_avg_cumhaz(spark, d):
    """Average predicted survival over all loans and its cumulative hazard."""
    model, df = forest(spark, d)
    return rounded(model.average_curve(df))


@query("rsf_curves")
def rsf_curves(spark, d):
    """Predicted curves of the first five loans."""
    model, df = forest(spark, d)
    return rounded(model.survival_curves(df.orderBy("LOAN_ID").limit(5), "LOAN_ID"))


# a forest of three trees and two levels is small enough to be grown in SQL as well
FEW = FO.ForestParams(trees=3, max_depth=2, sample=0.6, bins=32)


def few_trees(spark, d):
    df = cut(valid(spark, d).select("LOAN_ID", "survival_time", "survival_event", *SS.STATIC))
    model = FO.fit_forest(df, SS.STATIC, params=FEW)
    return model, df


FEW_SQL = SS.SURV + SS.forest_cte(FEW, SS.STATIC)


@query("rsf_few_splits", FEW_SQL + " SELECT tree, node, feature, bin FROM splits")
def rsf_few_splits(spark, d):
    """Log-rank splits of the first two levels."""
    model, _ = few_trees(spark, d)
    return spark.createDataFrame(model.splits.rename(columns={"cut": "bin"}).astype(int), "tree int, node int, feature int, bin int")


@query("rsf_few_score", FEW_SQL + f" SELECT LOAN_ID, {r('risk', 'risk')} FROM score")
def rsf_few_score(spark, d):
    model, df = few_trees(spark, d)
    return rounded(model.score(df).select("LOAN_ID", "risk"))


@query("rsf_few_curve", FEW_SQL + f" SELECT time, {r('s', 'survival')}, {r('-ln(s + 1e-9)', 'cum_hazard')} FROM curve")
def rsf_few_curve(spark, d):
    model, df = few_trees(spark, d)
    return rounded(model.average_curve(df))


@query("rsf_few_c_index", FEW_SQL + ", scored AS (SELECT v.*, round(s.risk, 9) AS risk FROM valid v JOIN score s USING (LOAN_ID)),\n"
       + SS.concordance_cte("c", "risk", "scored") + f"\nSELECT {C_COLUMNS} FROM c")
def rsf_few_c_index(spark, d):
    model, df = few_trees(spark, d)
    return rounded(CC.concordance(model.score(df).withColumn("risk", F.round("risk", 9)), "risk"), 9)


@query("rsf_few_risk_hist", FEW_SQL + f""", b AS (SELECT min(risk) AS lo, CASE WHEN max(risk) = min(risk) THEN 1 ELSE max(risk) - min(risk) END AS span FROM score),
 g AS (SELECT least(floor((risk - lo) * 30 / span), 29)::int AS bin, count(*) AS n FROM score, b GROUP BY 1)
 SELECT i::int AS bin, coalesce(n, 0)::bigint AS count FROM range(30) t(i) LEFT JOIN g ON g.bin = i""")
def rsf_few_risk_hist(spark, d):
    """Histogram of a forest's scores."""
    model, df = few_trees(spark, d)
    return FO.risk_histogram(model.score(df)).select("bin", "count")


def forest_pair(spark, d):
    return run_forest_effect(surv_macro(spark, d), FACTORS, I.SPLIT_DATE)


@query("rsf_macro_effect")
def rsf_macro_effect(spark, d):
    """Forests with and without the macro components: concordance before and after the split."""
    return rounded(forest_pair(spark, d).c_index)


@query("rsf_avg_cumhaz_split")
def rsf_avg_cumhaz_split(spark, d):
    """The full forest's average curves on both periods."""
    return rounded(forest_pair(spark, d).curves)


def _risk_hist_sql():
    from verification.queries_explore import histogram_sql
    return SCORED_FIXED + ",\n" + histogram_sql("scored", "w")


@query("risk_hist", _risk_hist_sql())
def risk_hist(spark, d):
    """Histogram of a risk score (here the partial hazard at given coefficients)."""
    score = F.exp(0.01 * F.col("OLTV") - 0.02 * F.col("DTI"))
    return rounded(FO.risk_histogram(valid(spark, d).withColumn("risk", score)))
