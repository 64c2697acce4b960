"""The complete longitudinal analysis as named result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from loanpanel.operators import cycles as CY
from loanpanel.operators import delinquency as D
from loanpanel.operators import overview as O
from loanpanel.operators import sampling as SA
from loanpanel.operators import variation as V


def longitudinal_analysis(panel: DataFrame, target: int | None = 75_000,
                          seed: int = 42) -> dict[str, DataFrame]:
    """All panel tables, lazily, over a balanced loan sample (or all loans with no target).

    Write the panel to Parquet first, or cache it: every table reads it on its own.
    """
    if target is not None:
        panel = SA.full_history(panel, SA.balanced_sample(panel, target, seed))
    summary = O.loan_summary(panel)
    out = {
        "loan_summary": summary,
        "panel_overview": O.panel_overview(panel),
        "panel_balance": O.panel_balance(panel),
        "event_transitions": O.event_transitions(panel),
        "quarterly_delinquency": D.quarterly_delinquency(panel),
        "first_delinquency": D.first_delinquency_histogram(panel),
        "naive_survival": D.naive_survival(panel),
        "transition_matrix": D.transition_matrix(panel),
        "by_age": D.by_age(panel),
        "balance_by_age_and_status": D.balance_by_age_and_status(panel),
        "panel_length": V.panel_length_histogram(panel),
        "within_loan_std": V.mean_within_std(panel),
        "event_complexity": O.event_complexity(panel),
        "score_by_outcome": V.density_by_outcome(summary, "CSCORE_B"),
        "score_change_by_outcome": V.density_by_outcome(summary, "credit_score_change_mean"),
        "delinquency_by_length": V.delinquency_by_length(summary),
        "top_states": V.top_states(summary),
        "correlation": V.overall_correlation(panel),
        "correlation_difference": V.correlation_difference(panel),
        "exit_analysis": D.exit_analysis(panel),
        "gap_summary": D.gap_summary(panel),
        "modal_length": O.modal_length(panel),
        "describe_static": V.describe_static(panel),
        "describe_varying": V.describe_varying(panel),
        "describe_within": V.describe_within(panel),
        "delinquency_rates": O.delinquency_rates(panel),
        "key_insights": O.key_insights(panel),
        "missing_profile": O.missing_profile(panel),
    }
    factors = CY.factor_columns(panel)
    if factors:
        out["quarterly_factors"] = CY.quarterly_factors(panel, factors)
        out["delinquency_by_decile"] = CY.delinquency_by_decile(panel, CY.stress_factor(factors))
    if "housing_market_PC1" in factors:
        out["housing"] = CY.factor_and_delinquency(panel, "housing_market_PC1")
    if "credit_markets_PC1" in factors:
        out["credit"] = CY.factor_impact(panel, "credit_markets_PC1")
    return out
