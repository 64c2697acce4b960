"""Status codes, event flag and tier labels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loanpanel import schemas as S


def default_event(status: Column, zero_balance: Column) -> Column:
    """1 when 90+ days late or closed by a credit event, else 0 (never null)."""
    late = (status != S.UNKNOWN_STATUS) & (status.try_cast("int") >= 3)
    credit = zero_balance.isin(S.DEFAULT_ZERO_BALANCE_CODES)
    return F.when(late | credit, 1).otherwise(0)


def dlq_severity(status: Column) -> Column:
    """Severity label.  Cleaning writes 'Missing' for absent codes, which counts as absent."""
    label = F.when(status.isNull() | status.isin("", S.MISSING), S.MISSING)
    for name, codes in S.SEVERITY_CODES.items():
        label = label.when(status.isin(codes), name)
    return label.otherwise("Other")


def any_delinquent(status: Column) -> Column:
    """Membership flag; an absent status stays null."""
    return status.isin(S.ANY_DELINQUENT_CODES).cast("tinyint")


def serious_delinquent(status: Column) -> Column:
    return status.isin(S.SERIOUS_DELINQUENT_CODES).cast("tinyint")


def balance_ratio(current: Column, original: Column) -> Column:
    """current / max(original, 1), null if either side is null (``greatest`` would skip nulls)."""
    return current / F.when(original < 1, 1.0).otherwise(original)


def _tier(c: Column, cuts, top: str) -> Column:
    bound, name = cuts[0]
    label = F.when(c < bound, name)
    for bound, name in cuts[1:]:
        label = label.when(c < bound, name)
    return label.otherwise(top)


def credit_tier(score: Column) -> Column:
    return _tier(score, S.CREDIT_TIERS, S.CREDIT_TIER_TOP)


def ltv_tier(ltv: Column) -> Column:
    return _tier(ltv, S.LTV_TIERS, S.LTV_TIER_TOP)


def geo_tier(state: Column) -> Column:
    return (F.when(state.isin(S.MAJOR_STATES), "Major")
            .when(state.isin(S.LARGE_STATES), "Large").otherwise("Other"))
