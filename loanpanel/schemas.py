"""Table contracts: column lists, code lists and the macro series domains.

Everything in this module is a fixed value of the data model.  The lists are
needed verbatim because the raw file has no header and codes are matched by text.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: raw file layout (110 positional fields) -----------------
RAW_COLUMNS = [
    "POOL_ID", "LOAN_ID", "ACT_PERIOD", "CHANNEL", "SELLER", "SERVICER",
    "MASTER_SERVICER", "ORIG_RATE", "CURR_RATE", "ORIG_UPB", "ISSUANCE_UPB",
    "CURRENT_UPB", "ORIG_TERM", "ORIG_DATE", "FIRST_PAY", "LOAN_AGE",
    "REM_MONTHS", "ADJ_REM_MONTHS", "MATR_DT", "OLTV", "OCLTV",
    "NUM_BO", "DTI", "CSCORE_B", "CSCORE_C", "FIRST_FLAG", "PURPOSE",
    "PROP", "NO_UNITS", "OCC_STAT", "STATE", "MSA", "ZIP", "MI_PCT",
    "PRODUCT", "PPMT_FLG", "IO", "FIRST_PAY_IO", "MNTHS_TO_AMTZ_IO",
    "DLQ_STATUS", "PMT_HISTORY", "MOD_FLAG", "MI_CANCEL_FLAG", "Zero_Bal_Code",
    "ZB_DTE", "LAST_UPB", "RPRCH_DTE", "CURR_SCHD_PRNCPL", "TOT_SCHD_PRNCPL",
    "UNSCHD_PRNCPL_CURR", "LAST_PAID_INSTALLMENT_DATE", "FORECLOSURE_DATE",
    "DISPOSITION_DATE", "FORECLOSURE_COSTS", "PROPERTY_PRESERVATION_AND_REPAIR_COSTS",
    "ASSET_RECOVERY_COSTS", "MISCELLANEOUS_HOLDING_EXPENSES_AND_CREDITS",
    "ASSOCIATED_TAXES_FOR_HOLDING_PROPERTY", "NET_SALES_PROCEEDS",
    "CREDIT_ENHANCEMENT_PROCEEDS", "REPURCHASES_MAKE_WHOLE_PROCEEDS",
    "OTHER_FORECLOSURE_PROCEEDS", "NON_INTEREST_BEARING_UPB",
    "PRINCIPAL_FORGIVENESS_AMOUNT", "ORIGINAL_LIST_START_DATE",
    "ORIGINAL_LIST_PRICE", "CURRENT_LIST_START_DATE", "CURRENT_LIST_PRICE",
    "ISSUE_SCOREB", "ISSUE_SCOREC", "CURR_SCOREB", "CURR_SCOREC", "MI_TYPE",
    "SERV_IND", "CURRENT_PERIOD_MODIFICATION_LOSS_AMOUNT",
    "CUMULATIVE_MODIFICATION_LOSS_AMOUNT",
    "CURRENT_PERIOD_CREDIT_EVENT_NET_GAIN_OR_LOSS",
    "CUMULATIVE_CREDIT_EVENT_NET_GAIN_OR_LOSS", "HOMEREADY_PROGRAM_INDICATOR",
    "FORECLOSURE_PRINCIPAL_WRITE_OFF_AMOUNT", "RELOCATION_MORTGAGE_INDICATOR",
    "ZERO_BALANCE_CODE_CHANGE_DATE", "LOAN_HOLDBACK_INDICATOR",
    "LOAN_HOLDBACK_EFFECTIVE_DATE", "DELINQUENT_ACCRUED_INTEREST",
    "PROPERTY_INSPECTION_WAIVER_INDICATOR", "HIGH_BALANCE_LOAN_INDICATOR",
    "ARM_5_YR_INDICATOR", "ARM_PRODUCT_TYPE", "MONTHS_UNTIL_FIRST_PAYMENT_RESET",
    "MONTHS_BETWEEN_SUBSEQUENT_PAYMENT_RESET", "INTEREST_RATE_CHANGE_DATE",
    "PAYMENT_CHANGE_DATE", "ARM_INDEX", "ARM_CAP_STRUCTURE",
    "INITIAL_INTEREST_RATE_CAP", "PERIODIC_INTEREST_RATE_CAP",
    "LIFETIME_INTEREST_RATE_CAP", "MARGIN", "BALLOON_INDICATOR", "PLAN_NUMBER",
    "FORBEARANCE_INDICATOR", "HIGH_LOAN_TO_VALUE_HLTV_REFINANCE_OPTION_INDICATOR",
    "DEAL_NAME", "RE_PROCS_FLAG", "ADR_TYPE", "ADR_COUNT", "ADR_UPB",
    "PAYMENT_DEFERRAL_MOD_EVENT_FLAG", "INTEREST_BEARING_UPB",
]

# --- fixed values: the 43 columns kept by cleaning, by kind ----------------
CLEAN_COLUMNS = [
    "LOAN_ID", "ACT_PERIOD", "ORIG_DATE", "FIRST_PAY", "LOAN_AGE", "DLQ_STATUS",
    "Zero_Bal_Code", "ZB_DTE", "FORECLOSURE_DATE", "DISPOSITION_DATE",
    "CSCORE_B", "CSCORE_C", "DTI", "NUM_BO", "ORIG_RATE", "CURR_RATE",
    "ORIG_UPB", "CURRENT_UPB", "ORIG_TERM", "OLTV", "OCLTV", "PURPOSE",
    "FORBEARANCE_INDICATOR", "STATE", "MSA", "ZIP", "PROP", "OCC_STAT",
    "MI_PCT", "PPMT_FLG", "MOD_FLAG", "PMT_HISTORY", "PRODUCT", "CHANNEL",
    "FIRST_FLAG", "SELLER", "SERVICER", "NO_UNITS", "CURR_SCOREB", "CURR_SCOREC",
    "SERV_IND", "REM_MONTHS", "MATR_DT",
]
DATE_COLUMNS = [
    "ORIG_DATE", "FIRST_PAY", "ZB_DTE", "FORECLOSURE_DATE", "DISPOSITION_DATE", "MATR_DT",
]
CATEGORICAL_COLUMNS = [
    "DLQ_STATUS", "Zero_Bal_Code", "PURPOSE", "FORBEARANCE_INDICATOR", "STATE", "MSA", "ZIP",
    "PROP", "OCC_STAT", "PPMT_FLG", "MOD_FLAG", "PMT_HISTORY", "PRODUCT", "CHANNEL",
    "FIRST_FLAG", "SELLER", "SERVICER", "SERV_IND",
]
NUMERIC_COLUMNS = [
    "LOAN_AGE", "CSCORE_B", "CSCORE_C", "DTI", "NUM_BO", "ORIG_RATE", "CURR_RATE",
    "ORIG_UPB", "CURRENT_UPB", "ORIG_TERM", "OLTV", "OCLTV", "MI_PCT", "NO_UNITS",
    "CURR_SCOREB", "CURR_SCOREC", "REM_MONTHS",
]

# --- fixed values: derived table layouts -----------------------------------
TIME_VARYING_COLUMNS = [
    "LOAN_ID", "time", "event", "dlq_severity", "any_delinquent", "serious_delinquent",
    "balance_ratio", "rate_change", "credit_score_change", "dlq_status_original",
    "data_quarter",
]
STATIC_COLUMNS = [
    "LOAN_ID", "ORIG_DATE", "FIRST_PAY", "CSCORE_B", "CSCORE_C", "DTI", "NUM_BO",
    "ORIG_RATE", "ORIG_UPB", "ORIG_TERM", "OLTV", "OCLTV", "MI_PCT", "PURPOSE", "STATE",
    "MSA", "ZIP", "PROP", "OCC_STAT", "NO_UNITS", "PRODUCT", "CHANNEL", "FIRST_FLAG",
    "SELLER", "SERVICER",
]

# --- fixed values: code lists ----------------------------------------------
MISSING = "Missing"
UNKNOWN_STATUS = "XX"
DEFAULT_ZERO_BALANCE_CODES = ["03", "09", "15", "97", "98"]
ANY_DELINQUENT_CODES = ["01", "02", "03", "04", "05", "06", "07", "08", "09", "99"]
SERIOUS_DELINQUENT_CODES = ["03", "04", "05", "06", "07", "08", "09", "99"]
SEVERITY_CODES = {
    "Unknown": ["XX"],
    "Current": ["00"],
    "Early_DLQ": ["01", "02"],
    "Serious_DLQ": ["03", "04", "05"],
    "Severe_DLQ": ["06", "07", "08", "09"],
    "Extreme_DLQ": ["99"],
}
SUMMARY_STATUS_CODES = ["00", "01", "02", "03", "XX"]
MAJOR_STATES = ["CA", "NY", "FL", "TX"]
LARGE_STATES = ["WA", "OR", "NV", "AZ", "CO", "IL", "MI", "OH", "PA", "NJ", "VA", "NC", "GA"]
CREDIT_TIERS = [(620, "VeryLow"), (680, "Low"), (740, "Mid"), (800, "High")]
CREDIT_TIER_TOP = "VeryHigh"
LTV_TIERS = [(70, "LowLTV"), (85, "MidLTV")]
LTV_TIER_TOP = "HighLTV"

# --- fixed values: macro series by domain ----------------------------------
MACRO_DOMAINS = {
    "interest_rates": ["DGS3MO", "DGS2", "DGS10", "DFF", "MORTGAGE30US"],
    "credit_markets": ["DAAA", "DBAA", "BAMLH0A0HYM2"],
    "labor_market": ["UNRATE", "PAYEMS", "AHETPI", "CIVPART"],
    "inflation": ["CPIAUCSL", "CPILFESL", "PCEPI", "DFEDTARU"],
    "economic_activity": ["GDPC1", "INDPRO", "RRSFS", "DSPIC96", "PSAVERT"],
    "housing_market": ["CSUSHPISA", "COMPUTSA", "HOUST"],
    "financial_stress": ["NFCI", "STLFSI4"],
    "market_sentiment": ["VIXCLS", "NASDAQCOM", "DEXUSEU"],
}
MACRO_NAME_KEYWORDS = [
    "rates_PC", "employment_PC", "inflation_PC", "activity_PC", "housing_PC",
    "sentiment_PC", "UNRATE", "FEDFUNDS", "GS10", "CFNAI", "yield_spread",
    "unemployment_regime", "interest_rate_regime", "yield_curve_regime",
    "economic_stress", "yield_curve_inversion", "macro_quarter",
]

# --- fixed values: name fragments never used as model features -------------
NON_FEATURE_PATTERNS = [
    "LOAN_ID", "Zero_Bal_Code", "quarter", "orig_year", "default_events", "stage2_event",
    "time_to_default_raw", "stage2_survival_time", "stage2_survival_event", "ifrs9_stage",
    "default_12m", "stage2_12m", "ORIG_DATE", "FORECLOSURE_DATE", "MATR_DT",
    "default_event", "ever_default_dlq", "first_default_age_dlq", "ever_stage2",
    "first_stage2_age", "ever_default_zb", "last_observed_age",
]

RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in RAW_COLUMNS])
MACRO_RESPONSE_SCHEMA = T.StructType([
    T.StructField("observations", T.ArrayType(T.StructType([
        T.StructField("date", T.StringType()),
        T.StructField("value", T.StringType()),
    ]))),
])
