"""Common table expressions of the DuckDB side (see FIXTURES.md for the projections)."""

LOAN_OBS = """loan_obs AS (
SELECT cast(l_orderkey as varchar) AS LOAN_ID, cast(o_orderdate as date) AS ORIG_DATE,
 cast(l_linenumber - 2 as double) AS LOAN_AGE,
 CASE WHEN l_quantity >= 49.5 THEN NULL WHEN l_quantity >= 48.5 THEN 'XX' WHEN l_quantity >= 47.5 THEN '99'
      WHEN l_returnflag = 'R' THEN lpad(cast(cast(l_quantity as int) % 13 as varchar), 2, '0') ELSE '00' END AS DLQ_STATUS,
 CASE WHEN l_tax >= 0.075 THEN '09' WHEN l_tax >= 0.065 THEN '01' END AS Zero_Bal_Code,
 o_totalprice AS ORIG_UPB, l_extendedprice AS CURRENT_UPB,
 2e0 + cast(o_custkey % 30 as double) / 10e0 AS ORIG_RATE,
 2e0 + cast(o_custkey % 30 as double) / 10e0 + (l_discount - 5e-2) * 10e0 AS CURR_RATE,
 CASE WHEN o_custkey % 20 = 0 THEN NULL ELSE cast(580 + floor((c_acctbal + 1000e0) / 45e0) as double) END AS CSCORE_B,
 CASE WHEN o_custkey % 20 = 0 THEN NULL ELSE cast(580 + floor((c_acctbal + 1000e0) / 45e0) as double) + 25e0 - l_quantity END AS CURR_SCOREB,
 cast(50 + o_custkey % 50 as double) AS OLTV, cast(10 + o_custkey % 41 as double) AS DTI,
 substring('CANYFLTXWAORNVAZCOILMIOHPANJVANCGAMNMAWIMOTNIDUTKS', 1 + 2 * c_nationkey, 2) AS STATE,
 CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'P' WHEN '2' THEN 'C' WHEN '3' THEN 'R' WHEN '4' THEN 'U' END AS PURPOSE,
 substring(c_mktsegment, 1, 2) AS PROP,
 concat(cast(year(l_shipdate) as varchar), 'Q', cast(quarter(l_shipdate) as varchar)) AS data_quarter,
 l_shipdate AS seq1, l_partkey AS seq2, l_suppkey AS seq3
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""

EVENT = """CASE WHEN (DLQ_STATUS IS NOT NULL AND DLQ_STATUS <> 'XX' AND try_cast(DLQ_STATUS AS int) >= 3)
 OR Zero_Bal_Code IN ('03','09','15','97','98') THEN 1 ELSE 0 END"""
SEVERITY = """CASE WHEN DLQ_STATUS IS NULL OR DLQ_STATUS IN ('', 'Missing') THEN 'Missing' WHEN DLQ_STATUS = 'XX' THEN 'Unknown'
 WHEN DLQ_STATUS = '00' THEN 'Current' WHEN DLQ_STATUS IN ('01','02') THEN 'Early_DLQ'
 WHEN DLQ_STATUS IN ('03','04','05') THEN 'Serious_DLQ' WHEN DLQ_STATUS IN ('06','07','08','09') THEN 'Severe_DLQ'
 WHEN DLQ_STATUS = '99' THEN 'Extreme_DLQ' ELSE 'Other' END"""
ANY_DLQ = "cast(DLQ_STATUS IN ('01','02','03','04','05','06','07','08','09','99') AS tinyint)"
SERIOUS_DLQ = "cast(DLQ_STATUS IN ('03','04','05','06','07','08','09','99') AS tinyint)"
BALANCE = "CURRENT_UPB / CASE WHEN ORIG_UPB < 1 THEN 1 ELSE ORIG_UPB END"

ENCODE = f"""LOAN_ID, LOAN_AGE AS time, {EVENT} AS event, {SEVERITY} AS dlq_severity,
 {ANY_DLQ} AS any_delinquent, {SERIOUS_DLQ} AS serious_delinquent, {BALANCE} AS balance_ratio,
 CURR_RATE - ORIG_RATE AS rate_change, CURR_SCOREB - CSCORE_B AS credit_score_change,
 DLQ_STATUS AS dlq_status_original, data_quarter"""


def _deduped(name: str, keys: str) -> str:
    return f"""{name} AS (SELECT {ENCODE},
 ORIG_DATE, CSCORE_B, DTI, ORIG_RATE, ORIG_UPB, OLTV, PURPOSE, STATE, PROP
 FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY seq1 DESC, seq2 DESC, seq3 DESC) AS rn
       FROM loan_obs WHERE LOAN_AGE >= 0) WHERE rn = 1)"""


OBS = f"WITH {LOAN_OBS}\n"
TV = f"WITH {LOAN_OBS}, {_deduped('tv', 'LOAN_ID, LOAN_AGE, data_quarter')}\n"
PANEL_CTE = f"{LOAN_OBS}, {_deduped('panel', 'LOAN_ID, LOAN_AGE')}"
PANEL = f"WITH {PANEL_CTE}\n"

TV_COLUMNS = """LOAN_ID, time, event, dlq_severity, any_delinquent, serious_delinquent,
 round(balance_ratio, 6) + 0e0 AS balance_ratio, round(rate_change, 6) + 0e0 AS rate_change,
 credit_score_change, dlq_status_original, data_quarter"""

MACRO_OBS = """macro_obs AS (
SELECT concat('S', substring(o_orderpriority, 1, 1)) AS series_id, cast(o_orderdate as date) AS date,
 CASE WHEN (month(o_orderdate) + year(o_orderdate) + cast(substring(o_orderpriority, 1, 1) as int)) % 11 = 0 THEN '.'
      ELSE cast(cast(floor(o_totalprice) as bigint) as varchar) END AS value
FROM orders)"""
SERIES = ["S1", "S2", "S3", "S4", "S5"]


def _fill(s: str) -> str:
    return (f"coalesce(last_value({s} IGNORE NULLS) OVER (ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),"
            f" first_value({s} IGNORE NULLS) OVER (ORDER BY month ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS {s}")


MONTHLY = """monthly AS (SELECT series_id, cast(date_trunc('month', date) AS date) AS month, avg(cast(value AS double)) AS value
 FROM macro_obs WHERE value IS NOT NULL AND value <> '.' GROUP BY 1, 2)"""
WIDE = ("wide AS (SELECT month, strftime(month, '%m%Y') AS act_period, "
        + ", ".join(f"max(CASE WHEN series_id = '{s}' THEN value END) AS {s}" for s in SERIES)
        + " FROM monthly GROUP BY month)")
FILLED = "filled AS (SELECT month, act_period, " + ", ".join(map(_fill, SERIES)) + " FROM wide)"
SCALED = ("scaled AS (SELECT month, act_period, "
          + ", ".join(f"({s} - avg({s}) OVER ()) / stddev_pop({s}) OVER () AS {s}" for s in SERIES)
          + " FROM filled)")
# closed forms: eigenvalues 1 +- |r| for two series; for three the trigonometric solution of
# the characteristic cubic, eigenvectors as (A - lambda I) null vectors, largest loading positive
COMPONENTS = """
cor AS (SELECT avg(S1 * S2) AS r, avg(S3 * S4) AS a, avg(S3 * S5) AS b, avg(S4 * S5) AS c FROM scaled),
ang AS (SELECT *, sqrt((a*a + b*b + c*c) / 3) AS p, acos(least(1, greatest(-1, a*b*c / power((a*a + b*b + c*c) / 3, 1.5)))) / 3 AS phi FROM cor),
lam AS (SELECT *, 1 + 2*p*cos(phi) AS l1, 1 + 2*p*cos(phi + 4*pi()/3) AS l2 FROM ang),
vec AS (SELECT r, l1, l2, a*c - b*(1-l1) AS x1, a*b - c*(1-l1) AS y1, (1-l1)*(1-l1) - a*a AS z1,
               a*c - b*(1-l2) AS x2, a*b - c*(1-l2) AS y2, (1-l2)*(1-l2) - a*a AS z2 FROM lam),
nrm AS (SELECT *, sqrt(x1*x1 + y1*y1 + z1*z1) * CASE greatest(abs(x1), abs(y1), abs(z1)) WHEN abs(x1) THEN sign(x1) WHEN abs(y1) THEN sign(y1) ELSE sign(z1) END AS n1,
               sqrt(x2*x2 + y2*y2 + z2*z2) * CASE greatest(abs(x2), abs(y2), abs(z2)) WHEN abs(x2) THEN sign(x2) WHEN abs(y2) THEN sign(y2) ELSE sign(z2) END AS n2 FROM vec),
pcs AS (SELECT act_period, month,
               (S1 + sign(r) * S2) / sqrt(2) AS alpha_PC1, (S1 - sign(r) * S2) / sqrt(2) AS alpha_PC2,
               (S3*x1 + S4*y1 + S5*z1) / n1 AS beta_PC1, (S3*x2 + S4*y2 + S5*z2) / n2 AS beta_PC2
        FROM scaled, nrm)"""
MACRO_CTE = ",\n".join([MACRO_OBS, MONTHLY, WIDE, FILLED, SCALED, COMPONENTS])
MACRO = f"WITH {MACRO_CTE}\n"
ACT_PERIOD = ("strftime(ORIG_DATE + cast(trunc((time + 1) * 30.44) AS int), '%m%Y')")
PANEL_MACRO_CTE = f"""{PANEL_CTE},
{MACRO_CTE},
panel_macro AS (SELECT q.*, alpha_PC1, alpha_PC2, beta_PC1, beta_PC2
 FROM (SELECT *, {ACT_PERIOD} AS act_period FROM panel) q LEFT JOIN pcs USING (act_period))"""
PANEL_MACRO = f"WITH {PANEL_MACRO_CTE}\n"
