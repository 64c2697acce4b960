"""Loan, macro and survival inputs projected from the driver's tables (see FIXTURES.md)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanpanel.operators import macro as M
from loanpanel.operators import panel as P

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
INGEST = ["seq1", "seq2", "seq3"]
DOMAINS = {"alpha": ["S1", "S2"], "beta": ["S3", "S4", "S5"]}
OBSERVATION_QUARTERS = [f"{y}Q{q}" for y in (1995, 1996, 1997) for q in (1, 2, 3, 4)]
SPLIT_DATE = "1998-12-31"
STATIC = ["ORIG_DATE", "CSCORE_B", "DTI", "ORIG_RATE", "ORIG_UPB", "OLTV", "PURPOSE", "STATE", "PROP"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def loan_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").withColumn("LOAN_ID", F.col("l_orderkey").cast("string"))
    orders = table(spark, sf_dir, "orders").withColumn("LOAN_ID", F.col("o_orderkey").cast("string"))
    cust = table(spark, sf_dir, "customer")
    # customers meet orders before the lines; a join by loan leaves the lines dealt as the steps by loan need them
    loans = orders.join(cust, orders.o_custkey == cust.c_custkey)
    return line.join(loans, "LOAN_ID").selectExpr(
        "LOAN_ID",
        "cast(o_orderdate as date) AS ORIG_DATE",
        "cast(l_linenumber - 2 as double) AS LOAN_AGE",
        """CASE WHEN l_quantity >= 49.5 THEN NULL WHEN l_quantity >= 48.5 THEN 'XX'
                WHEN l_quantity >= 47.5 THEN '99'
                WHEN l_returnflag = 'R' THEN lpad(cast(cast(l_quantity as int) % 13 as string), 2, '0')
                ELSE '00' END AS DLQ_STATUS""",
        "CASE WHEN l_tax >= 0.075 THEN '09' WHEN l_tax >= 0.065 THEN '01' END AS Zero_Bal_Code",
        "o_totalprice AS ORIG_UPB",
        "l_extendedprice AS CURRENT_UPB",
        "2e0 + cast(o_custkey % 30 as double) / 10e0 AS ORIG_RATE",
        "2e0 + cast(o_custkey % 30 as double) / 10e0 + (l_discount - 5e-2) * 10e0 AS CURR_RATE",
        """CASE WHEN o_custkey % 20 = 0 THEN NULL
                ELSE cast(580 + floor((c_acctbal + 1000e0) / 45e0) as double) END AS CSCORE_B""",
        """CASE WHEN o_custkey % 20 = 0 THEN NULL
                ELSE cast(580 + floor((c_acctbal + 1000e0) / 45e0) as double) + 25e0 - l_quantity
                END AS CURR_SCOREB""",
        "cast(50 + o_custkey % 50 as double) AS OLTV",
        "cast(10 + o_custkey % 41 as double) AS DTI",
        "substring('CANYFLTXWAORNVAZCOILMIOHPANJVANCGAMNMAWIMOTNIDUTKS', 1 + 2 * c_nationkey, 2) AS STATE",
        """CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'P' WHEN '2' THEN 'C'
                WHEN '3' THEN 'R' WHEN '4' THEN 'U' END AS PURPOSE""",
        "substring(c_mktsegment, 1, 2) AS PROP",
        "concat(cast(year(l_shipdate) as string), 'Q', cast(quarter(l_shipdate) as string)) AS data_quarter",
        "l_shipdate AS seq1", "l_partkey AS seq2", "l_suppkey AS seq3")


def time_varying(spark: SparkSession, sf_dir: str, across_quarters: bool = False,
                 extra: Sequence[str] = ()) -> DataFrame:
    tv = P.encode_time_varying(loan_obs(spark, sf_dir), extra=[*extra, *INGEST])
    return P.dedup_last(tv, INGEST, across_quarters)


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time-varying and static columns; one row per (LOAN_ID, time)."""
    return time_varying(spark, sf_dir, across_quarters=True, extra=STATIC)


def macro_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "concat('S', substring(o_orderpriority, 1, 1)) AS series_id",
        "cast(o_orderdate as date) AS date",
        """CASE WHEN (month(o_orderdate) + year(o_orderdate)
                      + cast(substring(o_orderpriority, 1, 1) as int)) % 11 = 0 THEN '.'
                ELSE cast(cast(floor(o_totalprice) as bigint) as string) END AS value""")


def macro_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    monthly = M.monthly_average(M.valid_observations(macro_obs(spark, sf_dir)))
    wide = M.wide_by_month(monthly, [s for ss in DOMAINS.values() for s in ss])
    return M.principal_components(wide, DOMAINS)[0]


def panel_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.join_macro(M.add_act_period(panel(spark, sf_dir)), macro_components(spark, sf_dir))
