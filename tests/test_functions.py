"""Null and boundary rules of the scalar functions."""

import datetime as dt

from pyspark.sql import functions as F

from loanpanel import schemas as S
from loanpanel.functions import codes, dates


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_layouts():
    assert len(S.RAW_COLUMNS) == len(set(S.RAW_COLUMNS)) == 110
    assert len(S.CLEAN_COLUMNS) == 43 and set(S.CLEAN_COLUMNS) <= set(S.RAW_COLUMNS)
    assert len(S.CATEGORICAL_COLUMNS) == 18 and len(S.NUMERIC_COLUMNS) == 17
    assert len(S.TIME_VARYING_COLUMNS) == 11 and len(S.STATIC_COLUMNS) == 25
    assert sum(map(len, S.MACRO_DOMAINS.values())) == 29


def test_mmyyyy(spark):
    df = spark.createDataFrame([(x,) for x in ["012017", "12017", "122017", "132017", "", "abc", None]], "x string")
    got = [r[0] for r in df.select(dates.mmyyyy_to_date(F.col("x"))).collect()]
    assert got == [dt.date(2017, 1, 1), dt.date(2017, 1, 1), dt.date(2017, 12, 1), None, None, None, None]


def test_act_period_and_quarters(spark):
    df = spark.createDataFrame([(dt.date(1998, 10, 5), -1.0), (dt.date(1998, 10, 5), 0.0), (None, 1.0)], "d date, t double")
    assert [r[0] for r in df.select(dates.act_period(F.col("d"), F.col("t"))).collect()] == ["101998", "111998", None]
    q = spark.createDataFrame([("2017Q1",), ("2019Q4",), ("2019Q5",), ("x",), (None,)], "q string")
    assert [r[0] for r in q.select(dates.quarter_start(F.col("q"))).collect()] == [
        dt.date(2017, 1, 1), dt.date(2019, 10, 1), None, None, None]
    t = spark.createDataFrame([("2017-03-04",), ("nope",), (None,)], "t string")
    assert [r[0] for r in t.select(dates.lenient_timestamp(F.col("t")).cast("date")).collect()] == [dt.date(2017, 3, 4), None, None]


def test_event_and_flags(spark):
    cases = [  # status, zero balance code, event, severity, any, serious
        (None, None, 0, "Missing", None, None),
        ("Missing", None, 0, "Missing", 0, 0),
        ("", None, 0, "Missing", 0, 0),
        ("XX", None, 0, "Unknown", 0, 0),
        ("00", None, 0, "Current", 0, 0),
        ("02", None, 0, "Early_DLQ", 1, 0),
        ("03", None, 1, "Serious_DLQ", 1, 1),
        ("09", None, 1, "Severe_DLQ", 1, 1),
        ("10", None, 1, "Other", 0, 0),
        ("99", None, 1, "Extreme_DLQ", 1, 1),
        ("00", "09", 1, "Current", 0, 0),
        (None, "97", 1, "Missing", None, None),
        ("00", "01", 0, "Current", 0, 0),
    ]
    df = spark.createDataFrame([c[:2] for c in cases], "s string, z string")
    s = F.col("s")
    got = rows(df.select("s", "z", codes.default_event(s, F.col("z")), codes.dlq_severity(s),
                         codes.any_delinquent(s), codes.serious_delinquent(s)))
    assert got == cases


def test_ratio_and_tiers(spark):
    df = spark.createDataFrame([(50.0, 100.0), (50.0, 0.5), (50.0, None), (None, 10.0)], "c double, o double")
    assert [r[0] for r in df.select(codes.balance_ratio(F.col("c"), F.col("o"))).collect()] == [0.5, 50.0, None, None]
    t = spark.createDataFrame([(619.0, 69.0, "CA"), (620.0, 70.0, "GA"), (740.0, 84.9, "DC"), (800.0, 85.0, None),
                               (None, None, "NY")], "s double, l double, st string")
    got = rows(t.select(codes.credit_tier(F.col("s")), codes.ltv_tier(F.col("l")), codes.geo_tier(F.col("st"))))
    assert got == [("VeryLow", "LowLTV", "Major"), ("Low", "MidLTV", "Large"), ("High", "MidLTV", "Other"),
                   ("VeryHigh", "HighLTV", "Other"), ("VeryHigh", "HighLTV", "Major")]


def test_mmyyyy_of_long_numbers(spark):
    texts = ["1220171", "12017123", "122017", "012017", "12017", "0", "-12017", "132017", "", "abc", "10000", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [None if r[0] is None else r[0].isoformat() for r in df.select(dates.mmyyyy_to_date(F.col("t"))).collect()]
    assert got == [None, None, "2017-12-01", "2017-01-01", "2017-01-01"] + [None] * 7
