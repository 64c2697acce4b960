"""Quantiles, running sums and histograms against numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loanpanel.functions import stats as ST
from loanpanel.operators import variation as V


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.normal(0, 3, 400), np.zeros(300), rng.lognormal(3, 4, 200), -rng.random(100)])
    return [(("a", "b", None)[i % 3], float(v)) for i, v in enumerate(values)] + [("a", None)]


def test_quantiles_match_numpy(spark, data):
    df = spark.createDataFrame(data, "g string, x double").withColumn("y", F.col("x") * 2)
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {(r["column"], r["prob"]): r["quantile"] for r in ST.quantiles(df, ["x", "y"], probs).collect()}
    x = np.array([v for _, v in data if v is not None])
    for p in probs:
        assert got["x", p] == pytest.approx(np.quantile(x, p), rel=1e-12, abs=1e-12)
        assert got["y", p] == pytest.approx(np.quantile(2 * x, p), rel=1e-12, abs=1e-12)
    by = {r["g"]: r["quantile"] for r in ST.quantiles(df, ["x"], [0.5], ["g"]).collect()}
    for g in ("a", "b", None):
        assert by[g] == pytest.approx(np.median([v for k, v in data if k == g and v is not None]))


def test_describe(spark, data):
    df = spark.createDataFrame(data, "g string, x double")
    x = np.array([v for _, v in data if v is not None])
    row = ST.describe(df, ["x"]).first()
    assert row["count"] == len(x) and row["std"] == pytest.approx(x.std(ddof=1))
    assert row["p75"] == pytest.approx(np.quantile(x, 0.75)) and row["max"] == x.max()


def test_running_sum(spark):
    t = sorted({float(x) for x in np.random.default_rng(2).normal(0, 100, 500)} | {0.0})
    df = spark.createDataFrame([(x, i + 1) for i, x in enumerate(t)], "t double, n long").repartition(4)
    for descending in (False, True):
        got = dict(tuple(r) for r in ST.running_sum(df, "t", ["n"], descending).collect())
        n = np.arange(1, len(t) + 1)
        want = n[::-1].cumsum()[::-1] if descending else n.cumsum()
        assert [got[x] for x in t] == want.tolist()


def test_histogram(spark, data):
    df = spark.createDataFrame(data, "g string, x double")
    for g in ("a", "b", None):
        x = [v for k, v in data if k == g and v is not None]
        got = [r for r in ST.histogram(df, "x", 10, ["g"]).orderBy("bin").collect() if r["g"] == g]
        count, edges = np.histogram(x, 10)
        density, _ = np.histogram(x, 10, density=True)
        assert [r["count"] for r in got] == count.tolist()
        assert np.allclose([r["lo"] for r in got], edges[:-1])
        assert np.allclose([r["density"] for r in got], density)
    flat = spark.createDataFrame([(5,)] * 7, "x int")
    one = ST.histogram(flat, "x", 30).collect()
    assert len(one) == 30 and sum(r["count"] for r in one) == 7


def test_correlation_without_variance(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.5, 5.0), (3.0, 6.0, 5.0), (4.0, None, 5.0)], "a double, b double, c double")
    got = {(r["var_a"], r["var_b"]): r["corr"] for r in ST.correlation_pairs(df, ["a", "b", "c"]).collect()}
    assert got["a", "b"] == pytest.approx(np.corrcoef([1, 2, 3], [2, 4.5, 6])[0, 1])
    assert got["a", "c"] is None and got["b", "c"] is None


def test_describe_keeps_small_spreads_and_empty_columns(spark):
    rows = [(1e9 + i, 3e8 + (i % 3), None, float("nan") if i == 1 else float(i)) for i in range(3)]
    got = {r["column"]: r for r in ST.describe(spark.createDataFrame(rows, "a double, b double, c double, d double"), list("abcd")).collect()}
    assert got["a"]["std"] == pytest.approx(1.0) and got["b"]["std"] == pytest.approx(1.0)
    assert (got["c"]["count"], got["c"]["mean"], got["c"]["p50"]) == (0, None, None)
    assert (got["d"]["count"], got["d"]["mean"], got["d"]["p50"]) == (2, 1.0, 1.0)


def test_quantiles_within_one_narrow_range(spark):
    """Very many values in a thousandth of a power of two, as ratios near one have."""
    rng = np.random.default_rng(2)
    x = np.concatenate([1 + rng.random(5000) / 5000, [float("inf"), -float("inf"), 5e-324]])
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    probs = [0.01, 0.25, 0.5, 0.99]
    got = {r["prob"]: r["quantile"] for r in ST.quantiles(df, ["x"], probs).collect()}
    assert got == {p: pytest.approx(np.quantile(x, p), rel=1e-15) for p in probs}


def test_running_sums_by_group(spark):
    rng = np.random.default_rng(3)
    rows = [("ab"[i % 2], float(t), 1.0) for i, t in enumerate(rng.permutation(600))]
    got = ST.running_sum(spark.createDataFrame(rows, "g string, t double, v double"), "t", ["v"], descending=True, by=["g"]).collect()
    for g in "ab":
        own = sorted((r["t"], r["v"]) for r in got if r["g"] == g)
        assert [v for _, v in own] == list(range(len(own), 0, -1))


def test_within_correlation_needs_no_window_and_keeps_digits(spark):
    rng = np.random.default_rng(5)
    rows = []
    for loan in range(40):
        base = rng.normal(size=3) * 1e9
        for _ in range(int(rng.integers(1, 9))):
            x = rng.normal()
            v = [base[0] + x, base[1] + 0.5 * x + rng.normal(), base[2] + rng.normal()]
            rows.append((f"l{loan}", *[None if rng.random() < 0.15 else float(a) for a in v]))
    rows += [("hot", float(i % 7), float(i % 5), None) for i in range(300)] + [(None, 1.0, 2.0, 3.0)]
    df = spark.createDataFrame(rows, "LOAN_ID string, a double, b double, c double")
    got = V.within_correlation(df, ["a", "b", "c"])
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
    pdf = pd.DataFrame(rows, columns=["LOAN_ID", "a", "b", "c"])
    centred = pdf[["a", "b", "c"]] - pdf.groupby("LOAN_ID", dropna=False)[["a", "b", "c"]].transform("mean")
    for r in got.collect():
        both = centred[[r["var_a"], r["var_b"]]].dropna()
        assert r["corr"] == pytest.approx(both.corr().iloc[0, 1], abs=1e-6)


def test_quantiles_scan_the_input_twice(spark):
    """Groups, ties, missing values, extremes, and more rows than a sketch keeps."""
    rng = np.random.default_rng(2)
    values = np.concatenate((rng.lognormal(0, 9, 40_000), np.repeat([0.0, -0.0, 5.0, 7.5], 9_000), -rng.random(20_000), [np.inf, -np.inf]))
    pdf = pd.DataFrame({"g": rng.integers(0, 3, len(values)), "x": values, "y": rng.normal(size=len(values))})
    pdf.loc[::9, "y"] = np.nan
    df = spark.createDataFrame(pdf)
    probs = [0.0, 0.001, 0.25, 0.5, 0.9, 1.0]
    got = {(r["g"], r["column"], r["prob"]): r["quantile"] for r in ST.quantiles(df, ["x", "y"], probs, by=["g"]).collect()}
    for g, own in pdf.groupby("g"):
        for c in ("x", "y"):
            for p in probs:
                want = np.sort(own[c].dropna().to_numpy())
                h = p * (len(want) - 1)
                lo, hi = want[int(np.floor(h))], want[int(np.ceil(h))]
                assert got[g, c, p] == pytest.approx(lo if lo == hi or np.isinf(lo) else lo + (hi - lo) * (h - np.floor(h)), nan_ok=True) or np.isinf(hi)


def test_a_row_per_group_is_sent_and_the_table_stays_where_it_is(spark, monkeypatch):
    """A few medians must not deal all rows by quarter; a table too large to send still joins."""
    from loanpanel.functions import stats
    from loanpanel.operators.clean import fill_median

    rows = [("q1", 1.0), ("q1", 3.0), ("q1", None), (None, 5.0), (None, None), ("q2", None)]
    df = spark.createDataFrame(rows, "data_quarter string, CSCORE_B double").repartition(3)
    want = sorted([("q1", 1.0), ("q1", 3.0), ("q1", 2.0), ("", 5.0), ("", 5.0), ("q2", 0.0)])
    for limit, sent in ((stats.SENT_BYTES, True), (0, False)):
        monkeypatch.setattr(stats, "SENT_BYTES", limit)
        out = fill_median(df, ["CSCORE_B"])
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert ("BroadcastHashJoin" in plan) is sent and ("SortMergeJoin" in plan) is not sent
        assert sorted((r[0] or "", r[1]) for r in out.collect()) == want


def test_cleaning_parses_its_input_once(spark):
    """The result and both scans of the medians read the stored columns."""
    from loanpanel.operators.clean import clean

    rows = [("1", "2017Q1", "700", "012015"), ("2", "2017Q1", None, "132015"), ("3", "2017Q2", "x", None)]
    df = spark.createDataFrame(rows, "LOAN_ID string, data_quarter string, CSCORE_B string, ORIG_DATE string")
    out = clean(df, extra=["data_quarter"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "parquet" in plan.lower() and "ExistingRDD[LOAN_ID" not in plan
    assert {r["LOAN_ID"]: (r["CSCORE_B"], str(r["ORIG_DATE"])) for r in out.collect()} == {
        "1": (700.0, "2015-01-01"), "2": (700.0, "None"), "3": (0.0, "None")}
