"""Macro series: reading, filling, components, join."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from loanpanel.operators import macro as M
from loanpanel.plans import pipeline
from loanpanel.sources import raw

DOMAINS = {"a": ["X", "Y", "Z"], "b": ["U", "V"], "c": ["W", "MISSING"]}


@pytest.fixture(scope="module")
def observations(spark):
    rng = np.random.default_rng(5)
    rows, base = [], rng.normal(size=36).cumsum()
    for s, k in (("X", 1.0), ("Y", -2.0), ("Z", 0.5), ("U", 0.0), ("V", 0.0), ("W", 1.0)):
        for m in range(36):
            day = dt.date(2017 + m // 12, 1 + m % 12, 1)
            if (m + ord(s[0])) % 7 == 0:
                rows.append((s, str(day), "."))
                continue
            v = k * base[m] + rng.normal()
            rows += [(s, str(day), str(v - 1)), (s, str(day.replace(day=15)), str(v + 1))]
    rows += [("X", "not a date", "1.0"), ("X", "2017-01-01", "abc"), ("X", "2017-01-01", None)]
    return spark.createDataFrame(rows, "series_id string, date string, value string")


def wide(observations):
    names = [s for ss in DOMAINS.values() for s in ss]
    return M.wide_by_month(M.monthly_average(M.valid_observations(observations)), names)


def test_json_response(spark, tmp_path):
    (tmp_path / "UNRATE.json").write_text(json.dumps({"observations": [
        {"date": "2017-01-01", "value": "4.7"}, {"date": "2017-02-01", "value": "."}, {"date": "bad", "value": "1"}]}))
    got = M.valid_observations(raw.read_macro(spark, str(tmp_path))).collect()
    assert [(r["series_id"], r["date"], r["value"], r["act_period"]) for r in got] == [
        ("UNRATE", dt.date(2017, 1, 1), 4.7, "012017")]


def test_fill_and_check(observations):
    filled = M.fill_gaps(wide(observations), ["X", "W", "MISSING"]).toPandas().pivot(
        index="month", columns="series_id", values="value")
    raw_wide = wide(observations).toPandas().set_index("month").sort_index()
    for s in ("X", "W"):
        assert np.allclose(filled[s], raw_wide[s].astype(float).ffill().bfill())
    names = [s for ss in DOMAINS.values() for s in ss]
    check = {r["domain"]: r for r in M.domain_check(M.fill_gaps(wide(observations), names), DOMAINS).collect()}
    assert check["a"]["usable"] and check["b"]["usable"] and not check["c"]["usable"] and check["c"]["series"] == 1


def test_components_match_svd(observations):
    scores, loadings = M.principal_components(wide(observations), DOMAINS)
    got = scores.toPandas().sort_values("month")
    assert not [c for c in got.columns if c.startswith("c_")]  # a single series: skipped
    for domain in ("a", "b"):
        x = wide(observations).toPandas().sort_values("month")[DOMAINS[domain]].astype(float).ffill().bfill().to_numpy()
        z = (x - x.mean(0)) / x.std(0)
        _, s, vt = np.linalg.svd(z, full_matrices=False)
        share = s**2 / (s**2).sum()
        kept = [c for c in got.columns if c.startswith(f"{domain}_")]
        assert len(kept) == (1 if share[0] > 0.6 else 2)
        for i, c in enumerate(kept):
            v = vt[i] * np.sign(vt[i][np.abs(vt[i]).argmax()])
            first = next(l for l in loadings if l["component"] == c)
            assert first["share"] == pytest.approx(share[i])
            assert np.allclose(np.abs(got[c]), np.abs(z @ v), atol=1e-9)
            if domain == "a":
                assert np.allclose(got[c], z @ v, atol=1e-9)


def test_join_is_broadcast_and_keeps_rows(spark, observations):
    panel = spark.createDataFrame([("1", 0.0, dt.date(2017, 1, 10)), ("2", 500.0, dt.date(2017, 1, 10)), ("3", 1.0, None)],
                                  "LOAN_ID string, time double, ORIG_DATE date")
    out = pipeline.add_macro(panel, observations, DOMAINS)
    assert "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()
    got = {r["LOAN_ID"]: r for r in out.collect()}
    assert len(got) == 3 and got["1"]["act_period"] == "022017" and got["1"]["b_PC1"] is not None
    assert got["2"]["b_PC1"] is None and got["3"]["act_period"] is None
    text = M.add_act_period(panel.withColumn("ORIG_DATE", F.lit("2017-13-40")))
    assert [r["act_period"] for r in text.collect()] == [None] * 3


def test_typed_dates_are_not_written_out(spark):
    text = spark.createDataFrame([("X", "2017-01-03", "1"), ("X", None, "2"), ("Y", "0999-12-31", "3"), ("Y", "2017-02-01", ".")],
                                 "series_id string, date string, value string")
    typed = M.valid_observations(text.withColumn("date", F.col("date").cast("date")))
    assert sorted(map(tuple, typed.collect())) == sorted(map(tuple, M.valid_observations(text).collect()))
    plan = typed.select("date", "value")._jdf.queryExecution().optimizedPlan().toString()
    assert "as string" not in plan and "gettimestamp" not in plan
