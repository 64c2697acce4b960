"""Cleaning, encoding, deduplication, sampling: small literal data and skewed data."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from loanpanel import schemas as S
from loanpanel.operators import clean as C
from loanpanel.operators import delinquency as D
from loanpanel.operators import overview as O
from loanpanel.operators import panel as P
from loanpanel.operators import sampling as SA
from loanpanel.operators import variation as V
from loanpanel.plans import pipeline
from loanpanel.plans.analysis import longitudinal_analysis
from loanpanel.sources import raw, sinks


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def obs(spark, rows):
    """rows: loan, age, status, quarter, ingest"""
    df = spark.createDataFrame(rows, "LOAN_ID string, LOAN_AGE double, DLQ_STATUS string, data_quarter string, seq long")
    return df.select("*", F.lit(None).cast("string").alias("Zero_Bal_Code"), F.lit(90.0).alias("CURRENT_UPB"),
                     F.lit(100.0).alias("ORIG_UPB"), F.lit(3.0).alias("CURR_RATE"), F.lit(2.5).alias("ORIG_RATE"),
                     F.lit(700.0).alias("CURR_SCOREB"), F.lit(710.0).alias("CSCORE_B"))


def test_keep_last_within_and_across_quarters(spark):
    df = obs(spark, [("a", 1.0, "00", "2017Q1", 1), ("a", 1.0, "03", "2017Q1", 2), ("a", 1.0, "01", "2017Q3", 3),
                     ("a", -1.0, "00", "2017Q1", 4)])
    tv = P.encode_time_varying(df, extra=["seq"])
    assert tv.count() == 3
    within = P.dedup_last(tv, ["seq"])
    assert within.columns == S.TIME_VARYING_COLUMNS
    assert sorted((r["data_quarter"], r["dlq_status_original"]) for r in within.collect()) == [("2017Q1", "03"), ("2017Q3", "01")]
    assert [r["dlq_status_original"] for r in P.dedup_last(tv, ["seq"], across_quarters=True).collect()] == ["01"]


def test_hot_key_is_reduced_before_the_shuffle(spark):
    hot = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("LOAN_ID"),
        F.lit(1.0).alias("time"), F.lit("2017Q1").alias("data_quarter"), F.col("id").alias("seq"))
    out = P.dedup_last(hot, ["seq"])
    assert out.count() == 40_001
    text = plan(P.dedup_last(hot, ["seq"]))
    assert text.index("Final") < text.index("Exchange hashpartitioning") < text.index("Partial")
    last = P.keep_one(hot, ["LOAN_ID"], [F.desc("seq")]).where("LOAN_ID = 'hot'").first()
    assert last["seq"] == 59_997


def test_no_python_in_the_panel_build(spark):
    tv = P.encode_time_varying(obs(spark, [("a", 1.0, "00", "2017Q1", 1)]), extra=["seq"])
    for df in (P.dedup_last(tv, ["seq"]), D.transition_matrix(P.dedup_last(tv, ["seq"]))):
        assert "Python" not in plan(df) and "ArrowEval" not in plan(df)


def test_extend_static_keeps_first(spark):
    a = spark.createDataFrame([("1", "CA"), ("2", "NY")], "LOAN_ID string, STATE string")
    b = spark.createDataFrame([("2", "TX"), ("3", "FL")], "LOAN_ID string, STATE string")
    assert [tuple(r) for r in P.extend_static(a, b).collect()] == [("3", "FL")]


def test_raw_files_to_panel(spark, tmp_path):
    """Raw text files with bad values, a missing quarter, and the whole job to the joined panel."""
    def line(loan, age, status, rate="3.5", state="CA", orig="012017"):
        given = {"LOAN_ID": loan, "LOAN_AGE": age, "DLQ_STATUS": status, "ORIG_RATE": rate, "CURR_RATE": "4.0",
                 "ORIG_UPB": "100000", "CURRENT_UPB": "90000", "STATE": state, "ORIG_DATE": orig, "ACT_PERIOD": "022017"}
        return "|".join(given.get(c, "") for c in S.RAW_COLUMNS)

    folder = tmp_path / "raw"
    folder.mkdir()
    (folder / "2017Q1.csv").write_text("\n".join([
        line("007", "0", "00"), line("007", "0", "03"), line("008", "x", "01", rate="oops"), line("009", "-1", "00", orig="132017")]))
    (folder / "2017Q3.csv").write_text("\n".join([line("007", "1", "", state="TX"), line("010", "1", "XX", rate="")]))
    pattern = raw.quarter_glob(str(folder), ["2017Q1", "2017Q3", "2018Q1"])
    df = raw.read_raw(spark, pattern)
    assert sorted((r["file"].rsplit("/", 1)[1], r["rows"]) for r in raw.input_files(
        spark.read.text(pattern)).collect()) == [("2017Q1.csv", 4), ("2017Q3.csv", 2)]
    typed = {(r["LOAN_ID"], r["DLQ_STATUS"]): r for r in C.type_columns(df).collect()}
    assert typed["008", "01"]["LOAN_AGE"] is None and typed["008", "01"]["ORIG_RATE"] is None
    assert typed["009", "00"]["ORIG_DATE"] is None and typed["007", "03"]["ORIG_DATE"] == dt.date(2017, 1, 1)

    clean = str(tmp_path / "clean")
    pipeline.clean_quarters(spark, str(folder), ["2017Q1", "2017Q3", "2018Q1"], clean)
    cleaned = sinks.read_master(spark, clean)
    got = {(r["LOAN_ID"], r["data_quarter"], r["DLQ_STATUS"]): r for r in cleaned.collect()}
    assert got["008", "2017Q1", "01"]["ORIG_RATE"] == 3.5 and got["008", "2017Q1", "01"]["LOAN_AGE"] == 0.0
    assert got["007", "2017Q3", "Missing"]["SELLER"] == "Missing" and got["007", "2017Q3", "Missing"]["DTI"] == 0.0
    panel = pipeline.build_master(spark, cleaned, str(tmp_path / "master"), str(tmp_path / "static"))
    rows = sorted((r["LOAN_ID"], r["time"], r["event"], r["dlq_severity"], r["STATE"]) for r in panel.collect())
    assert rows == [("007", 0.0, 1, "Serious_DLQ", "CA"), ("007", 1.0, 0, "Missing", "CA"),
                    ("008", 0.0, 0, "Early_DLQ", "CA"), ("010", 1.0, 0, "Unknown", "CA")]
    assert len(panel.columns) == 35


@pytest.fixture(scope="module")
def panel(spark):
    """200 loans by up to 12 months, one of five never observed late, some gaps."""
    rows = []
    for loan in range(200):
        for t in range(1 + loan % 12):
            if (loan + t) % 11 == 5 and t:
                continue
            late = loan % 5 != 0 and (loan * 7 + t * 3) % 10 < 3
            rows.append((f"L{loan}", float(t), f"20{17 + t // 4}Q{1 + t % 4}", int(late and loan % 3 == 0), int(late),
                         float((loan * 13 + t) % 17), float((loan + 2 * t) % 7), float(t % 3),
                         dt.date(2015 + loan % 3, 1 + loan % 12, 1), 600.0 + loan % 250, 60.0 + loan % 40,
                         ("CA", "GA", "DC", None)[loan % 4], 100.0 + loan))
    df = spark.createDataFrame(rows, """LOAN_ID string, time double, data_quarter string, event int, any_delinquent int,
        credit_score_change double, balance_ratio double, rate_change double, ORIG_DATE date, CSCORE_B double, OLTV double,
        STATE string, ORIG_UPB double""")
    return df.withColumns({"serious_delinquent": F.col("event"), "PURPOSE": F.lit("P"), "PROP": F.lit("SF"),
                           "DTI": F.lit(30.0), "ORIG_RATE": F.lit(3.0)}).cache()


def test_sampling_counts_and_reproducibility(spark, panel):
    loans = SA.add_strata(SA.loan_characteristics(panel))
    want = {tuple(r[c] for c in SA.STRATA): r["target"] for r in SA.strata_targets(loans, 60).collect()}
    ids = SA.stratified_sample(panel, 60)
    got = {}
    for r in loans.join(ids, "LOAN_ID").collect():
        key = tuple(r[c] for c in SA.STRATA)
        got[key] = got.get(key, 0) + 1
    assert got == want
    again = SA.stratified_sample(panel.repartition(7), 60)
    assert {r[0] for r in ids.collect()} == {r[0] for r in again.collect()}
    assert {r[0] for r in ids.collect()} != {r[0] for r in SA.stratified_sample(panel, 60, seed=7).collect()}


def test_sampling_a_dominant_stratum(spark):
    loans = spark.range(20_000).select(F.col("id").cast("string").alias("LOAN_ID"),
                                       F.when(F.col("id") % 10 == 0, None).otherwise("big").alias("s"))
    ids = SA.stratified_ids(loans, ["s"], SA.proportional_quota(1000))
    assert {r["s"]: r["count"] for r in loans.join(ids, "LOAN_ID").groupBy("s").count().collect()} == {None: 100, "big": 900}


def test_balanced_and_smart_sample(spark, panel):
    ids = SA.balanced_sample(panel, 50)
    ever = panel.groupBy("LOAN_ID").agg(F.max("any_delinquent").alias("e")).cache()
    share = ever.agg(F.avg("e")).first()[0]
    assert {r["e"]: r["count"] for r in ever.join(ids, "LOAN_ID").groupBy("e").count().collect()} == {
        1: int(50 * share), 0: 50 - int(50 * share)}
    df = spark.range(100).select(F.col("id").alias("LOAN_ID"), (F.col("id") % 2).cast("int").alias("survival_event"),
                                 F.lit(3.0).alias("survival_time"))
    assert SA.smart_sample(df, 500).count() == 100  # few enough rows: all are kept
    assert SA.smart_sample(df, 10).groupBy("survival_event").count().agg(F.sum("count")).first()[0] == 10


def test_naive_survival_brute_force(spark, panel):
    rows = [(r["LOAN_ID"], r["time"], r["any_delinquent"]) for r in panel.collect()]
    got = {r["time"]: r["survival"] for r in D.naive_survival(panel).collect()}
    assert sorted(got) == [0, 2, 4, 6, 8, 10]
    for t, s in got.items():
        seen = {loan for loan, x, _ in rows if x <= t}
        late = {loan for loan, x, a in rows if x <= t and a == 1}
        assert s == pytest.approx(1 - len(late) / len(seen))


def test_analysis_runs_every_table(spark, panel):
    tables = longitudinal_analysis(panel.withColumn("credit_markets_PC1", F.col("time") / 3), target=100)
    assert tables["panel_overview"].first()["loans"] <= 100
    for name in ("key_insights", "credit", "delinquency_by_decile", "modal_length", "missing_profile"):
        assert tables[name].columns and tables[name].collect() is not None
    assert O.loan_summary(panel).count() == 200 and V.top_states(O.loan_summary(panel)).count() == 3


def test_across_quarters_the_later_quarter_wins(spark):
    """Positions in a file say nothing about the order of files."""
    df = spark.createDataFrame([("a", 1.0, "2017Q1", 900, "old"), ("a", 1.0, "2017Q3", 0, "new")],
                               "LOAN_ID string, time double, data_quarter string, seq int, v string")
    assert [r["v"] for r in P.dedup_last(df, ["seq"], across_quarters=True).collect()] == ["new"]


def test_smart_sample_is_exact_and_keeps_unknown_durations_apart(spark):
    df = spark.range(1000).select(F.col("id").alias("LOAN_ID"), (F.col("id") % 3 == 0).cast("int").alias("survival_event"),
                                  F.when(F.col("id") % 10 == 0, None).otherwise((F.col("id") % 37).cast("double")).alias("survival_time"))
    got = SA.smart_sample(df, 97)
    assert got.count() == 97
    unknown = got.where("survival_time IS NULL").count()
    assert 8 <= unknown <= 11  # their own tenth
