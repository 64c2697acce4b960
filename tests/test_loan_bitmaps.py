"""Distinct loans by bitmaps: counts against brute force, batches, retries, plans."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from loanpanel.operators import cycles as CY
from loanpanel.operators import delinquency as D
from loanpanel.operators import loan_bitmaps as LB
from loanpanel.operators import sampling as SA

SCHEMA = "LOAN_ID string, data_quarter string, STATE string, any_delinquent int, serious_delinquent int, f double"


def rows(n=600, seed=3):
    rng = random.Random(seed)
    out = [(f"L{rng.randint(0, 80)}", rng.choice(["2017Q1", "2017Q2", "2018Q1", None]), rng.choice(["CA", "NY", None]),
            rng.choice([0, 1, None]), rng.choice([0, 1]), rng.choice([rng.random(), None])) for _ in range(n)]
    out += [("hot", "2017Q1", "CA", 1, 0, 0.5)] * 300  # a third of all rows
    return [*out, (None, "2017Q1", "CA", 1, 1, 0.25), (None, "2020Q4", "CA", 0, 0, None)]


def distinct(data, key):
    seen = defaultdict(set)
    for row in data:
        seen[key(row)] |= {row[0]} - {None}
    return {k: len(v) for k, v in seen.items()}


@pytest.mark.parametrize("parts", [1, 7])
def test_counts_by_any_key(spark, parts):
    data = rows()
    panel = spark.createDataFrame(data, SCHEMA).repartition(parts)
    numbers = LB.number_loans(panel)
    loans = {r[0] for r in data} - {None}
    got = numbers.collect()
    assert {r["LOAN_ID"] for r in got} == loans and sorted(r["loan_no"] for r in got) == list(range(1, len(loans) + 1))
    bitmaps = LB.loan_bitmaps(LB.add_numbers(panel, numbers), ["data_quarter", "STATE"])
    for keys, key in ((["data_quarter"], lambda r: (r[1],)), (["STATE"], lambda r: (r[2],)),
                      (["data_quarter", "STATE"], lambda r: (r[1], r[2])), ([], lambda r: ())):
        assert {tuple(r[:-1]): r["loans"] for r in LB.count_loans(bitmaps, keys).collect()} == distinct(data, key)
    empty = LB.loan_bitmaps(LB.add_numbers(panel.limit(0), LB.number_loans(panel.limit(0))), ["STATE"])
    assert LB.count_loans(empty, ["STATE"]).collect() == [] and LB.count_loans(empty).first()["loans"] == 0


def test_more_loans_than_a_bitmap_holds(spark):
    panel = spark.range(100_000).select(F.concat(F.lit("L"), "id").alias("LOAN_ID"), (F.col("id") % 3).alias("q"))
    bitmaps = LB.loan_bitmaps(LB.add_numbers(panel, LB.number_loans(panel)), ["q"])
    assert bitmaps.select("bucket").distinct().count() == 4
    assert {r["q"]: r["loans"] for r in LB.count_loans(bitmaps, ["q"]).collect()} == {0: 33_334, 1: 33_333, 2: 33_333}
    assert LB.count_loans(bitmaps).first()["loans"] == 100_000


def test_batches_append_and_may_repeat(spark, tmp_path):
    data, path = rows(), str(tmp_path / "bitmaps")
    first = spark.createDataFrame(data[:400], SCHEMA)
    second = spark.createDataFrame(data[300:], SCHEMA)
    known = LB.number_loans(first)
    more = LB.number_loans(second, known)
    every = known.unionByName(more)
    numbers = [r["loan_no"] for r in every.collect()]
    assert sorted(numbers) == list(range(1, len({r[0] for r in data} - {None}) + 1))
    assert LB.number_loans(second, every).count() == 0
    for batch, table in ((first, known), (second, every), (second, every)):
        LB.append_bitmaps(LB.loan_bitmaps(LB.add_numbers(batch, table), ["data_quarter"]), path)
    counts = LB.count_loans(spark.read.parquet(path), ["data_quarter"])
    assert {r["data_quarter"]: r["loans"] for r in counts.collect()} == distinct(data, lambda r: r[1])


def test_reports_agree_with_counts_by_value(spark):
    panel = spark.createDataFrame(rows(), SCHEMA)
    numbered = LB.add_numbers(panel, LB.number_loans(panel))

    def table(df):
        return [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()]

    assert table(D.quarterly_delinquency(panel)) == table(D.quarterly_delinquency(numbered))
    assert table(CY.factor_impact(panel, "f")) == table(CY.factor_impact(numbered, "f"))
    unknown = panel.where("LOAN_ID IS NULL")
    assert [r["active_loans"] for r in D.quarterly_delinquency(LB.add_numbers(unknown, LB.number_loans(unknown))).collect()] == [0, 0]
    assert SA.coverage(panel).first()[:2] == (3, 5) and SA.coverage(panel.limit(0)).first()["quarters"] is None


def test_no_row_of_a_numbered_panel_moves_by_loan(spark, tmp_path):
    panel = spark.createDataFrame(rows(), SCHEMA)
    LB.add_numbers(panel, LB.number_loans(panel)).write.parquet(str(tmp_path / "panel"))
    report = D.quarterly_delinquency(spark.read.parquet(str(tmp_path / "panel")))
    report.collect()
    plan = report._jdf.queryExecution().executedPlan().toString()
    moved = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert moved and not any("loan_no" in x or "LOAN_ID" in x for x in moved), plan
