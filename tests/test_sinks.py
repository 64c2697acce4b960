"""Master tables, static master and streaming ingest."""

import pytest
from pyspark.sql import functions as F

from loanpanel.operators import delinquency as D
from loanpanel.operators import panel as P
from loanpanel.sources import sinks
from loanpanel.streaming import ingest as G
from tests.test_panel import obs


def state(spark, path):
    return sorted((r["LOAN_ID"], r["time"], r["data_quarter"], r["dlq_status_original"])
                  for r in sinks.read_master(spark, path).collect())


def test_master_overwrites_only_its_quarters(spark, tmp_path):
    path = str(tmp_path / "m")
    df = spark.createDataFrame([("1", "2017Q1", 1), ("1", "2017Q3", 2)], "LOAN_ID string, data_quarter string, v int")
    sinks.write_master(df, path)
    sinks.write_master(df.where("data_quarter = '2017Q3'").withColumn("v", F.lit(9)), path)
    assert sorted(tuple(r) for r in sinks.read_master(spark, path).select("data_quarter", "v").collect()) == [("2017Q1", 1), ("2017Q3", 9)]


def test_static_append_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "s")
    df = spark.createDataFrame([("1", "CA"), ("2", "NY")], "LOAN_ID string, STATE string")
    for _ in range(2):
        sinks.append_static(spark, df, path)
    assert spark.read.parquet(path).count() == 2


def test_compact(spark, tmp_path):
    parts = str(tmp_path / "parts")
    spark.range(1000).repartition(10).write.parquet(parts)
    sinks.compact(spark, [parts], str(tmp_path / "one"), files=1)
    assert len(list((tmp_path / "one").glob("*.parquet"))) == 1 and spark.read.parquet(str(tmp_path / "one")).count() == 1000


def run(spark, landing, tmp_path):
    source = spark.readStream.schema(obs(spark, []).schema).parquet(str(landing))
    G.stream_quarters(source, str(tmp_path / "master"), str(tmp_path / "state"), ["seq"]).awaitTermination()
    return state(spark, str(tmp_path / "master"))


def test_stream_adds_files_once_and_merges_quarters(spark, tmp_path):
    landing = tmp_path / "landing"
    obs(spark, [("a", 1.0, "00", "2017Q1", 1), ("a", 1.0, "03", "2017Q1", 2), ("b", 2.0, "00", "2017Q3", 1)]
        ).write.mode("append").parquet(str(landing))
    first = run(spark, landing, tmp_path)
    assert first == [("a", 1.0, "2017Q1", "03"), ("b", 2.0, "2017Q3", "00")]
    assert run(spark, landing, tmp_path) == first  # nothing new: nothing changes
    obs(spark, [("a", 1.0, "06", "2017Q1", 1), ("c", 4.0, "01", "2017Q1", 1)]).write.mode("append").parquet(str(landing))
    assert run(spark, landing, tmp_path) == [
        ("a", 1.0, "2017Q1", "06"), ("b", 2.0, "2017Q3", "00"), ("c", 4.0, "2017Q1", "01")]


def test_retry_uses_the_staged_copy(spark, tmp_path, monkeypatch):
    """A crash during the swap may have emptied a partition of the master; a retry restores it."""
    master, staging = str(tmp_path / "m"), str(tmp_path / "stage")
    batch = spark.createDataFrame([("1", 1.0, "2017Q1")], "LOAN_ID string, time double, data_quarter string")
    stored = spark.createDataFrame([("2", 1.0, "2017Q1")], batch.schema)
    sinks.write_master(stored, master)
    with monkeypatch.context() as m:
        m.setattr(G, "write_master", lambda df, path: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            G.merge_quarters(spark, batch, master, staging)
    sinks.write_master(batch, master)  # the stored row is gone, as after a half-done swap
    G.merge_quarters(spark, batch, master, staging)
    assert sorted(r["LOAN_ID"] for r in sinks.read_master(spark, master).collect()) == ["1", "2"]


def test_a_schema_that_differs_loses_no_rows(spark, tmp_path):
    """A master with one column more and one with a column less than the batch."""
    for name, stored in (("more", "LOAN_ID string, time double, data_quarter string, extra int, a int"),
                         ("less", "LOAN_ID string, time double, data_quarter string")):
        master, staging = str(tmp_path / name), str(tmp_path / f"{name}-stage")
        rows = [(i, 1.0, "2017Q1", 5, 6)[:len(stored.split(","))] for i in ("1", "2", "3")]
        sinks.write_master(spark.createDataFrame(rows, stored), master)
        batch = spark.createDataFrame([("1", 1.0, "2017Q1", 9)], "LOAN_ID string, time double, data_quarter string, a int")
        G.merge_quarters(spark, batch, master, staging)
        got = {r["LOAN_ID"]: r["a"] for r in sinks.read_master(spark, master).collect()}
        assert got == {"1": 9, "2": 6 if name == "more" else None, "3": 6 if name == "more" else None}
        assert not (tmp_path / f"{name}-stage").exists()


def test_a_half_written_staged_copy_is_not_used(spark, tmp_path):
    master, staging = str(tmp_path / "m"), str(tmp_path / "stage")
    batch = spark.createDataFrame([("1", 1.0, "2017Q1"), ("2", 1.0, "2017Q1")], "LOAN_ID string, time double, data_quarter string")
    batch.limit(1).write.parquet(staging)
    (tmp_path / "stage" / "_SUCCESS").unlink()
    G.merge_quarters(spark, batch, master, staging)
    assert sinks.read_master(spark, master).count() == 2


def test_static_master_with_other_columns(spark, tmp_path):
    path = str(tmp_path / "s")
    sinks.append_static(spark, spark.createDataFrame([("1", "CA", 3)], "LOAN_ID string, STATE string, more int"), path)
    sinks.append_static(spark, spark.createDataFrame([("1", 2.0), ("2", 7.0)], "LOAN_ID string, RATE double"), path)
    got = {r["LOAN_ID"]: (r["STATE"], r["more"], r["RATE"]) for r in sinks.read_static(spark, path).collect()}
    assert got == {"1": ("CA", 3, None), "2": (None, None, 7.0)}


def test_two_batches_share_a_quarter(spark, tmp_path):
    landing = tmp_path / "landing"
    obs(spark, [("a", 1.0, "00", "2017Q1", 1)]).coalesce(1).write.mode("append").parquet(str(landing))
    obs(spark, [("b", 1.0, "01", "2017Q1", 1)]).coalesce(1).write.mode("append").parquet(str(landing))
    source = spark.readStream.schema(obs(spark, []).schema).option("maxFilesPerTrigger", 1).parquet(str(landing))
    G.stream_quarters(source, str(tmp_path / "master"), str(tmp_path / "state"), ["seq"]).awaitTermination()
    assert [x[0] for x in state(spark, str(tmp_path / "master"))] == ["a", "b"]


def exchanges(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange hashpartitioning(LOAN_ID" in line]


@pytest.mark.parametrize("buckets", [3, 16])
def test_tables_by_loan_move_no_loans(spark, tmp_path, buckets):
    rows = [(str(i % 40), float(i // 40), i % 7 // 5, f"2017Q{i % 4 + 1}") for i in range(400)] + [(None, 0.0, 1, "2017Q1")] * 2
    panel = spark.createDataFrame(rows, "LOAN_ID string, time double, any_delinquent int, data_quarter string").withColumn("event", F.lit(0))
    static = spark.createDataFrame([(str(i), i) for i in range(30)], "LOAN_ID string, score int")
    stored = sinks.write_by_loan(panel.repartition(5), f"by_loan_{buckets}", buckets, str(tmp_path / "p"))
    known = sinks.write_by_loan(static, f"static_{buckets}", buckets, str(tmp_path / "s"))
    assert len(list((tmp_path / "p").glob("*.parquet"))) <= buckets
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for ask in (D.transition_matrix, D.gap_summary, D.loan_exits, lambda df: P.join_static(df, static if df is panel else known)):
            got, want = ask(stored), ask(panel)
            assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
            assert not exchanges(got) and exchanges(want)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    again = sinks.write_by_loan(panel.limit(10), f"by_loan_{buckets}", buckets, str(tmp_path / "q"))
    assert again.count() == 10


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().iterator()
    names = set()
    while files.hasNext():
        names.add(files.next().getName())
    return {n for n in names if n.startswith("shuffle_") and n.endswith(".data")}


def test_a_master_leaves_no_shuffle_files(spark, tmp_path):
    """Those of a write go at its end; the session's setting is as before."""
    from loanpanel.session import FREE_SHUFFLES

    was, kept = spark.conf.get(FREE_SHUFFLES, None), shuffle_files(spark)
    df = spark.range(1000).select(F.col("id").cast("string").alias("LOAN_ID"), F.lit("2017Q1").alias("data_quarter"), (F.col("id") % 7).alias("v"))
    df = df.repartition(3, "v")
    sinks.write_master(df, str(tmp_path / "m"))
    sinks.append_static(spark, df.drop("data_quarter"), str(tmp_path / "s"))
    assert shuffle_files(spark) <= kept and spark.conf.get(FREE_SHUFFLES, None) == was
    assert df.count() == spark.read.parquet(str(tmp_path / "m")).count() == spark.read.parquet(str(tmp_path / "s")).count() == 1000


@pytest.mark.parametrize("broadcast", ["-1", "10MB"])
def test_raw_files_are_small_and_gone_once_cleaned(spark, tmp_path, monkeypatch, broadcast):
    """Compressed lines, a loan's of a quarter in one file in ingest order; no row is dealt a second time for them."""
    import gzip
    from pathlib import Path

    from loanpanel.session import settings, shared_dir
    from verification import queries_macro as Q
    from verification import queries_panel as QP

    d = str(tmp_path / "sf")
    day = "TIMESTAMP '1995-01-01' + make_interval(0, 0, 0, cast({} AS int))"
    spark.range(20).selectExpr("id AS c_custkey", "cast(id % 25 AS int) AS c_nationkey", "id * 40e0 AS c_acctbal", "'BUILDING' AS c_mktsegment").write.parquet(f"{d}/customer.parquet")
    spark.range(100).selectExpr("id AS o_orderkey", "id % 20 AS o_custkey", "1e3 + id AS o_totalprice", day.format("id % 60") + " AS o_orderdate",
                                "concat(id % 5 + 1, '-X') AS o_orderpriority").write.parquet(f"{d}/orders.parquet")
    spark.range(2000).selectExpr("if(id % 2 = 0, 0, id % 100) AS l_orderkey", "id * 7 % 90 AS l_partkey", "id % 11 AS l_suppkey", "cast(id % 7 + 1 AS int) AS l_linenumber", "cast(id % 50 AS double) AS l_quantity",
                                 "9e2 + id AS l_extendedprice", "5e-2 AS l_discount", "1e-2 AS l_tax", "'N' AS l_returnflag", day.format("id * 37 % 400") + " AS l_shipdate").write.parquet(f"{d}/lineitem.parquet")
    shared = Path(shared_dir(spark).removeprefix("file:"))
    seen, real, kept = [], Q.clean_quarters, set(shared.glob("typed-*"))

    def clean_quarters(spark, folder, *rest):
        seen.extend([(p.parent.name, p.name, gzip.open(p, "rt").read().splitlines()) for p in sorted(Path(folder).glob("*/part-*.gz"))])
        seen.append(folder)
        real(spark, folder, *rest)

    monkeypatch.setattr(Q, "clean_quarters", clean_quarters)
    # a join that would deal the lines of the large loan to several tasks, if it might, or leave them where they were read
    odd = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": broadcast, "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
           "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.0"}
    with settings(spark, odd):
        rows = Q.pipeline_panel(spark, d).collect()
        want = {}
        for r in QP.raw_lines(spark, d, ["LOAN_ID"]).orderBy("seq1", "seq2", "seq3").collect():
            want.setdefault((f"quarter={r['data_quarter']}", r["LOAN_ID"]), []).append(r["value"])
    folder = Path(seen.pop())
    found = {}
    for quarter, name, lines in seen:
        for line in lines:
            found.setdefault((quarter, line.split("|")[QP.S.RAW_COLUMNS.index("LOAN_ID")]), {}).setdefault(name, []).append(line)
    assert {k: [v] for k, v in want.items()} == {k: list(v.values()) for k, v in found.items()}
    assert sum(r["n"] for r in rows) and not folder.exists()
    assert set(shared.glob("typed-*")) <= kept
