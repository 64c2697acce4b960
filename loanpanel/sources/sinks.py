"""Parquet sinks: single tables, the quarterly master, the static master, tables by loan, exports."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanpanel.operators.panel import extend_static
from loanpanel.session import path_exists, scratch_path, shuffles_freed

ZSTD = {"compression": "zstd", "parquet.compression.codec.zstd.level": "3"}


def write_snappy(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "snappy").parquet(path)


def write_zstd(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(**ZSTD).parquet(path)


def write_master(df: DataFrame, path: str, rebalance: bool = True) -> None:
    """Write the quarters present in ``df``, replacing them and leaving all others alone.

    Rebalancing by quarter avoids many small files and splits an oversized quarter.  Without it no row
    moves: a task writes a file for each quarter it has, for rows that come from files by quarter.
    """
    if rebalance:
        df = df.hint("rebalance", "data_quarter")
    with shuffles_freed(df.sparkSession):
        (df.write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").options(**ZSTD)
         .partitionBy("data_quarter").parquet(path))


def read_master(spark: SparkSession, path: str) -> DataFrame:
    """The quarterly master; the quarter stays text whatever it looks like.

    Quarters written before a column was added have nulls in it.
    """
    df = spark.read.option("mergeSchema", "true").parquet(path)
    return df.withColumn("data_quarter", F.col("data_quarter").cast("string"))


def write_by_loan(df: DataFrame, table: str, buckets: int, path: str | None = None) -> DataFrame:
    """Store ``df`` as a catalogue table in ``buckets`` of the loan, and read it from there.

    Lags, loan aggregates and joins with a table of as many buckets then stay where their bucket is,
    however often the table is asked.  Rows are dealt by loan first, so a bucket is one file, sorted
    by loan (and age).  An existing table is replaced.  Files lie below ``path``, else below the
    cluster's shared folder.
    """
    order = [c for c in ("LOAN_ID", "time") if c in df.columns]
    path = path or scratch_path(df.sparkSession, table)
    (df.repartition(buckets, "LOAN_ID").write.mode("overwrite").options(**ZSTD).option("path", path)
     .bucketBy(buckets, "LOAN_ID").sortBy(*order).saveAsTable(table, format="parquet"))
    return df.sparkSession.table(table)


def append_static(spark: SparkSession, new: DataFrame, path: str) -> None:
    """Append the loans the static master does not hold yet (first occurrence wins).

    The two may differ in columns other than the loan; :func:`read_static` has them all.
    """
    if path_exists(spark, path):
        new = extend_static(read_static(spark, path), new)
    with shuffles_freed(spark):
        new.write.mode("append").options(**ZSTD).parquet(path)


def read_static(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(path)


def compact(spark: SparkSession, parts: Sequence[str], path: str, files: int | None = None) -> None:
    """Many part files or folders -> one table, evenly sized or with a given file count."""
    df = spark.read.parquet(*parts)
    df = df.repartition(files) if files else df.hint("rebalance")
    write_zstd(df, path)


def export_results(panel: DataFrame, summary: DataFrame | Callable[[DataFrame], DataFrame], base: str) -> dict[str, str]:
    """Write the panel and its loan summary; returns the two paths.

    ``summary`` may be a function of the panel: it then reads the written one.
    """
    paths = {"panel": f"{base}_panel", "loan_summary": f"{base}_loan_summary"}
    write_snappy(panel, paths["panel"])
    if callable(summary):
        summary = summary(panel.sparkSession.read.parquet(paths["panel"]))
    write_snappy(summary, paths["loan_summary"])
    return paths
