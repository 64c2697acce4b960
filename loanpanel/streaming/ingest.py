"""Incremental ingest of quarter files into the master, as Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loanpanel.operators.panel import dedup_last, encode_time_varying, keep_one
from loanpanel.session import is_complete, path_exists, remove_path
from loanpanel.sources.sinks import ZSTD, read_master, write_master


def merge_quarters(spark: SparkSession, batch: DataFrame, master: str, staging: str) -> None:
    """Replace the master's quarters that occur in ``batch`` by stored + new rows.

    A new row wins over a stored one of the same (LOAN_ID, time); a column that only one side
    has is null in the other's rows.  The merged quarters are first written to ``staging``, and
    a staged copy with its commit marker is reused on a retry, so a crash while the master's
    partitions are swapped loses nothing.  The copy is removed after the swap.
    """
    if not is_complete(spark, staging):
        merged = batch.withColumn("__new", F.lit(1))
        if path_exists(spark, master):
            # quarter labels: bounded by the calendar; literals prune the partitions
            quarters = [r[0] for r in batch.select("data_quarter").distinct().collect()]
            stored = read_master(spark, master).where(F.col("data_quarter").isin(quarters))
            merged = merged.unionByName(stored.withColumn("__new", F.lit(0)), allowMissingColumns=True)
            merged = keep_one(merged, ["LOAN_ID", "time", "data_quarter"], [F.desc("__new")])
        merged.drop("__new").write.mode("overwrite").options(**ZSTD).parquet(staging)
    write_master(spark.read.parquet(staging), master)
    remove_path(spark, staging)


def stream_quarters(source: DataFrame, master: str, checkpoint: str,
                    ingest: Sequence[str],
                    prepare: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Run every file not yet seen through encode + keep-last into the master, then stop.

    ``source`` is a streaming DataFrame of loan observations with ``data_quarter`` and the
    ``ingest`` order columns.  No watermark: files, not event time, drive the ingest.
    """
    def on_batch(batch: DataFrame, epoch: int) -> None:
        rows = prepare(batch) if prepare else batch
        rows = dedup_last(encode_time_varying(rows, extra=ingest), ingest).persist()
        merge_quarters(batch.sparkSession, rows, master, f"{checkpoint}/staged/{epoch}")
        rows.unpersist()

    return (source.writeStream.foreachBatch(on_batch)
            .option("checkpointLocation", f"{checkpoint}/state")
            .trigger(availableNow=True).start())
