"""Exact counts of distinct loans from bitmaps that can be merged.

Loans are numbered densely once, beside the static table, and the join that brings static columns
to the panel brings the number too. A bitmap covers 32,768 numbers, so a count by quarter moves at
most quarters x buckets bitmaps from each task instead of a row per loan and quarter. Bitmaps of
batches, quarters and states are combined by "or": a batch appended twice changes nothing, and older
quarters are not read again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanpanel.session import cut

NUMBER = "loan_no"
TASK_BITS = 33  # monotonically_increasing_id: the task's number above, the row's below


def number_loans(loans: DataFrame, known: DataFrame | None = None, key: str = "LOAN_ID") -> DataFrame:
    """``(key, loan_no)`` for every distinct loan that ``known`` lacks: 1, 2, ... behind its highest number.

    A null loan has no number. Numbers follow the order of a written copy, so tasks that run again
    give the same ones; the running total has one row per task.
    """
    new = loans.where(F.col(key).isNotNull()).select(key).distinct()
    if known is not None:
        new = new.join(known.select(key), key, "left_anti")
    rows = cut(new).withColumn("__id", F.monotonically_increasing_id())
    task = F.shiftright("__id", TASK_BITS)
    sizes = rows.groupBy(task.alias("__task")).agg(F.count("*").alias("__n"))
    earlier = Window.orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__task", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__start"))
    highest = F.lit(0) if known is None else F.coalesce(known.agg(F.max(NUMBER)).scalar(), F.lit(0))
    row = F.col("__id").bitwiseAND(F.lit((1 << TASK_BITS) - 1))
    return (rows.join(F.broadcast(starts), task == F.col("__task"))
            .select(key, (highest + F.col("__start") + row + 1).alias(NUMBER)))


def add_numbers(panel: DataFrame, numbers: DataFrame, key: str = "LOAN_ID") -> DataFrame:
    """The panel with ``loan_no``; loans without a number keep their rows."""
    return panel.join(numbers.select(key, NUMBER), key, "left")


def loan_bitmaps(numbered: DataFrame, keys: Sequence[str], **aggs: Column) -> DataFrame:
    """``(keys, bucket, loans)`` with further aggregates of the same rows.

    Rows without a number are in a null bucket, whose bitmap is empty.
    """
    n = F.col(NUMBER)
    return numbered.groupBy(*keys, F.bitmap_bucket_number(n).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(n)).alias("loans"),
        *[c.alias(name) for name, c in aggs.items()])


def merge_bitmaps(bitmaps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One bitmap per bucket of ``keys``, some or all of the keys the bitmaps were built by."""
    return bitmaps.groupBy(*keys, "bucket").agg(F.bitmap_or_agg("loans").alias("loans"))


def count_loans(bitmaps: DataFrame, keys: Sequence[str] = (), name: str = "loans") -> DataFrame:
    """Distinct loans by ``keys``; without keys one row, 0 for an empty table."""
    counts = merge_bitmaps(bitmaps, keys).groupBy(*keys).agg(F.sum(F.bitmap_count("loans")).alias(name))
    return counts.withColumn(name, F.coalesce(name, F.lit(0)))


def append_bitmaps(bitmaps: DataFrame, path: str) -> None:
    """Append a batch's bitmaps; a batch written again is merged away when the table is read."""
    bitmaps.write.mode("append").parquet(path)


def sums_and_loans(panel: DataFrame, keys: Sequence[str], sums: dict[str, Column], loans: str) -> DataFrame:
    """Sums (or counts as sums) by ``keys`` with the number of distinct loans.

    A panel with ``loan_no`` is counted by bitmaps: buckets share no loan, so their counts add up,
    and no row leaves its task. Without it loans are counted by value.
    """
    if NUMBER not in panel.columns:
        return panel.groupBy(*keys).agg(*[F.sum(c).alias(name) for name, c in sums.items()],
                                        F.count_distinct("LOAN_ID").alias(loans))
    buckets = loan_bitmaps(panel, keys, **{name: F.sum(c) for name, c in sums.items()})
    return buckets.groupBy(*keys).agg(*[F.sum(name).alias(name) for name in sums],
                                      F.sum(F.bitmap_count("loans")).alias(loans))
