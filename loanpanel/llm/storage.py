"""Lineage cuts in the cluster's shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanpanel.session import cut, scratch_path

__all__ = ["cut", "read", "sent_if_small", "shared_table"]

SENT_BYTES = 64 << 20  # most bytes of a table sent along


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as compressed Parquet below the shared folder and read it back.

    For results too large for a checkpoint's plain rows.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _width(kind: T.DataType, value: Column) -> Column:
    """Bytes of a value in a row of a broadcast table."""
    if isinstance(kind, T.StructType):
        return sum((_width(f.dataType, value.getField(f.name)) for f in kind.fields), F.lit(16))
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.size(value), F.lit(0)) * 8 + 16  # of numbers
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 16
    return F.lit(8)


def sent_if_small(df: DataFrame, most: int = SENT_BYTES) -> DataFrame:
    """``df`` written once, and broadcast to joins if its rows have at most ``most`` bytes.

    Larger tables are joined by shuffle. Arrays, if any, hold numbers.
    """
    df = cut(df)
    row = sum((_width(f.dataType, F.col(f.name)) for f in df.schema.fields), F.lit(32))
    return F.broadcast(df) if (df.agg(F.sum(row)).first()[0] or 0) <= most else df


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
