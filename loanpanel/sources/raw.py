"""Reading performance files, macro responses and Parquet tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanpanel import schemas as S

CSV_OPTIONS = {"sep": "|", "header": "false", "mode": "PERMISSIVE"}
QUARTER_IN_PATH = "([0-9]{4}Q[1-4])[^/]*(/[^/]*)?$"
INGEST_ORDER = ["ingest_split", "ingest_row"]


def read_raw(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Headerless pipe-delimited files as 110 text columns.

    Adds the quarter in the name of the file or of its folder, and the order of rows inside a
    file: the start of the split, then an id that grows within it.
    """
    df = spark.read.schema(S.RAW_SCHEMA).options(**CSV_OPTIONS).csv(paths)
    return df.withColumns({
        "data_quarter": F.regexp_extract("_metadata.file_path", QUARTER_IN_PATH, 1),
        "ingest_split": F.col("_metadata.file_block_start"),
        "ingest_row": F.monotonically_increasing_id()})


def quarter_glob(folder: str, quarters: Sequence[str], name: str = "{}.csv") -> str:
    """A path pattern for the quarters' files or folders; quarters without one are skipped.

    ``name`` has ``{}`` for the quarter.
    """
    return f"{folder.rstrip('/')}/{name.replace('{}', '{' + ','.join(quarters) + '}')}"


def parse_lines(df: DataFrame, text: str = "value") -> DataFrame:
    """Raw lines held in a text column -> the 110 text columns (other columns are kept)."""
    rest = [c for c in df.columns if c != text]
    ddl = ", ".join(f"`{c}` string" for c in S.RAW_COLUMNS)
    parsed = df.withColumn("__r", F.from_csv(text, ddl, {"sep": "|", "mode": "PERMISSIVE"}))
    return parsed.select("__r.*", *rest)


def input_files(df: DataFrame) -> DataFrame:
    """Files behind a file-based DataFrame with their size and row count."""
    return (df.groupBy(F.col("_metadata.file_path").alias("file"),
                       F.col("_metadata.file_size").alias("bytes"))
            .agg(F.count("*").alias("rows")))


def read_macro(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """One JSON response per series file -> ``(series_id, date, value)`` text rows.

    The series id is the file name without its suffix.
    """
    docs = (spark.read.schema(S.MACRO_RESPONSE_SCHEMA).option("multiLine", "true").json(paths)
            .withColumn("series_id", F.regexp_extract("_metadata.file_name", r"^(.*?)(\.[^.]*)?$", 1)))
    return explode_observations(docs)


def explode_observations(docs: DataFrame) -> DataFrame:
    return (docs.select("series_id", F.explode("observations").alias("o"))
            .select("series_id", "o.date", "o.value"))

