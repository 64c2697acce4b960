"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "loanpanel", master: str | None = None, **conf) -> SparkSession:
    """A session with adaptive execution, skew handling and UTC dates.

    On a cluster ``master`` stays unset and comes from spark-submit; anything the
    cluster configures (shuffle partitions, memory, checkpoint folder) is left alone.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
    }
    for key, value in {**defaults, **conf}.items():
        b = b.config(key, value)
    return b.getOrCreate()


_LOCAL_DIR: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``).

    Only a local session (tests) may fall back to a temporary folder, since there
    driver and executors share one file system.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    if not _LOCAL_DIR:
        _LOCAL_DIR.append(tempfile.mkdtemp(prefix="loanpanel-"))
    return _LOCAL_DIR[0]


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the folder of ``spark.checkpoint.dir`` and go on from the copy.

    What follows may use it several times; a lost executor costs a reread, not the lineage.
    A folder is set here only if the session has none, as in tests.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def settings(spark: SparkSession, values: Mapping[str, str]) -> Iterator[None]:
    """The session's settings ``values`` hold inside, and those from before again after it."""
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def shuffles_freed(spark: SparkSession):
    """The shuffle files of a write inside go when it has ended.

    Otherwise they stay on the executors' disks until the driver happens to collect its garbage. Each write
    plans its rows anew, so no later one misses them.
    """
    return settings(spark, {FREE_SHUFFLES: "true"})


def stored(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` to Parquet below the shared folder, or at ``path``, and go on from the copy.

    For wide tables that are read several times, a few columns at a time.
    """
    path = path or scratch_path(df.sparkSession, name)
    with shuffles_freed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` exists, in whatever file system it names."""
    place, files = _file_system(spark, path)
    return files.exists(place)


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether the table at ``path`` was written to its end: its commit marker is there."""
    return path_exists(spark, f"{path.rstrip('/')}/_SUCCESS")


def remove_path(spark: SparkSession, path: str) -> None:
    place, files = _file_system(spark, path)
    files.delete(place, True)


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for one result below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
