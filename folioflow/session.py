"""Session helpers shared by all operators: sessions, table access, lineage cuts and checked driver-side reads."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

_FALLBACK: dict[str, str] = {}
_WRITTEN: list[str] = []


def local_session(app: str = "folioflow", cores: int | str = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("FOLIOFLOW_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One parquet table of a data directory, a file or a directory of parts."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir where the cluster names one.

    Only where it is unset and the master is a local one, a temporary folder is used.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _FALLBACK.setdefault("dir", tempfile.mkdtemp(prefix="folioflow-"))


def cut(df: DataFrame) -> DataFrame:
    """Write df once as a parquet table in the shared folder and read it back.

    This cuts lineage like checkpoint(), survives the loss of executors, and keeps
    the columns compressed and prunable. Parts that read the result several times
    do not compute it again. The tables stay until release() is called.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/folioflow/{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete the tables that cut() has written in this process and say how many; what reads them must be done by then."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    n = 0
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        n += bool(path.getFileSystem(conf).delete(path, True))
    return n


def bounded_collect(df: DataFrame, max_rows: int, what: str) -> list[Row]:
    """Rows of a relation that must be small; raises instead of truncating when it is not."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"{what} holds more than {max_rows} rows; it is meant to be a small fixed table")
    return rows


def hash_sample(df: DataFrame, column: str, n: int, keep: Column | None = None, spare: int = 20) -> list:
    """At most n distinct values of a column that meet `keep`, those with the smallest hashes.

    The same values give the same sample. A bound on the hash, from the row count, thins the column to about spare * n rows
    before `keep` is tested and anything is sorted, and copies are folded first, so what the tasks send grows neither with
    the rows nor with their number; where `keep` is met more seldom than that, the sample is smaller. Nulls are left out.
    """
    at = F.abs(F.xxhash64("v") / 9.3e18)
    share = min(1.0, float(spare * n) / max(df.count(), 1))
    kept = df.select(F.col(f"`{column}`").alias("v")).filter(F.col("v").isNotNull() & (at < share))
    kept = kept.distinct() if keep is None else kept.filter(keep).distinct()
    return [r.v for r in kept.orderBy(at, "v").limit(n).collect()]


def tasks(spark: SparkSession, least: int = 1) -> int:
    """Partitions for shuffles in front of costly Python, which adaptive execution must not merge: pass it to repartition()."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def require(df: DataFrame, *columns: str) -> None:
    """Fail early, with names, when an operator's input lacks a column."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"input lacks the columns {missing}; it has {df.columns}")
