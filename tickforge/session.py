"""Sessions, shared storage and size-checked broadcasts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side of a join may be broadcast after its count was taken.
BROADCAST_ROWS = 100_000


def get_session(cores: int | None = None, app: str = "tickforge") -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    cores = cores or os.cpu_count() or 4
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a local session may make its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="tickforge-")
        atexit.register(shutil.rmtree, own, True)
        found = "file://" + own
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Folders that materialize wrote and release has not removed yet.
_WRITTEN: list[str] = []


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again: cuts the lineage, survives lost executors. The folder stays, since the result
    is read later, until ``release`` or the end of the session."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Removes the intermediate folders of the queries run so far, whose results must have been written or collected; how many there were."""
    n = len(_WRITTEN)
    for path in _WRITTEN:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _WRITTEN.clear()
    return n


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if a count (which stops at the limit) proves it small, else df for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def micros(column: str):
    """Microseconds since 1970 UTC of a timestamp column, with or without zone (without zone means UTC)."""
    return F.unix_micros(F.col(column).cast("timestamp"))
