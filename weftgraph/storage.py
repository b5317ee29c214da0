"""Reading tables, cutting lineage in the shared folder, and broadcasts with a checked size."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of fixed-width keys up to which a side may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 500_000

_own: dict[str, str] = {}
_marked: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table's parquet; only Spark's reader opens it, so any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where that is unset (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if not base:
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="weftgraph-")
        base = _own[app]
    path = f"{base.rstrip('/')}/weftgraph/{app}"
    if path not in _marked:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
        _marked.add(path)
    return path


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder; it is removed when the application ends."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """df written as parquet to the shared folder and read again: lineage ends, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of results that are written; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def maybe_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows (counted, up to one beyond the bound), else df as it is.

    Only for narrow rows; df should be cheap to count, as a materialized table is.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
