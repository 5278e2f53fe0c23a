"""Session helpers: checkpoint folder and scratch tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder of the cluster; a fresh local one only where Spark itself is local."""
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir")
    current = context._jsc.sc().getCheckpointDir()
    if not current.isDefined():
        if not configured and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        current = context._jsc.sc().getCheckpointDir()
    return configured or current.get()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path for a written intermediate table in the shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and continue from there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the checkpoint folder and continue from there; later steps read only the columns they need."""
    untyped = [f.name for f in df.schema if isinstance(f.dataType, T.NullType)]
    df = df.withColumns({c: F.col(c).cast("string") for c in untyped})
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks(spark: SparkSession) -> int:
    """A stated number of partitions for costly rows, as adaptive execution would merge their few bytes into one task."""
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
