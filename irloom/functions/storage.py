"""Materialisation in storage that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, a local one if driver and executors are one process; else an error,
    since executors of a cluster would write where nobody else reads."""
    found = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not found:
        context = spark.sparkContext
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = _OWN.get(context.applicationId) or "file://" + tempfile.mkdtemp(prefix="irloom-")
        _OWN[context.applicationId] = found
    return found.rstrip("/")


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/irloom-{spark.sparkContext.applicationId}"


def materialise(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and lost executors cost no recomputation of df."""
    path = f"{_own_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=partition_by)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete what this application has materialised. Results not yet read may need it: call it when they are written."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
