"""Folders for tables that a query writes and reads back.

Lineage is cut by writing Parquet to the folder that all executors share and reading it back, never by a local
checkpoint: a lost executor then costs a re-read, not a wrong or failed result.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FOLDER = "spark.checkpoint.dir"
_LOCAL: list[str] = []
_RUN = f"tagloom-{uuid.uuid4().hex}"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where the setting is missing and Spark is local."""
    found = spark.sparkContext.getConf().get(_FOLDER) or spark.conf.get(_FOLDER, None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{_FOLDER} must name a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="tagloom-"))
    return f"file://{_LOCAL[0]}"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, of this process's run."""
    return f"{shared_dir(spark)}/{_RUN}/{name}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the table as read back."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def dropped(*tables: DataFrame | None) -> None:
    """Delete staged tables that no result reads any more; other tables are left alone."""
    for t in tables:
        if path := getattr(t, "_staged_at", None):
            _delete(t.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Delete every table this process has staged; call it when no result that reads them is needed any more."""
    _delete(spark, f"{shared_dir(spark)}/{_RUN}")
