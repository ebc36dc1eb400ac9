"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A folder of its own below ``spark.checkpoint.dir``, removed when the driver ends; a local one only where all runs on this machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = f"{(shared or '/tmp/checkpoints/' + spark.sparkContext.applicationId).rstrip('/')}/spanloom/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df``, written and read again: its plan runs once, a lost executor costs only its running tasks."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Removes tables that ``kept`` gave; nothing may read them any more."""
    for t in tables:
        _remove(t.sparkSession, t._kept_path)


def _remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            _remove(spark, path)
        except Exception:  # the session has already ended
            return
