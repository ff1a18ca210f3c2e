"""Intermediate tables in the folder that all executors share, to cut lineage between rounds."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []


def staging_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a temporary folder only where it is unset and all tasks run in this process."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if where:
        return where
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local:
        _local.append(f"file://{tempfile.mkdtemp(prefix='spark-')}")
    return _local[0]


@contextmanager
def measured_joins(spark: SparkSession) -> Iterator[None]:
    """Jobs run inside broadcast a side of a join only once it is there and found to be small, by the bytes of its rows.

    Spark's guess before a job is the size of compressed files, scaled by the types of the columns read, and no more after an explode:
    a side of 10 MB by that guess can be more than the driver holds. The threshold itself stays what the session has.
    """
    guessed, found = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    before = {k: spark.conf.get(k, None) for k in (guessed, found)}
    spark.conf.set(found, before[found] or spark.conf.get(guessed))
    spark.conf.set(guessed, "-1")
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def staged(df: DataFrame, name: str) -> DataFrame:
    path = f"{staging_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with measured_joins(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
