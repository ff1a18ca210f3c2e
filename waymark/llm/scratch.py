"""Tables that cut lineage, in the folder all executors share, and filters by a bounded bitmap of ids."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import measured_joins

_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a temporary folder only where it is unset and all tasks run in this process."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if where:
        return where
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local:
        _local.append(f"file://{tempfile.mkdtemp(prefix='spark-')}")
    return _local[0]


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: later jobs read it, and a lost executor costs nothing but a re-read."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_by_size(df: DataFrame, name: str) -> DataFrame:
    """`written`, with joins that broadcast a side only by its measured size: for sides that grow with the corpus."""
    with measured_joins(df.sparkSession):
        return written(df, name)


def unused(name: str, *tables: DataFrame) -> str:
    """A column name that none of the tables has, in any case."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without_rows(df: DataFrame, key: Column, gone: DataFrame) -> DataFrame:
    """The rows of df, unchanged, whose key isn't in gone, a table of one column. Names may clash."""
    name = unused("_gone", df)
    return df.join(gone.toDF(name), key == F.col(name), "left_anti")


@contextmanager
def arrow_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs run inside hand Python at most so many rows at a time: for wide rows, whose batches would fill a worker's memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: Bits of the bitmap in `likely_in`: 2**23 bits are 1 MB, whatever the number of ids.
BITMAP_BITS = 23


def likely_in(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows of df whose key may be among ids (a column named as key), without moving df's rows.

    The ids are folded into a bitmap of fixed size (1 MB), which is all that is broadcast. Rows not among the ids may
    pass (all of them once the bitmap is full), so a join on the key has to follow; it then shuffles fewer texts.
    Null keys never pass.
    """
    n = 1 << BITMAP_BITS
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(n))
    bits = (
        ids.select(at(F.col(key)).alias("_bit"))
        .groupBy(F.shiftright("_bit", 15).alias("_part"))
        .agg(F.bitmap_construct_agg(F.col("_bit").bitwiseAND(32767)).alias("_map"))
    )
    probed = df.withColumn("_bit", at(F.col(key))).join(F.broadcast(bits), F.shiftright("_bit", 15) == F.col("_part"))
    byte = F.expr("cast(conv(hex(substring(_map, cast((_bit & 32767) >> 3 as int) + 1, 1)), 16, 10) as int)")
    return probed.where(byte.bitwiseAND(F.expr("shiftleft(1, cast(_bit & 7 as int))")) != 0).select(*df.columns)
