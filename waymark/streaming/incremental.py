"""Matching of addresses as they arrive: an addition to batch matching, resumable through a checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.scorers import LogisticRuleScorer
from ..plans.build import Register
from ..plans.match import Matching, match
from ..sources.catalog import table_exists


def match_stream(arriving: DataFrame, register: Register, out: str, checkpoint: str, scorer=LogisticRuleScorer(), settings: Matching = Matching()) -> StreamingQuery:
    """Matches all rows that have arrived (a streaming DataFrame with input_id and input_address) and ends.

    Results of each micro-batch go to a folder of its own below `out`, overwritten if the batch is repeated after a failure,
    so each input is matched once. Run it again for what arrives later.
    """

    def one(batch: DataFrame, number: int) -> None:
        rows = batch.dropDuplicates(["input_id"])
        match(rows, register, scorer, settings).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return arriving.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def unmatched(inputs: DataFrame, out: str) -> DataFrame:
    """Inputs without a result below `out` yet: resuming a batch run by what has been written."""
    spark = inputs.sparkSession
    if not table_exists(spark, out):
        return inputs
    return inputs.join(spark.read.parquet(out).select("input_id").distinct(), "input_id", "left_anti")
