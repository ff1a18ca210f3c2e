"""Joins of the corpus operators broadcast a side only by its measured size; what Spark guesses of compressed files may be far too low."""

import re
from fractions import Fraction

import pytest
from pyspark.sql import readwriter

from waymark.llm.ngram_join import jaccard_components
from waymark.llm.suffix_dedup import suffix_digest

GUESSED, FOUND = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def plans(monkeypatch):
    """Plans of all tables written, as they are before anything is measured."""
    seen, parquet = [], readwriter.DataFrameWriter.parquet

    def spy(self, *args, **more):
        seen.append(planned(self._df))
        return parquet(self, *args, **more)

    monkeypatch.setattr(readwriter.DataFrameWriter, "parquet", spy)
    return seen


def guessed_broadcasts(plan: str) -> list[str]:
    """Broadcast joins of a plan but those with the bitmap of ids, whose size is fixed."""
    return [line for line in plan.splitlines() if re.search("Broadcast(Hash|NestedLoop)Join", line) and "shiftright" not in line]


def texts(spark):
    words = [f"w{i:03d}x" for i in range(150)]
    rows = [(i, " ".join(words[i % 7 :] + [f"own{i}"])) for i in range(40)] + [(100, " ".join(words)), (101, " ".join(words))]
    return spark.createDataFrame(rows, "doc_id bigint, text string")


@pytest.mark.parametrize("operator", [suffix_digest, lambda d: jaccard_components(d, 3, Fraction(9, 10))], ids=["op6", "op1"])
def test_no_broadcast_by_guessed_size(spark, plans, operator):
    before = spark.conf.get(GUESSED, None), spark.conf.get(FOUND, None)
    out = operator(texts(spark))
    assert out.count() == 42 and (spark.conf.get(GUESSED, None), spark.conf.get(FOUND, None)) == before
    joins = sum(len(re.findall("Join ", p)) for p in plans)
    assert joins > 3 and not [line for p in [*plans, planned(out)] for line in guessed_broadcasts(p)]
