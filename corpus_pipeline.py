"""A training-data pipeline of five stages over `documents`; each is written as Parquet and read again by the next.

Order: documents that the quality classifier rejects go; one document (the smallest id) of each group of near copies stays
(word 5-shingles, Jaccard similarity 0.8 or more); 50-word passages that an earlier document has are cut, and
documents of which nothing is left go; sources, languages and topics are mixed to tempered shares; what is kept is
encoded. All but the last stage return the columns of documents, extra ones included.

Null and empty texts: scored as they are, in no group, without passages (so they go at the third stage). Rows with a null
doc_id are in no group and lose no passage. Rows that share a doc_id are judged each by its own text; equal rows share one
fate at every stage. Empty tables give empty tables; texts are taken whole.
"""

from __future__ import annotations

import uuid
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.mixing import Mix, sample_mix
from waymark.llm.ngram_join import keep_first_of_groups
from waymark.llm.quality import keep_good
from waymark.llm.queries import tokenizer_file
from waymark.llm.scratch import shared_dir
from waymark.llm.sp_codec import encode
from waymark.llm.window_dedup import dedup_windows

#: Milder shares than the operator's default: most documents of every cell stay.
MIX = Mix(temper=(0.8, 0.9, 0.9), fraction=0.9)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_first_of_groups(docs, words=5, similarity=Fraction(4, 5))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup_windows(docs).where(F.length("text") > 0)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sample_mix(docs, MIX)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode(docs, tokenizer_file("piece_bpe_32k.model"), k=2)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_copies),
    ("substring dedup", passages),
    ("mixing sources to target weights", mixing),
    ("SentencePiece encoding and decoding", pieces),
]

#: The classifier's scores and the piece model can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each from what the one before has written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        path = f"{shared_dir(spark)}/{name.split()[0].lower()}-{uuid.uuid4().hex}"
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
