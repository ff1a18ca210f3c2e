"""The registered queries of this subpackage: thin digests of what the operators return."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession

from . import bpe_codec
from .embed_dedup import embedding_digest
from .fim import fim_digest, fim_sql
from .hamming_topk import SEARCH_SQL, search_digest
from .html_text import extract_text
from .mixing import mixing_digest, mixing_sql
from .ngram_join import jaccard_components
from .quality import score_quality
from .scratch import shared_dir
from .source_audit import audit_sources, audit_sql
from .sp_codec import codec_digest
from .suffix_dedup import suffix_digest
from .token_ids import read_token_ids, write_token_ids
from .window_dedup import window_digest


def tokenizer_file(name: str) -> str:
    """Place of a public tokenizer file; the package that holds them is found only where it is installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents"), words=3, similarity=Fraction(9, 10))


def op2_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = f"{shared_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    write_token_ids(read(spark, sf_dir, "documents"), out, tokenizer_file("word_bpe_49k.json"), end_id=2)
    return read_token_ids(spark, out)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec_digest(read(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(read(spark, sf_dir, "pages"))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_digest(read(spark, sf_dir, "documents"))


def op7_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_digest(read(spark, sf_dir, "documents"))


def op7_mixing_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_digest(read(spark, sf_dir, "documents"), bounded=True)


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_digest(read(spark, sf_dir, "embeddings"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_digest(read(spark, sf_dir, "documents"))


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_digest(read(spark, sf_dir, "embeddings"))


def op11_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.codec_digest(read(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_sources(read(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim_digest(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join,
        op2_token_ids,
        op3_sentencepiece,
        op4_quality_classifier,
        op5_html_extraction,
        op6_suffix_array_dedup,
        op7_mixing_sources,
        op7_mixing_bounded,
        op8_embedding_near_dedup,
        op9_substring_dedup,
        op10_exact_top_k,
        op11_bpe_codec,
        op12_source_divergence,
        op13_fill_in_middle,
    )
}
ORACLE_SQL: dict[str, str] = {"op7_mixing_sources": mixing_sql(), "op10_exact_top_k": SEARCH_SQL, "op12_source_divergence": audit_sql(), "op13_fill_in_middle": fim_sql()}
