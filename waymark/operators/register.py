"""Register side: deduplication, derived columns and vocabularies."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import register_mask, register_numbers
from ..functions.text import split_register_postcode
from ..schema import MACRO_FIELDS, MICRO_FIELDS, NUMBER_SLOTS, TEXT_FIELDS

VOCABULARY_FIELDS = ["THOROUGHFARE", "DOUBLE_DEPENDENT_LOCALITY", "DEPENDENT_LOCALITY", "POST_TOWN"]


def presence(fields: list[str]) -> Column:
    """One bit for each field: whether it has text."""
    return F.concat(*[F.when(F.length(c) > 0, "1").otherwise("0") for c in fields])


def tenement_count(df: DataFrame) -> DataFrame:
    """n_tenement: rows that share building number and postcode, else building name and postcode, where more than one; else 1.

    Counts come from an aggregate that is joined back, so a value shared by very many rows doesn't gather them in one task.
    """
    out = df
    for field, name in (("BUILDING_NUMBER", "_by_number"), ("BUILDING_NAME", "_by_name")):
        counts = df.where(F.length(field) > 0).groupBy(field, "POSTCODE").agg(F.count("*").alias(name)).where(F.col(name) > 1)
        out = out.join(counts, [field, "POSTCODE"], "left")
    return out.withColumn("n_tenement", F.coalesce("_by_number", "_by_name", F.lit(1)).cast("int")).select(*df.columns, "n_tenement")


@F.pandas_udf(T.ArrayType(T.StringType()))
def number_slots(sub: pd.Series, building: pd.Series, number: pd.Series) -> pd.Series:
    return pd.Series([register_numbers(a or "", b or "", c or "") for a, b, c in zip(sub, building, number, strict=True)])


@F.pandas_udf(T.ArrayType(T.StringType()))
def masked_fields(rows: pd.DataFrame) -> pd.Series:
    return pd.Series([[register_mask(v or "") for v in row] for row in rows.itertuples(index=False)])


def derive(raw: DataFrame, label: str = "0") -> DataFrame:
    """raw (blanks '') without repeated rows, with the derived columns."""
    df = tenement_count(raw.dropDuplicates())
    df = df.withColumn("ex_label", F.lit(label))
    return number_columns(df)


def number_columns(df: DataFrame) -> DataFrame:
    """Presence bits, number slots and postcode parts."""
    slots = number_slots("SUB_BUILDING_NAME", "BUILDING_NAME", "BUILDING_NUMBER")
    out = df.drop(*NUMBER_SLOTS).withColumn("_slots", slots)
    out = out.withColumns({c: F.col("_slots")[i] for i, c in enumerate(NUMBER_SLOTS)} | {"type_of_micro": presence(MICRO_FIELDS), "type_of_macro": presence(MACRO_FIELDS)})
    return out.withColumns(split_register_postcode("POSTCODE")).drop("_slots")


def bad_postcodes(df: DataFrame) -> DataFrame:
    """Derived rows whose postcode doesn't parse: they are kept, and can be looked at here."""
    return df.where("pc0 = ''")


def with_masks(df: DataFrame) -> DataFrame:
    """masked: the ten text fields with number-likes hidden, once for each register row; row_key orders equal candidates."""
    key = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in sorted(df.columns)])
    return df.withColumn("masked", masked_fields(F.struct(*TEXT_FIELDS))).withColumn("row_key", key)


def vocabulary_by_outward(indexed: DataFrame) -> DataFrame:
    """(pc0, field, value): distinct non-blank values of the place fields in each outward code."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in VOCABULARY_FIELDS])).alias("p")
    return indexed.select("pc0", pairs).where("p.value != '' and pc0 != ''").select("pc0", "p.field", "p.value").distinct()


def vocabulary_map(values: DataFrame) -> DataFrame:
    """(pc0, vocabulary map<field, array<value>>), the form that parsing joins."""
    lists = values.groupBy("pc0", "field").agg(F.array_sort(F.collect_set("value")).alias("values"))
    return lists.groupBy("pc0").agg(F.map_from_entries(F.collect_list(F.struct("field", "values"))).alias("vocabulary"))


def vocabulary_global(raw: DataFrame, fields: tuple[str, ...] = ("THOROUGHFARE", "DEPENDENT_LOCALITY", "POST_TOWN")) -> DataFrame:
    """(field, value): distinct non-blank values of a whole register."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])).alias("p")
    return raw.select(pairs).where("p.value != ''").select("p.field", "p.value").distinct()


__all__ = ["bad_postcodes", "derive", "number_columns", "number_slots", "presence", "tenement_count", "vocabulary_by_outward", "vocabulary_global", "vocabulary_map", "with_masks"]
