"""Reading registers, addresses and lookups; writing results. All columns are text, and blanks are ''."""

from __future__ import annotations

import csv
import io
import os
import sqlite3
import tempfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import DELIVERY_POINT, RAW_COLUMNS, raw_schema

LAYER = "delivery_point_address"
CHUNK = 10_000


class UnknownFormat(ValueError):
    """The file is none of the formats of a register."""


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with header; an unnamed index column is dropped."""
    df = spark.read.csv(path, header=True, inferSchema=False, escape='"')
    return df.drop(*[c for c in df.columns if c in ("", "_c0") or c.startswith("Unnamed")]).na.fill("")


def read_headerless_csv(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    """The first columns of the configured names, as many as the file has."""
    width = len(spark.read.csv(path, header=False, inferSchema=False, escape='"').columns)
    return spark.read.schema(raw_schema((names or RAW_COLUMNS)[:width])).csv(path, header=False, escape='"').na.fill("")


def _csv_rows(data: io.BufferedIOBase, names: list[str], only: str | None) -> Iterator[pd.DataFrame]:
    rows: list[list[str]] = []
    for row in csv.reader(io.TextIOWrapper(data, "utf-8", errors="replace", newline="")):
        if row and (only is None or row[0] == only):
            rows.append([v or "" for v in (row + [""] * len(names))[: len(names)]])
        if len(rows) >= CHUNK:
            yield pd.DataFrame(rows, columns=names)
            rows = []
    if rows:
        yield pd.DataFrame(rows, columns=names)


def _geopackage_rows(content: bytes, names: list[str]) -> Iterator[pd.DataFrame]:
    with tempfile.TemporaryDirectory() as folder:
        path = os.path.join(folder, "r.gpkg")
        with open(path, "wb") as f:
            f.write(content)
        db = sqlite3.connect(path)
        try:
            cursor = db.execute(f"SELECT * FROM {LAYER}")
            have = {d[0].upper(): i for i, d in enumerate(cursor.description)}
            while rows := cursor.fetchmany(CHUNK):
                text = lambda v: "" if v is None or v != v else str(int(v)) if isinstance(v, float) else str(v)
                yield pd.DataFrame([[text(r[have[c]]) if c in have else "" for c in names] for r in rows], columns=names)
        finally:
            db.close()


def _archive_rows(names: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    members = [m for m in z.namelist() if not m.endswith("/")]
                    for m in members:
                        if m.lower().endswith(".gpkg"):
                            yield from _geopackage_rows(z.read(m), names)
                        elif m.lower().endswith(".zip"):
                            with zipfile.ZipFile(io.BytesIO(z.read(m))) as inner:
                                for n in inner.namelist():
                                    if n.lower().endswith(".csv"):
                                        yield from _csv_rows(inner.open(n), names, DELIVERY_POINT)
                        elif m.lower().endswith(".csv"):
                            yield from _csv_rows(z.open(m), names, None)

    return run


def read_archive(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    """Zip files of CSVs (all records), of zips of CSVs (delivery points only) or of GeoPackages; one task for each archive."""
    schema = raw_schema(names)
    files = spark.read.format("binaryFile").load(path).select("content").repartition(64)
    return files.mapInPandas(_archive_rows(schema.names), schema)


def read_register(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    """A register in any of its formats, told by name and first cell."""
    low = path.lower().rstrip("/*")
    if low.endswith(".zip"):
        return read_archive(spark, path, names)
    if low.endswith((".csv", ".csv.gz")):
        head = spark.read.text(path).first()
        if head is not None and head[0].split(",")[0].strip('"') == DELIVERY_POINT:
            return read_headerless_csv(spark, path, names)
        return read_csv(spark, path)
    raise UnknownFormat(path)


def read_addresses(source: DataFrame | str, spark: SparkSession | None = None, *needed: str) -> DataFrame:
    """A DataFrame or the path of a CSV with input_id and input_address (and what else is needed)."""
    if isinstance(source, str):
        df = spark.read.csv(source, header=True, inferSchema=False, escape='"')
    elif isinstance(source, DataFrame):
        df = source
    else:
        raise TypeError(f"neither a DataFrame nor a path: {type(source).__name__}")
    missing = [c for c in ("input_id", "input_address", *needed) if c not in df.columns]
    if missing:
        raise ValueError(f"input lacks columns {missing}")
    return df


def read_covariates(spark: SparkSession, path: str) -> DataFrame:
    """postcode, urban_rural, deprivation_rank: the first row of each postcode in the order of the other two."""
    names = {"Postcode": "postcode", "UrbanRural8Fold2020Code": "urban_rural", "ScottishIndexOfMultipleDeprivation2020Rank": "deprivation_rank"}
    df = spark.read.csv(path, header=True, inferSchema=False).select(*names).withColumnsRenamed(names)
    first = Window.partitionBy("postcode").orderBy("urban_rural", "deprivation_rank")
    return df.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def read_multipliers(spark: SparkSession, path: str | None) -> DataFrame | None:
    """key, max_level, max_flat of buildings; None where there is no file."""
    return None if path is None else spark.read.csv(path, header=True, inferSchema=False).toDF("key", "max_level", "max_flat")


def write_csv(df: DataFrame, path: str, compressed: bool = True) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').option("compression", "gzip" if compressed else "none").csv(path)
