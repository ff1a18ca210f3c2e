"""A deterministic world of addresses over the test tables customer and orders, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import RAW_COLUMNS

DELIVERY_POINT = """
SELECT cast(1000000 + c_custkey AS string) AS UPRN,
       CASE WHEN c_custkey % 7 = 0 THEN upper(c_mktsegment) || ' SUPPLIES' ELSE '' END AS ORGANISATION_NAME,
       '' AS DEPARTMENT_NAME,
       CASE c_custkey % 6 WHEN 0 THEN 'FLAT ' || cast(c_custkey % 4 + 1 AS string)
                          WHEN 1 THEN cast(c_custkey % 3 + 1 AS string) || 'F' || cast(c_custkey % 2 + 1 AS string)
                          WHEN 2 THEN 'GROUND FLOOR LEFT'
                          WHEN 3 THEN 'TOP FLOOR RIGHT' ELSE '' END AS SUB_BUILDING_NAME,
       CASE WHEN c_custkey % 11 = 0 THEN '12-18' WHEN c_custkey % 13 = 0 THEN '3A-3D'
            WHEN c_custkey % 17 = 0 THEN 'ROWAN HOUSE' ELSE '' END AS BUILDING_NAME,
       CASE WHEN c_custkey % 11 = 0 OR c_custkey % 13 = 0 THEN '' ELSE cast(c_custkey % 12 + 1 AS string) END AS BUILDING_NUMBER,
       '' AS DEPENDENT_THOROUGHFARE,
       CASE cast(floor(c_custkey / 12.0) AS bigint) % 5 WHEN 0 THEN 'ALDER ROAD' WHEN 1 THEN 'BIRCH STREET'
            WHEN 2 THEN 'CEDAR LANE' WHEN 3 THEN 'DAMSON TERRACE' ELSE 'ELM PARK GARDENS' END AS THOROUGHFARE,
       '' AS DOUBLE_DEPENDENT_LOCALITY,
       CASE WHEN cast(floor(c_custkey / 12.0) AS bigint) % 3 = 0 THEN 'NETHERBY' ELSE '' END AS DEPENDENT_LOCALITY,
       CASE cast(floor(c_custkey / 60.0) AS bigint) % 4 WHEN 0 THEN 'ASHTOWN' WHEN 1 THEN 'BRACKENHAM'
            WHEN 2 THEN 'CORRIEMUIR' ELSE 'DUNFELL' END AS POST_TOWN,
       CASE cast(floor(c_custkey / 60.0) AS bigint) % 4 WHEN 0 THEN 'AB' WHEN 1 THEN 'BX' WHEN 2 THEN 'CM' ELSE 'D' END
         || cast(cast(floor(c_custkey / 60.0) AS bigint) % 9 + 1 AS string) || ' '
         || cast(cast(floor(c_custkey / 12.0) AS bigint) % 9 + 1 AS string)
         || chr(cast(65 + cast(floor(c_custkey / 12.0) AS bigint) % 26 AS int))
         || chr(cast(65 + cast(floor(c_custkey / 312.0) AS bigint) % 26 AS int)) AS POSTCODE
FROM customer
"""
INPUT_ADDRESS = """
SELECT o.o_orderkey AS input_id,
       CASE o.o_orderkey % 5
         WHEN 0 THEN d.SUB_BUILDING_NAME || ', ' || d.BUILDING_NUMBER || ' ' || d.THOROUGHFARE || ', ' || d.POST_TOWN || ', ' || d.POSTCODE
         WHEN 1 THEN lower(d.BUILDING_NUMBER || ' ' || d.SUB_BUILDING_NAME || ' ' || d.THOROUGHFARE || ' ' || d.POST_TOWN) || ' ' || replace(d.POSTCODE, ' ', '')
         WHEN 2 THEN d.BUILDING_NUMBER || ' ' || d.THOROUGHFARE || ', ' || d.POST_TOWN
         WHEN 3 THEN d.ORGANISATION_NAME || '; ' || d.BUILDING_NAME || ' // ' || d.BUILDING_NUMBER || ' ' || d.THOROUGHFARE || ' -- ' || d.POSTCODE
         ELSE d.BUILDING_NUMBER || ' ' || d.POST_TOWN END AS input_address,
       CASE WHEN o.o_orderkey % 10 = 9 THEN NULL
            WHEN o.o_orderkey % 10 = 8 THEN cast(1000000 + o.o_custkey + 1 AS string)
            ELSE d.UPRN END AS uprn
FROM orders o JOIN delivery_point d ON d.UPRN = cast(1000000 + o.o_custkey AS string)
"""
WITH_WORLD = f"WITH delivery_point AS ({DELIVERY_POINT}), input_address AS ({INPUT_ADDRESS})"


def delivery_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.read.parquet(f"{sf_dir}/customer.parquet").createOrReplaceTempView("customer")
    return spark.sql(DELIVERY_POINT)


def input_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    delivery_points(spark, sf_dir).createOrReplaceTempView("delivery_point")
    spark.read.parquet(f"{sf_dir}/orders.parquet").createOrReplaceTempView("orders")
    return spark.sql(INPUT_ADDRESS)


def raw_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The delivery points in the register's full layout."""
    points = delivery_points(spark, sf_dir)
    return points.select(*[F.col(c) if c in points.columns else F.lit("").alias(c) for c in RAW_COLUMNS])
