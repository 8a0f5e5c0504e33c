"""The fact table of the market queries: one row for each order line.

entity is the part's brand, family its type, market the supplier's nation, lens values
are unit prices in whole cents: advertised as listed, realized after discount,
official the part's price.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.sources.tables import table

OBS_SQL = """obs AS (
  SELECT p_brand AS entity, p_type AS family, n_name AS market, n_regionkey, CAST(year(l_shipdate) AS bigint) AS yr,
         strftime(l_shipdate, '%Y-%m') AS month, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag,
         p_size, floor(l_extendedprice * 100 / l_quantity) / 100 AS unit_price, floor(l_extendedprice * (1 - l_discount) * 100 / l_quantity) / 100 AS realized_price, p_retailprice
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with their dimensions. Columns that a query doesn't use are never read."""
    line, part, supplier, nation = (table(spark, sf_dir, t) for t in ("lineitem", "part", "supplier", "nation"))
    joined = line.join(part, F.col("l_partkey") == F.col("p_partkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return joined.select(
        F.col("p_brand").alias("entity"),
        F.col("p_type").alias("family"),
        F.col("n_name").alias("market"),
        "n_regionkey",
        F.year("l_shipdate").cast("long").alias("yr"),
        F.date_format("l_shipdate", "yyyy-MM").alias("month"),
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        "l_quantity",
        "l_returnflag",
        "p_size",
        (F.floor(F.col("l_extendedprice") * 100 / F.col("l_quantity")) / 100).alias("unit_price"),
        (F.floor(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 100 / F.col("l_quantity")) / 100).alias("realized_price"),
        "p_retailprice",
    )


def line_bound(spark: SparkSession, sf_dir: str) -> int:
    """The number of order lines, which bounds that of observations: from the files' footers."""
    return table(spark, sf_dir, "lineitem").count()
