"""The star tables as sites: an order is a file, its priority the directory, a line item a site, a supplier an author."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.tables import dealt, stored

#: Dimension key -> (predicate, has a counter claim, languages, blind in stripped files).
DIMENSIONS = {
    "discount_cap": ("l_discount <= 0.09", True, ("F", "O"), False),
    "quantity_cap": ("l_quantity <= 46", False, ("F", "O", "P"), True),
    "returned_none": ("l_returnflag <> 'R'", True, ("F", "O", "P"), False),
    "tax_cap": ("l_tax < 0.08", False, ("F", "P"), False),
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """c_custkey, c_nationkey of all customers, stored in as many parts as there are cores: the table may be one split, and the
    files that customers stand for are made of it several times."""
    there = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return stored(dealt(there, there.count(), "c_custkey"), "customers")


def areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nationkey, area: region and nation as a path of two levels. A row a nation."""
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.concat_ws("/", "r_name", "n_name").alias("area"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rel (order), area, dir, lang (order status), stripped."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    customer = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    there = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(areas(spark, sf_dir), F.col("c_nationkey") == F.col("n_nationkey"))
    return there.select(F.col("o_orderkey").alias("rel"), "area", F.col("o_orderpriority").alias("dir"), F.col("o_orderstatus").alias("lang"), (F.col("o_orderkey") % 17 == 0).alias("stripped"))


def files_counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rel, area, dir, n, a count of conforming items by dimension, and authors: a row for each file with sites, from one pass
    over the line items. An order has a few items, so its authors are a short array; area is null without an order."""
    items = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("rel")).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.expr(p)).alias(k) for k, (p, *_) in DIMENSIONS.items()], F.collect_set("l_suppkey").alias("authors"))
    return items.join(files(spark, sf_dir).select("rel", "area", "dir"), "rel", "left")


AREAS_SQL = "areas AS (SELECT n_nationkey, r_name || '/' || n_name AS area FROM nation JOIN region ON n_regionkey = r_regionkey)"
FILES_SQL = f"""{AREAS_SQL},
files AS (SELECT o_orderkey AS rel, area, o_orderpriority AS dir, o_orderstatus AS lang, o_orderkey % 17 = 0 AS stripped
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN areas ON c_nationkey = n_nationkey)"""
SITES_SQL = f"""{FILES_SQL},
sites AS ({" UNION ALL ".join(f"SELECT area, dir, rel, l_suppkey AS author, '{k}' AS key, {p} AS conforming FROM lineitem JOIN files ON l_orderkey = rel" for k, (p, *_) in DIMENSIONS.items())})"""
