"""Queries of listings, and of the map that a run writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.text import area_id
from plumbline.plans.registry import query
from plumbline.sources import listing, map_sink, pages
from plumbline.sources.star import read
from plumbline.tables import shared_path


def _listed(spark: SparkSession, sf: str) -> DataFrame:
    """The pages' paths, written as a listing and read through the source."""
    listing.register(spark)
    body = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", F.coalesce(F.octet_length("html"), F.lit(0)).cast("long").alias("bytes"), F.md5(F.coalesce("html", F.lit(""))).alias("hash"))
    root = shared_path(spark, "listing")
    listing.write(pages.paths(spark, sf).join(body, "page_id").select(F.col("path").alias("rel"), "hash", "bytes"), root)
    return spark.read.format(listing.NAME).option("path", root).option("sorted", "true").option("split_bytes", "262144").load()


_LISTED_SQL = f"WITH {pages.PAGES_SQL}, l AS (SELECT p.path AS rel, md5(coalesce(html, '')) AS hash, coalesce(strlen(html), 0)::BIGINT AS bytes FROM paths p JOIN pages g ON p.page_id = g.page_id)"


@query(f"{_LISTED_SQL} SELECT * FROM l")
def listed_paths(spark: SparkSession, sf: str) -> DataFrame:
    return _listed(spark, sf)


@query(f"{_LISTED_SQL} SELECT rel, bytes FROM l WHERE starts_with(rel, 'com/') AND rel < 'com/t' AND bytes >= 2000 AND right(hash, 1) <> '0'")
def listed_below(spark: SparkSession, sf: str) -> DataFrame:
    """A prefix, a bound and a size, which the source takes, and a condition that Spark applies."""
    return _listed(spark, sf).where("rel LIKE 'com/%' AND rel < 'com/t' AND bytes >= 2000 AND right(hash, 1) <> '0'").select("rel", "bytes")


@query("WITH t AS (SELECT n_name, count(*) AS n, substr(sha256(n_name), 1, 8) || '.md' AS name FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name) SELECT name, md5('# ' || n_name || chr(10) || n || ' customers' || CASE WHEN n % 3 = 0 THEN '' ELSE ', again' END || chr(10)) AS body FROM t WHERE n % 2 = 0")
def map_files(spark: SparkSession, sf: str) -> DataFrame:
    """What is left of a map that is written for all nations, then anew for some, then by a run that saw nothing."""
    there = read(spark, sf, "customer").join(read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count(F.lit(1)).alias("n"))
    text = lambda more: F.concat(F.lit("# "), "n_name", F.lit("\n"), F.col("n").cast("string"), F.lit(" customers"), more, F.lit("\n"))
    texts = lambda more: there.select("n", F.concat(area_id(F.col("n_name")), F.lit(".md")).alias("name"), text(more).alias("text"))
    root = shared_path(spark, "map")
    map_sink.write(spark, texts(F.lit("")), root)
    map_sink.write(spark, texts(F.when(F.col("n") % 3 == 0, "").otherwise(", again")).where("n % 2 = 0"), root)
    map_sink.write(spark, texts(F.lit(", unseen")), root, blind=True)
    left = spark.read.option("pathGlobFilter", "*.md").text(root, wholetext=True)
    return left.select(F.substring_index(F.col("_metadata.file_path"), "/", -1).alias("name"), F.md5("value").alias("body"))
