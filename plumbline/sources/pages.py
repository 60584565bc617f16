"""Web pages as files of a tree: top-level domain, host and language are directories, the page number the file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_HOST = r"^https?://([^/?#]+)"
_LANG = r"^https?://[^/?#]+/([a-z]+)/"
_NUMBER = r"^https?://[^/?#]+/[a-z]+/([0-9]+)"


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, path, dir, host, lang, number of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    host, lang, number = (F.regexp_extract("url", p, 1) for p in (_HOST, _LANG, _NUMBER))
    there = pages.select("page_id", host.alias("host"), lang.alias("lang"), number.alias("number"))
    dir_ = F.concat_ws("/", F.substring_index("host", ".", -1), "host", "lang")
    return there.select("page_id", F.concat(dir_, F.lit("/"), F.col("number"), F.lit(".html")).alias("path"), dir_.alias("dir"), "host", "lang", "number")


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, lang, module: what each page links to, a row a link."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    each = F.explode(F.regexp_extract_all("html", F.lit(r'href="/([^"]*)"'), F.lit(1)))
    return pages.select("page_id", F.regexp_extract("url", _LANG, 1).alias("lang"), each.alias("module"))


PAGES_SQL = f"""raw AS (SELECT page_id, html, regexp_extract(url, '{_HOST}', 1) AS host, regexp_extract(url, '{_LANG}', 1) AS lang, regexp_extract(url, '{_NUMBER}', 1) AS number FROM pages),
paths AS (SELECT page_id, split_part(host, '.', -1) || '/' || host || '/' || lang || '/' || number || '.html' AS path,
  split_part(host, '.', -1) || '/' || host || '/' || lang AS dir, split_part(host, '.', -1) AS tld, host, lang, number FROM raw)"""
LINKS_SQL = f"""{PAGES_SQL},
links AS (SELECT page_id, lang, unnest(regexp_extract_all(html, 'href="/([^"]*)"', 1)) AS module FROM raw)"""
ABOVE_SQL = "above AS (SELECT DISTINCT dir, unnest(['.', tld, tld || '/' || host, dir]) AS path FROM paths)"
