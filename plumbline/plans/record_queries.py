"""Queries of what was read: records, attempts, and counts that leave out what could not be read."""

from __future__ import annotations

import os
import signal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.api import Engine
from plumbline.operators import slots, tallies
from plumbline.plans.registry import query
from plumbline.sources import ledger
from plumbline.tables import stored

_MAX = 20_000


def _sentences(rel: str, lang: str, text: str, attempt: int) -> tuple[str, list[dict]]:
    """A node a line of a text. A text with an odd number of `#` is rejected; some texts end the reader, some of them at
    their first attempt only."""
    blanks = text.count(" ")
    if blanks % 23 == 22 or (blanks % 19 == 18 and attempt == 1):
        os.kill(os.getpid(), signal.SIGKILL)
    if text.count("#") % 2:
        return "rejected", []
    return "ok", [{"pre": i, "post": i, "depth": 0, "type": "Line", "name": None, "above": [], "fn": None, "cls": None, "line": i + 1, "attrs": []} for i in range(text.count("\n") + 1)]


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as files: a source is an area, a language a language, and every 31st cannot be read at all."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = F.when(F.col("doc_id") % 31 != 0, F.col("text"))
    return docs.select(F.col("doc_id").cast("string").alias("rel"), "lang", "source", F.length("text").alias("bytes"), text.alias("content"))


def _records(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.Ledger(spark, max_bytes=_MAX).settle(_documents(spark, sf), ledger.reading(_sentences, isolated=True))


_RECORDS_SQL = f"""f AS (SELECT doc_id, lang, source, text, length(text) - length(replace(text, ' ', '')) AS blanks, length(text) - length(replace(text, '#', '')) AS marks, length(text) - length(replace(text, chr(10), '')) + 1 AS lines FROM documents),
r AS (SELECT doc_id, lang, source, lines, CASE WHEN length(text) > {_MAX} THEN 'oversize' WHEN text IS NULL OR doc_id % 31 = 0 THEN 'unreadable' WHEN blanks % 23 = 22 THEN 'crashed' WHEN marks % 2 = 1 THEN 'rejected' ELSE 'ok' END AS kind,
  CASE WHEN length(text) > {_MAX} OR text IS NULL OR doc_id % 31 = 0 THEN 0 WHEN blanks % 23 = 22 OR blanks % 19 = 18 THEN 2 ELSE 1 END AS attempts FROM f)"""


@query(f"WITH {_RECORDS_SQL} SELECT doc_id, kind, attempts, CASE kind WHEN 'ok' THEN lines ELSE 0 END AS nodes FROM r")
def parse_records(spark: SparkSession, sf: str) -> DataFrame:
    """Each document's outcome: a reader that ends its process twice is quarantined, once is tried again."""
    return _records(spark, sf).select(F.col("rel").cast("long").alias("doc_id"), "kind", "attempts", F.coalesce(F.size(F.when(F.col("kind") == "ok", F.col("nodes"))), F.lit(0)).alias("nodes"))


@query(f"WITH {_RECORDS_SQL} SELECT source AS area, 'any' AS key, count(*)::BIGINT AS lang_files FROM r WHERE kind = 'ok' GROUP BY source UNION ALL SELECT source, 'latin', count(*) FROM r WHERE kind = 'ok' AND lang IN ('fr', 'es') GROUP BY source")
def read_denominators(spark: SparkSession, sf: str) -> DataFrame:
    """Files that a dimension divides by: those that were read, of its languages."""
    read = _records(spark, sf).where("kind = 'ok'").select("rel")
    there = _documents(spark, sf).join(read, "rel", "left_semi").select(F.col("source").alias("area"), "lang", F.lit(False).alias("stripped"))
    dims = spark.createDataFrame([("any", ["en", "de", "fr", "es"], False), ("latin", ["fr", "es"], False)], "key string, langs array<string>, blind boolean")
    return slots.denominators(there, dims)


@query(f"WITH {_RECORDS_SQL} SELECT kind, count(*)::BIGINT AS n FROM r WHERE kind <> 'ok' GROUP BY kind")
def unread_records(spark: SparkSession, sf: str) -> DataFrame:
    return tallies.unexamined(_records(spark, sf))


@query(f"WITH {_RECORDS_SQL}, n AS (SELECT count(*) AS files FROM documents) SELECT pass, count(*)::BIGINT AS answers FROM (SELECT unnest(CASE WHEN attempts = 0 THEN ['first 0'] WHEN attempts = 2 THEN ['first 1', 'first 2'] ELSE ['first 1'] END) AS pass FROM r UNION ALL SELECT 'again' FROM r WHERE doc_id % 2 = 1 AND attempts > 0) t GROUP BY pass")
def ledger_reuse(spark: SparkSession, sf: str) -> DataFrame:
    """What a ledger holds after a first run, and after another in which every second document has a line more."""
    files = _documents(spark, sf)
    book, measure = ledger.Ledger(spark, max_bytes=_MAX), ledger.reading(_sentences, isolated=True)
    book.settle(files, measure)
    first = stored(book.rows().groupBy(F.concat(F.lit("first "), F.col("attempt")).alias("pass")).agg(F.count(F.lit(1)).alias("answers")), "first")
    book.settle(files.withColumn("content", F.when(F.col("rel").cast("long") % 2 == 1, F.concat("content", F.lit("\n"))).otherwise(F.col("content"))), measure)
    again = book.rows().where(F.col("attempt") == 1).groupBy(F.lit("again").alias("pass")).agg(F.count(F.lit(1)).alias("answers"))
    return first.unionByName(again.crossJoin(first.where("pass = 'first 1'").select(F.col("answers").alias("before"))).select("pass", F.col("answers") - F.col("before")).toDF("pass", "answers"))


#: Files of code, one to a customer: every sixth has no content, every seventh is no longer what its reader takes.
_UNREAD = "c_custkey % 6 = 0"


@query(f"""WITH f AS (SELECT 'src/n' || c_nationkey AS area, {_UNREAD} AS unread FROM customer), floor AS (SELECT least(greatest(floor(sqrt(count(*)) / 6 + 0.5::DOUBLE), 3), 8) AS least FROM customer)
SELECT area, count(*) FILTER (WHERE NOT unread)::BIGINT AS lang_files, count(*) FILTER (WHERE NOT unread)::BIGINT AS applicability, count(*)::BIGINT AS area_files FROM f GROUP BY area HAVING count(*) >= (SELECT least FROM floor) AND count(*) FILTER (WHERE NOT unread) > 0""")
def engine_denominators(spark: SparkSession, sf: str) -> DataFrame:
    """A scan with files that cannot be read: they are files of their areas, and no slot divides by them."""
    engine = Engine(spark, tuple(d for d in Engine(spark).dims if d.key == "swallowed_error"))
    rel = F.concat(F.lit("src/n"), F.col("c_nationkey").cast("string"), F.lit("/f"), F.col("c_custkey").cast("string"), F.lit(".js"))
    files = spark.read.parquet(f"{sf}/customer.parquet").select(rel.alias("rel"), F.lit("js").alias("lang"), F.lit(False).alias("stripped"), F.when(~F.expr(_UNREAD), "try { run(); } catch (e) { report(e); }").alias("content"))
    return engine.scan(files, frameworks=()).slots.select("area", "lang_files", "applicability", "area_files")
