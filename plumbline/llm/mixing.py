"""Mixing sources to target weights: capped water-filling, then whole and fractional repetitions of documents.

Shares follow the weights until a source would exceed `epochs` times its own words; such sources are clamped there and
the excess goes to the others by weight, round by round, until none is above its cap. A round is one small aggregate
over one row per source; only its two sums come to the driver. The fractional repetition takes documents in seeded
order while they bring the source nearer its target. Their running sizes are summed in two levels, by (source, bucket
of the seeded order) and within the bucket, with as many buckets as the square root of a source's documents: a source
that holds most rows is dealt to many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm import common

WEIGHTS = (5, 2, 1)
EPOCHS = 3
SEED = 7


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """source, source_size, n_docs, target (double) from one row per document with source and size.

    Sources are ordered by code point, null last, and weigh `weights` in turn. Sizes are exact integers throughout, so
    a rerun gives the same targets.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.array(*[F.lit(int(w)) for w in weights])[F.pmod("at", F.lit(len(weights)))].cast("long")
    level = common.stored(by_source.withColumn("at", order).select("source", "source_size", "n_docs", weight.alias("weight")), "sources")

    cap = F.col("source_size") * epochs
    big = lambda x: x.cast("decimal(38,0)")

    def clamped(left: int, weighing: int) -> Column:
        return big(cap) * F.lit(weighing) < big(F.col("weight")) * F.lit(left)

    total, weighing = level.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    left = total
    while weighing:
        over = clamped(left, weighing)
        capped, free = level.agg(F.coalesce(F.sum(F.when(over, cap)), F.lit(0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0))).first()
        if (total - capped, free) == (left, weighing):
            break
        left, weighing = total - capped, free
    share = (big(F.col("weight")) * F.lit(left)).cast("double") / F.lit(float(max(weighing, 1)))
    target = F.when(clamped(left, weighing), cap.cast("double")).otherwise(share) if weighing else cap.cast("double")
    return level.select("source", "source_size", "n_docs", target.alias("target"))


def mix(docs: DataFrame, sizes: DataFrame | None = None, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """Every row of `docs` (doc_id, source, size; other columns are carried) with source_size, target and copies.

    `copies` is how often the mix takes the document, 0 to `epochs`. A source's taken words miss its target by half a
    document at most. A null source is a source of its own; documents without words are never taken; documents with
    the same doc_id follow in order of size, and rows equal in both are interchangeable. Columns source_size, target and copies that `docs` may have give way to the new ones; all other names
    are free. An empty table gives none.
    """
    level = targets(docs.select("source", "size") if sizes is None else sizes, weights, epochs)
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = docs.select(F.struct("*").alias("row"), "doc_id", "source", "size", key.alias("key"))
    there = rows.alias("d").join(level.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
    whole = F.when(F.col("source_size") > 0, F.least(F.lit(epochs), F.floor(F.col("target") / F.col("source_size")))).otherwise(0)
    place = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    bucket = F.floor(place * F.ceil(F.sqrt("n_docs")) / F.lit(2**32)).cast("long")
    # the same keys for the window and the join: rows, whatever they carry, are dealt once
    there = there.select("row", "doc_id", "size", "key", "source_size", "target", whole.cast("long").alias("whole"), bucket.alias("bucket"), F.coalesce("d.source", F.lit("")).alias("source"), F.col("d.source").isNull().alias("no_source"))
    by = ["source", "no_source", "bucket"]
    sums = there.groupBy(by).agg(F.sum("size").alias("sum"))
    before = sums.withColumn("before", F.coalesce(F.sum("sum").over(Window.partitionBy("source", "no_source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("sum")
    running = F.coalesce(F.sum("size").over(Window.partitionBy(by).orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    there = there.withColumn("running", running).join(before, by)
    more = F.col("target") - F.col("whole") * F.col("source_size")
    extra = (F.col("size") > 0) & (F.col("whole") < epochs) & (2 * (F.col("before") + F.col("running")) + F.col("size") <= 2 * more)
    copies = F.when(F.col("size") > 0, F.col("whole") + extra.cast("long")).otherwise(0)
    new = {"source_size": F.col("source_size"), "target": F.col("target"), "copies": copies}
    return there.select(*[F.col(f"row.`{c}`") for c in docs.columns if c.lower() not in new], *[c.alias(name) for name, c in new.items()])


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    slim = common.stored(docs.select("doc_id", "source", common.n_words(F.col("text")).alias("size")), "sizes")
    return mix(slim).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP3_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) END::BIGINT AS size FROM documents),
level AS (
  SELECT source, sum(size)::BIGINT AS source_size, [{", ".join(map(str, WEIGHTS))}][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)}] AS weight
  FROM sized GROUP BY source),
ranked AS (
  SELECT *, sum(source_size) OVER () AS total, row_number() OVER (ORDER BY source_size::DOUBLE / weight, source NULLS LAST) AS nth,
    sum({EPOCHS} * source_size) OVER (ORDER BY source_size::DOUBLE / weight, source NULLS LAST) - {EPOCHS} * source_size AS capped,
    sum(weight) OVER (ORDER BY source_size::DOUBLE / weight DESC, source DESC NULLS FIRST) AS weighing
  FROM level),
first_free AS (
  SELECT total - capped AS room, weighing, nth FROM ranked
  WHERE (total - capped)::HUGEINT * weight <= {EPOCHS} * source_size::HUGEINT * weighing ORDER BY nth LIMIT 1),
targets AS (
  SELECT source, source_size, CASE WHEN f.nth IS NULL OR r.nth < f.nth THEN ({EPOCHS} * source_size)::DOUBLE ELSE (weight::HUGEINT * room)::DOUBLE / weighing_all END AS target
  FROM ranked r LEFT JOIN (SELECT nth, room, weighing AS weighing_all FROM first_free) f ON true),
placed AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN least({EPOCHS}, floor(t.target / t.source_size))::BIGINT ELSE 0 END AS whole,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('{SEED}:' || coalesce(d.doc_id::VARCHAR, '')), d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS running
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (size * CASE WHEN size = 0 THEN 0 ELSE whole + CASE WHEN whole < {EPOCHS} AND 2 * running + size <= 2 * (target - whole * source_size) THEN 1 ELSE 0 END END)::BIGINT AS taken
FROM placed
"""
