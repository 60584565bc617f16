"""A training-corpus pipeline: quality classifier, near duplicates, personal data, mixing, packing.

Every stage takes (spark, docs, sf_dir), works on all rows that the stage before it kept, and is written as Parquet and
read again. All stages but the last return the columns of `docs`, whatever their names: what a stage adds meanwhile takes
names that are free, or stands beside a struct of the row. An empty table gives an empty one of the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import common, mixing, ngram_join, packing, pii, quality_model


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Null and empty texts are judged by the model's bias; equal texts are judged alike, so repeated rows stay or go
    together; a score of exactly 0.5 keeps a document; null ids are never training rows; very long texts are read whole.
    """
    model = quality_model.train(docs, common.table(spark, sf_dir, "labels"))
    score = common.unused(docs.columns, "score")
    return quality_model.scored(docs, model, score).where(F.col(f"`{score}`") >= 0.5).drop(score)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of the n-gram Jaccard join stays.

    Null texts and texts without words are no copies: all stay. Of rows that are equal in doc_id and text one stays, the
    first by its other columns as JSON. Null ids are documents like others; very long texts are compared whole.
    """
    return ngram_join.deduplicated(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each span of personal data in a text gives way to its kind in brackets; `n_chars`, if there, follows the text.

    Null texts stay null and keep their `n_chars`; empty texts stay empty; repeated rows and null ids are redacted each by
    itself; spans that overlap give way together, to the kind of the first; very long texts are redacted whole.
    """
    out = pii.redact(docs)
    if "n_chars" not in docs.columns:
        return out
    size = F.when(F.col("text").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.select(*[size.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document stands as often as the mix takes it, up to three times.

    Null and empty texts have no words and are never taken; a null source is a source of its own; rows that are equal in
    doc_id and size are interchangeable; null ids are documents like others.
    """
    words = common.n_words(F.col("text")).alias("size")
    sizes = common.stored(docs.select("source", words), "mix-sizes")
    mixed = mixing.mix(docs.select(F.struct("*").alias("document"), "doc_id", "source", words), sizes)
    return mixed.where("copies > 0").select("document", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("document.*")


def packing_plan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequence and place.

    Null and empty texts are one end id; every one of repeated rows is packed; null ids are kept; texts of over 2048 ids
    are cut, and all their pieces packed.
    """
    return packing.pack(docs, cache_words=150_000, slice_bytes=2_000_000)  # its workers share executors with those of four more stages


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixture", mixture), ("packing", packing_plan)]

#: No SQL expresses the classifier, the tokenizer or the join; tests/llm hold the stages against plainer versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
