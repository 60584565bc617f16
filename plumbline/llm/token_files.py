"""Token ids in Parquet files: list columns, dictionary and delta encoding, controlled row groups and page indexes.

Texts are encoded where they are read; what is put in order is their ids, in two bytes each where the vocabulary allows.

A file holds one shard of documents in ascending doc_id order: `doc_id`, `shard`, `start` (ids of the shard's documents
before it), `n_tokens` and the list `tokens`. Ids are dictionary-encoded, so they take the bits that the shard's
distinct ids need; the integer columns are delta-encoded where a dictionary does not pay. Small pages with column and
offset indexes let a reader fetch a few documents' ids, or the counts without any ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm import common, tokens
from plumbline.llm.packing import default_tokenizer

END_ID = 2
SCHEMA = "doc_id long, shard int, start long, n_tokens long, tokens array<int>"
FILE_OPTIONS = {
    "compression": "snappy",
    "parquet.writer.version": "v2",
    "parquet.block.size": str(16 << 20),
    "parquet.page.size": str(128 << 10),
    "parquet.page.row.count.limit": "1000",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#start": "false",
    "parquet.dictionary.page.size": str(2 << 20),
}


def _encoded(docs: DataFrame, tokenizer: str, end_id: int, kind: str) -> DataFrame:
    """doc_id, crc and ids (bytes of numbers of `kind`) of every text, the end id included, in the order of reading."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(tokenizer).encode
        for batch in batches:
            texts = batch.column(1)
            for a, b in tokens.in_slices(texts, tokens.SLICE_BYTES):
                ids, n = encode(texts[a:b])
                ids = np.insert(ids.astype(kind), np.cumsum(n), end_id)
                at = np.concatenate([[0], np.cumsum(n + 1)]) * ids.itemsize
                held = memoryview(ids).cast("B")
                sums = [zlib.crc32(held[i:j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                binary = pa.Array.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(at), pa.py_buffer(ids)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(sums, pa.int64()), binary], ["doc_id", "crc", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(common.lean(rows), "doc_id long, crc long, ids binary")


def _kind(tokenizer: str, end_id: int) -> str:
    """The narrowest numbers that hold all ids."""
    from tokenizers import Tokenizer

    return "<u2" if max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"


def ordered(made: DataFrame, kind: str) -> DataFrame:
    """Rows of the file format from stored ids, in ascending doc_id order over and within partitions.

    Documents of one id, or of none, are dealt by their ids and, where these are equal too, by their place in the stored
    table: rows that nothing tells apart, which may stand in any order.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, start, width = TaskContext.get().partitionId(), 0, np.dtype(kind).itemsize
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                held = part.column(1).cast(pa.large_binary())
                at = np.frombuffer(held.buffers()[1], np.int64, len(held) + 1, held.offset * 8)
                ids = np.frombuffer(held.buffers()[2], kind, int(at[-1] - at[0]) // width, int(at[0])).astype(np.int32)  # each row has the end id at least
                at = (at - at[0]) // width
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.full(len(part), shard, np.int32)), pa.array(start + at[:-1]), pa.array(np.diff(at)), lists], ["doc_id", "shard", "start", "n_tokens", "tokens"])
                start += int(at[-1])

    placed = made.withColumn("place", F.monotonically_increasing_id())
    return placed.repartitionByRange("doc_id", "crc", "place").sortWithinPartitions("doc_id", "crc").select("doc_id", "ids").mapInArrow(common.lean(rows), SCHEMA)


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID) -> None:
    """Encode whole texts, however long, and write them to `path`. Ids are stored before they are put in order, so that no
    text is encoded twice.

    Null or empty texts are the end id alone; null ids come first; repeated ids follow in order of their token ids' crc32,
    and repeated rows are rows of their own; columns other than doc_id and text are ignored, whatever their names; an
    empty table gives files without rows.
    """
    tokenizer = tokenizer or default_tokenizer()
    kind = _kind(tokenizer, end_id)
    made, at = common.stored_at(_encoded(docs, tokenizer, end_id, kind), "token-ids", compression="zstd")
    ordered(made, kind).write.options(**FILE_OPTIONS).parquet(path)
    common.removed(docs.sparkSession, at)


def _counted_over_all(rows: DataFrame, files: DataFrame) -> DataFrame:
    """`rows`, which have shard and start, with `start` counted over all files."""
    shards = files.groupBy("shard").agg(F.sum("n_tokens").alias("_n"))  # one row per file
    base = shards.select("shard", F.coalesce(F.sum("_n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    return rows.join(base, "shard").withColumn("start", F.col("start") + F.col("_base")).drop("_base", "shard")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows as they are. Only the columns that a caller selects are read, so counts cost no ids; a filter on
    doc_id reaches the row groups' statistics and the page indexes."""
    return spark.read.schema(SCHEMA).parquet(path)


def positions(files: DataFrame) -> DataFrame:
    """doc_id, start over all files, and n_tokens: none of the ids are read."""
    return _counted_over_all(files.select("doc_id", "shard", "start", "n_tokens"), files)


def digests(files: DataFrame) -> DataFrame:
    """doc_id, start over all files, n_tokens and the crc32 of each document's ids as little-endian unsigned 32-bit
    integers. Ids are summed up where they are read; none is shuffled."""

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(4)
            ids, at = lists.values.to_numpy().astype("<u4"), lists.offsets.to_numpy()
            sums = [zlib.crc32(ids[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(sums, pa.int64())], [*batch.schema.names[:4], "ids_crc32"])

    summed = files.select("doc_id", "shard", "start", "n_tokens", "tokens").mapInArrow(common.lean(crc), "doc_id long, shard int, start long, n_tokens long, ids_crc32 long")
    return _counted_over_all(summed, files)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.new_path(spark, "token-files")
    write(common.table(spark, sf_dir, "documents"), path)
    return digests(read(spark, path))
