"""Best-fit packing of documents into sequences of a fixed number of tokens.

The plan is made over the histogram of piece lengths, at most `capacity` counts, whatever the number of documents:
best-fit decreasing moves whole runs of equal bins at once. Pieces then take planned slots by joining their rank within
their length with the plan's ranges of ranks. Ranks come from counts by (length, bucket) and places within a bucket;
a length has as many buckets as the square root of its count, so a length that holds a third of all pieces is ranked
by many tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm import common, tokens

CAPACITY = 2048
END_ID = 0
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_RANK_BITS = 46


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: (length, from rank, first sequence, offset, pieces a sequence), by length and rank.

    Pieces of `length` with ranks from `from rank` up to the next row's go to sequences `first sequence` onwards, `pieces
    a sequence` to each, side by side from `offset`. Bins with the same content are one group, which a step splits into
    three at most; the plan has at most about 6 * capacity groups and as many rows as these hold different lengths.
    """
    # a group: [space left, bins, [(length, pieces a bin, from rank), ...]]
    room: dict[int, list[list]] = {}
    closed: list[list] = []

    def put(left: int, group: list) -> None:
        group[0] = left
        (room.setdefault(left, []) if left else closed).append(group)

    def later(content: list, bins: int) -> list:
        """The content of a group's bins after its first `bins`."""
        return [(length, each, rank + bins * each) for length, each, rank in content]

    def fill(group: list, length: int, need: int, rank: int) -> int:
        """Fill a group's bins with up to `need` pieces, tightest first; returns how many it took."""
        left, bins, content = group
        each = left // length
        full = min(bins, need // each)
        took = full * each
        if full:
            put(left - each * length, [0, full, [*content, (length, each, rank)]])
        rest = min(need - took, each - 1) if full < bins else 0
        if rest:
            put(left - rest * length, [0, 1, [*later(content, full), (length, rest, rank + took)]])
        if bins - full - bool(rest):
            put(left, [0, bins - full - bool(rest), later(content, full + bool(rest))])
        return took + rest

    for length in sorted((k for k in counts if counts[k]), reverse=True):
        need, rank = counts[length], 0
        for left in sorted(x for x in room if x >= length):
            for group in room.pop(left):
                if not need:
                    put(left, group)
                    continue
                took = fill(group, length, need, rank)
                need, rank = need - took, rank + took
        if need:
            fill([capacity, -(-need // (capacity // length)), []], length, need, rank)
    rows, first = [], 0
    for _, bins, content in closed + [g for left in sorted(room) for g in room[left]]:
        offset = 0
        for length, each, rank in content:
            rows.append((length, rank, first, offset, each))
            offset += length * each
        first += bins
    return sorted(rows)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, cache_words: int = tokens.CACHE_WORDS, slice_bytes: int = tokens.SLICE_BYTES) -> DataFrame:
    """Each document's pieces: only documents of over `capacity` ids are cut. A null text is an empty one: one end id."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(tokenizer, cache_words).encode
        for batch in batches:
            texts = batch.column(1)
            for a, b in tokens.in_slices(texts, slice_bytes):
                ids, n = encode(texts[a:b])
                rows: list[tuple] = []
                at = 0
                for doc, k in zip(batch.column(0)[a:b].to_pylist(), n.tolist(), strict=True):
                    own = np.append(ids[at : at + k], np.uint32(end_id)).astype("<u4")
                    at += k
                    rows += [(doc, i, s, len(p := own[s : s + capacity]), zlib.crc32(p)) for i, s in enumerate(range(0, k + 1, capacity))]
                doc, i, s, m, crc = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(i, pa.int32()), pa.array(s, pa.int64()), pa.array(m, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(common.lean(cut), PIECES)


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, cache_words: int = tokens.CACHE_WORDS, slice_bytes: int = tokens.SLICE_BYTES) -> DataFrame:
    """Pack whole documents, with an end id each, into as few sequences of at most `capacity` ids as best-fit finds.

    Columns read: doc_id, text; others may be there. Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    Null or empty texts are one end id. Repeated rows, null ids and ties are pieces of their own: pieces of a length are
    interchangeable, and their places in the stored table rank them, so that no id's rows meet in one bucket. Very long
    texts are cut into as many pieces as they take. An empty table gives none.
    `cache_words` and `slice_bytes` trade a worker's memory for its time.
    """
    spark = docs.sparkSession
    made = pieces(docs, tokenizer or default_tokenizer(), capacity, end_id, cache_words, slice_bytes)
    made = common.stored(made.withColumn("place", F.monotonically_increasing_id()), "pieces")
    counts = {r[0]: r[1] for r in made.groupBy("length").count().collect()}  # at most `capacity` rows
    rows = np.array(plan(counts, capacity), np.int64).reshape(-1, 5)
    keys = (rows[:, 0] << _RANK_BITS) + rows[:, 1]

    lookup = spark.createDataFrame([(int(k), max(1, int(n**0.5))) for k, n in counts.items()], "length long, buckets long")  # at most `capacity` rows
    dealt = made.join(F.broadcast(lookup), "length").withColumn("bucket", F.pmod(F.xxhash64("place"), "buckets")).drop("buckets")
    before = dealt.groupBy("length", "bucket").count().withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    place = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("place")) - 1
    ranked = dealt.withColumn("place", place).join(before.select("length", "bucket", F.coalesce("before", F.lit(0)).alias("before")), ["length", "bucket"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("place")).alias("rank"))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in (3, 5))
            at = np.searchsorted(keys, (length << _RANK_BITS) + rank, "right") - 1
            _, since, first, offset, each = rows[at].T
            j = rank - since
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(first + j // each), pa.array(offset + j % each * length)], [*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(common.lean(take), f"{PIECES}, sequence_id long, offset long")


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"))
