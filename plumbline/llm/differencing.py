"""Packing by Karmarkar-Karp multiway differencing: pieces of documents into windows of nearly equal sums.

Documents are cut where they are encoded: whole windows first, then pieces of at most `PIECE` ids. A whole window is a
sequence of its own. The other pieces are dealt by hash to groups of about `WINDOWS` windows' ids, whatever documents or
sources they come from, and each group is one task's work: every piece starts as a partition with one window filled, and
the two partitions of largest imbalance merge, the fullest windows of one with the emptiest of the other, until one is
left. While its fullest window exceeds the capacity, the number of windows rises and differencing starts anew. The sums
differ by a few ids, so that what is lost in a group is near the rest of its ids by the capacity: less than one window.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import chunks, common, tokens

CAPACITY = 2048
END_ID = 1
#: Ids of a piece that is no whole window, at most: some eight to a window let differencing even its sums out.
PIECE = 256
#: Windows' ids of a group, about: a task's work.
WINDOWS = 512
#: Shorter pieces are bundled up to this sum before differencing, so that a group of tiny texts is no larger problem.
BUNDLE = 32
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def differenced(sizes: np.ndarray, ways: int) -> np.ndarray:
    """The window, from 0, of each item, so that `ways` windows have nearly equal sums: largest differencing.

    A partition is its windows' sums, falling and less the least, and the tree of items in each. Ties go by order.
    """
    n = len(sizes)
    left, right = np.full(n, -1, np.int32), np.full(n, -1, np.int32)  # of inner nodes n, n + 1, ...
    whole: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def partition(k: int) -> tuple[np.ndarray, np.ndarray]:
        if k >= n:
            return whole.pop(k)
        sums, trees = np.zeros(ways, np.int64), np.full(ways, -1, np.int32)
        sums[0], trees[0] = sizes[k], k
        return sums, trees

    heap = [(-s, k) for k, s in enumerate(sizes.tolist())]
    heapq.heapify(heap)
    made, nodes = n, 0
    while len(heap) > 1:
        (sums, trees), (others, their) = partition(heapq.heappop(heap)[1]), partition(heapq.heappop(heap)[1])
        sums, their = sums + others[::-1], their[::-1]
        both = np.flatnonzero((trees >= 0) & (their >= 0))
        joined = np.maximum(trees, their)
        if len(both):
            left[nodes : nodes + len(both)], right[nodes : nodes + len(both)] = trees[both], their[both]
            joined[both] = n + nodes + np.arange(len(both))
            nodes += len(both)
        order = np.argsort(-sums, kind="stable")
        sums = sums[order]
        sums -= sums[-1]
        whole[made] = sums, joined[order]
        heapq.heappush(heap, (-int(sums[0]), made))
        made += 1
    window = np.zeros(n + nodes, np.int64)
    trees = partition(heap[0][1])[1] if heap else np.zeros(0, np.int32)
    window[trees[trees >= 0]] = np.flatnonzero(trees >= 0)
    for k in range(nodes - 1, -1, -1):  # a node is made after its parts
        window[left[k]] = window[right[k]] = window[n + k]
    return window[:n]


def windows(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """(window of each piece, number of windows): as few near-equal windows as differencing fits the pieces in."""
    order = np.argsort(-lengths, kind="stable")
    small = lengths[order] < min(BUNDLE, capacity // 8)
    first = len(order) - int(small.sum())
    in_bundle = np.cumsum(lengths[order[first:]]) // min(BUNDLE, max(1, capacity // 8))  # sums of at most twice that
    bundle = first + (np.unique(in_bundle, return_inverse=True)[1] if len(in_bundle) else in_bundle)
    item = np.concatenate([np.arange(first), bundle]).astype(np.int64)
    sizes = np.bincount(item, lengths[order]).astype(np.int64)
    ways = max(1, -(-int(lengths.sum()) // capacity))
    while True:
        window = differenced(sizes, ways)
        over = np.maximum(np.bincount(window, sizes) - capacity, 0).sum()
        if not over:
            break
        ways += max(1, int(over) // capacity)
    out = np.empty(len(lengths), np.int64)
    out[order] = window[item]
    return out, ways


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, piece: int, cache_words: int, slice_bytes: int) -> DataFrame:
    """Each document's pieces: whole windows from its start, then pieces of at most `piece` ids."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = chunks.encoder(tokenizer, cache_words).encode
        for batch in batches:
            texts = batch.column(1)
            for a, b in tokens.in_slices(texts, slice_bytes):
                ids, n = encode(texts[a:b])
                total = n + 1
                ends = np.cumsum(total)
                flat = np.full(ends[-1], end_id, "<u4")
                inner = np.ones(len(flat), bool)
                inner[ends - 1] = False
                flat[inner] = ids
                full = total // capacity
                count = full + -(-(total % capacity) // piece)
                doc = np.repeat(np.arange(b - a), count)
                nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                whole = nth < full[doc]
                start = np.where(whole, nth * capacity, full[doc] * capacity + (nth - full[doc]) * piece)
                length = np.where(whole, capacity, np.minimum(piece, total[doc] - start))
                at = 4 * ((ends - total)[doc] + start)
                view = memoryview(flat.tobytes())
                crc = np.fromiter((zlib.crc32(view[i:j]) for i, j in zip(at.tolist(), (at + 4 * length).tolist(), strict=True)), np.int64, len(at))
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b].take(pa.array(doc)), *(pa.array(x) for x in (start, length, crc, total[doc]))], PIECES.replace(" long", "").split(", "))

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(common.lean(cut), PIECES)


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, piece: int = PIECE, group_windows: int = WINDOWS, cache_words: int = tokens.CACHE_WORDS, slice_bytes: int = tokens.SLICE_BYTES) -> DataFrame:
    """Pack documents, with an end id each, into near-equal sequences of at most `capacity` ids.

    Columns read: doc_id, text; others may be there. Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset; each id of a document lies in exactly one piece. Null or empty texts are one end id. Repeated rows, null ids
    and ties are pieces of their own: a piece is dealt by its place in the stored table, so that no id's or source's
    rows meet in one group. Very long texts give as many whole windows as they hold. An empty table gives none.
    """
    made = pieces(docs, tokenizer or default_tokenizer(), capacity, end_id, min(piece, capacity), cache_words, slice_bytes)
    made = common.stored(made.withColumn("place", F.monotonically_increasing_id()), "cut-pieces")
    whole = F.col("length") == capacity
    rest = made.where(~whole).agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    groups = max(1, -(-rest // (capacity * group_windows)))
    columns = "doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset"

    def balanced(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        length = table["length"].to_numpy()
        window, _ = windows(length, capacity)
        order = np.argsort(window, kind="stable")
        before = np.cumsum(length[order]) - length[order]
        first = np.append(True, np.diff(window[order]) > 0)
        offset = np.empty(len(length), np.int64)
        offset[order] = before - np.repeat(before[first], np.diff(np.append(np.flatnonzero(first), len(order))))
        ids = (table["group"].to_numpy() << 24) + window
        return pa.table([*(table[c] for c in columns.split(", ")[:5]), pa.array(ids), pa.array(offset)], names=columns.split(", "))

    dealt = made.where(~whole).withColumn("group", F.pmod(F.xxhash64("place"), F.lit(groups)).cast("long"))
    shared = dealt.groupBy("group").applyInArrow(balanced, f"{PIECES}, sequence_id long, offset long")
    alone = made.where(whole).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (-1 - F.col("place")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return shared.unionByName(alone)


def op13_pack_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"))
