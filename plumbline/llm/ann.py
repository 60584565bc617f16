"""Approximate nearest neighbours by largest inner product, with score-aware anisotropic quantisation.

An index has coarse partitions and, for what is left of a vector after its partition's centre, a product code of four
bits for every two dimensions. Codes and codebooks minimise a loss that weighs the residual's part parallel to the
vector more than the rest, since that part is what changes large inner products. A search adds up table entries by
code, keeps each block's best, and ranks these by the exact inner product of the original vectors.

The index is fitted on the driver from at most about MAX_SAMPLE vectors, chosen by a hash of their id; all vectors are
indexed. Rows of a partition are dealt to blocks of about BLOCK rows by a hash of their place, and the queries that probe
a partition to blocks of about QUERY_BLOCK, so a partition that holds most vectors is searched by many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm import common

K = 20
#: Vectors that the index is fitted on: all of them up to this number, about this many beyond it.
MAX_SAMPLE = 12_000
BLOCK = 2048
QUERY_BLOCK = 4096
#: Rows that a query ranks exactly, about, by a cut that so many of all rows would pass as of the sample: SAMPLED at least.
SHORTLIST, SAMPLED = 1000, 3
THRESHOLD = 0.2
#: Share of a sample's true neighbours that must lie in the partitions a query visits.
COVER = 0.99
SEED = 3


class Index(NamedTuple):
    centres: np.ndarray  # partitions x dimensions
    codebooks: np.ndarray  # pairs of dimensions x 16 x 2
    eta: float


def _kmeans(x: np.ndarray, k: int, rounds: int, random: np.random.Generator) -> np.ndarray:
    centres = x[random.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        at = np.argmax(x @ centres.T - 0.5 * (centres * centres).sum(1), 1)
        n = np.bincount(at, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def _paired(x: np.ndarray) -> np.ndarray:
    """Vectors as pairs of dimensions; an odd dimension gets a zero beside it."""
    if x.shape[1] % 2:
        x = np.concatenate([x, np.zeros((len(x), 1), x.dtype)], 1)
    return x.reshape(len(x), -1, 2)


def _codes(x: np.ndarray, residual: np.ndarray, index: Index, passes: int = 2) -> np.ndarray:
    """Codes by coordinate descent on the anisotropic loss: squared error + (eta - 1) * (error parallel to x) squared."""
    r = _paired(residual)
    u = _paired(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12))
    books = index.codebooks
    codes = np.stack([np.argmin(((r[:, s, None, :] - books[s][None]) ** 2).sum(2), 1) for s in range(r.shape[1])], 1)
    parallel = np.stack([((r[:, s] - books[s][codes[:, s]]) * u[:, s]).sum(1) for s in range(r.shape[1])], 1)
    total = parallel.sum(1)
    for _ in range(passes):
        for s in range(r.shape[1]):
            e = r[:, s, None, :] - books[s][None]
            along = (e * u[:, s, None, :]).sum(2)
            loss = (e * e).sum(2) + (index.eta - 1) * ((total - parallel[:, s])[:, None] + along) ** 2
            codes[:, s] = np.argmin(loss, 1)
            new = along[np.arange(len(x)), codes[:, s]]
            total += new - parallel[:, s]
            parallel[:, s] = new
    return codes.astype(np.uint8)


def fit(x: np.ndarray, partitions: int, rounds: int = 6, seed: int = SEED) -> Index:
    random = np.random.default_rng(seed)
    centres = _kmeans(x, min(partitions, len(x)), 8, random)
    at = np.argmax(x @ centres.T - 0.5 * (centres * centres).sum(1), 1)
    residual = x - centres[at]
    r, u = _paired(residual), _paired(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12))
    eta = max(1.0, (x.shape[1] - 1) * THRESHOLD**2 / (1 - THRESHOLD**2))
    books = np.stack([np.resize(_kmeans(r[:, s], min(16, len(x)), 8, random), (16, 2)) for s in range(r.shape[1])])
    index = Index(centres, books, eta)
    for _ in range(rounds):
        codes = _codes(x, residual, index, 1)
        parallel = np.stack([((r[:, s] - books[s][codes[:, s]]) * u[:, s]).sum(1) for s in range(r.shape[1])], 1)
        for s in range(r.shape[1]):  # each entry's best place, the other pairs' codes as they are
            rest = parallel.sum(1) - parallel[:, s]
            outer = np.eye(2) + (eta - 1) * u[:, s, :, None] * u[:, s, None, :]
            goal = r[:, s] + (eta - 1) * u[:, s] * (rest + (r[:, s] * u[:, s]).sum(1))[:, None]
            a, b = np.zeros((16, 2, 2)), np.zeros((16, 2))
            np.add.at(a, codes[:, s], outer)
            np.add.at(b, codes[:, s], goal)
            n = np.bincount(codes[:, s], minlength=16) > 0
            books[s][n] = np.linalg.solve(a[n] + 1e-9 * np.eye(2), b[n][..., None])[..., 0]
            parallel[:, s] = ((r[:, s] - books[s][codes[:, s]]) * u[:, s]).sum(1)
    return Index(centres.astype(np.float32), books.astype(np.float32), eta)


def visits(x: np.ndarray, index: Index, k: int = K, cover: float = COVER) -> int:
    """How many partitions a query must visit for `cover` of its `k` neighbours, measured by brute force on the sample.

    Neighbours within a sample are farther than those among all rows, so the number errs on the safe side.
    """
    q = x[:: max(1, len(x) // 400)]
    score = q @ x.T
    score[np.arange(len(q)), np.arange(0, len(x), max(1, len(x) // 400))[: len(q)]] = -np.inf
    near = np.argpartition(-score, min(k, len(x)) - 1, axis=1)[:, :k]
    at = np.argmax(x @ index.centres.T - 0.5 * (index.centres**2).sum(1), 1)
    place = np.argsort(np.argsort(-(q @ index.centres.T), axis=1), axis=1)
    return int(np.quantile(np.take_along_axis(place, at[near], 1), cover)) + 1


def _matrix(lists: pa.Array) -> np.ndarray:
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def scan(queries: np.ndarray, codes: np.ndarray, index: Index) -> np.ndarray:
    """Approximate inner products of queries with coded residuals: two four-bit codes at a time through tables of 256."""
    tables = np.einsum("qsd,skd->qsk", _paired(queries), index.codebooks)
    if tables.shape[1] % 2:
        tables = np.concatenate([tables, np.zeros_like(tables[:, :1])], 1)
        codes = np.concatenate([codes, np.zeros_like(codes[:, :1])], 1)
    both = (tables[:, 0::2, :, None] + tables[:, 1::2, None, :]).reshape(len(queries), -1, 256)
    pairs = codes[:, 0::2].astype(np.int64) * 16 + codes[:, 1::2]
    total = np.zeros((len(queries), len(codes)), np.float32)
    for j in range(both.shape[1]):
        total += both[:, j, :][:, pairs[:, j]]
    return total


def searched(query_uids: np.ndarray, queries: np.ndarray, cuts: np.ndarray, uids: np.ndarray, ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray, index: Index, k: int = K) -> tuple[np.ndarray, ...]:
    """(query's uid, vec_id, uid, score): each query's best `k` of a block, its own row apart, by exact score after a table
    scan. Ranked exactly are the rows whose approximate score is above the query's cut, the block's best `k` at least, and
    all that tie with these. A uid is a row's; an id may be that of several rows."""
    out: list[tuple[np.ndarray, ...]] = []
    order = np.lexsort((uids, ids))
    uids, ids, vectors, codes = uids[order], ids[order], vectors[order].astype(np.float64), codes[order]
    for a in range(0, len(queries), 256):
        q, q_uids = queries[a : a + 256].astype(np.float64), query_uids[a : a + 256]
        near = scan(queries[a : a + 256], codes, index)
        near[q_uids[:, None] == uids[None, :]] = -np.inf
        limit = cuts[a : a + 256] if len(ids) <= k else np.minimum(cuts[a : a + 256], np.partition(near, len(ids) - k, axis=1)[:, len(ids) - k])
        row, at = np.nonzero((near >= limit[:, None]) & (near > -np.inf) if len(ids) > k else near > -np.inf)
        score = np.empty(len(row))
        for i in range(0, len(row), 65536):
            score[i : i + 65536] = (vectors[at[i : i + 65536]] * q[row[i : i + 65536]]).sum(1)  # equal vectors get equal scores, unlike in blocked products
        best = np.lexsort((uids[at], ids[at], -score, row))
        row, at, score = row[best], at[best], score[best]
        kept = np.arange(len(row)) - np.searchsorted(row, row) < k
        out.append((q_uids[row[kept]], ids[at[kept]], uids[at[kept]], score[kept]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, embedding (doubles) of vectors that take part: not null or zero, all components finite, of any length."""
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    there = rows.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).where("vec_id IS NOT NULL AND size(embedding) > 0").where(finite)
    return there.where(F.exists("embedding", lambda v: v != 0))


def search(rows: DataFrame, is_query, k: int = K, cover: float = COVER, seed: int = SEED) -> DataFrame:
    """query_id, rank, vec_id, score: for rows where `is_query` holds, the `k` nearest other rows found.

    Vectors that are null, zero or not finite take no part, nor do rows without an id; those of each length are searched
    among themselves, with an index of their own; equal scores go to the smaller id; fewer than `k` candidates are all
    returned; an empty table gives none. Rows that share an id are rows of their own: each is ranked, and where the id is a
    query's, each has `k` neighbours, the other row among them. Columns other than vec_id and embedding are
    ignored; `is_query` may read these two. A query visits as many partitions as
    `visits` asks for at every size of table, so that clustered vectors take few and shapeless ones most, and more where
    these hold no `k` other rows.
    """
    spark = rows.sparkSession
    vectors = usable(rows)
    lengths = {r[0]: r[1] for r in vectors.groupBy(F.size("embedding")).count().collect()}  # a row a length
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = [_of_length(vectors.where(F.size("embedding") == dim), n, is_query, k, cover, seed) for dim, n in sorted(lengths.items()) if n > 1]
    return reduce(DataFrame.union, found) if found else spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")


def _of_length(vectors: DataFrame, n: int, is_query, k: int, cover: float, seed: int) -> DataFrame:
    """`search` over `n` vectors of one length."""
    spark = vectors.sparkSession
    share = int(min(1.0, MAX_SAMPLE / n) * (1 << 30))
    sample = vectors.where(F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1 << 30)) <= share).orderBy("vec_id").toArrow()  # about MAX_SAMPLE rows
    x = np.unique(_matrix(sample["embedding"]), axis=0)  # many copies of one vector must not shape the index
    partitions = max(1, min(2048, int(n**0.5 / 2), len(x)))
    index = fit(x, partitions)
    visited = visits(x, index, k, cover)
    holds = np.bincount(np.argmax(x @ index.centres.T - 0.5 * (index.centres.astype(np.float64) ** 2).sum(1), 1), minlength=len(index.centres))
    shared = spark.sparkContext.broadcast(tuple(index))  # at most 2048 centres and the codebooks, whatever the input

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Index(*shared.value)
        for batch in batches:
            v = _matrix(batch.column(1))
            at = np.argmax(v @ own.centres.T - 0.5 * (own.centres.astype(np.float64) ** 2).sum(1), 1)
            codes = _codes(v, v - own.centres[at], own)
            far = -(v @ own.centres.T)
            near = np.argpartition(far, visited - 1, axis=1)[:, :visited]
            lists = list(near.astype(np.int32))
            for i in np.flatnonzero(holds[near].sum(1) <= k):  # so few rows are there that more partitions have to be asked
                order = np.argsort(far[i], kind="stable")
                lists[i] = order[: max(visited, int(np.searchsorted(np.cumsum(holds[order]), k + 1)) + 1)].astype(np.int32)
            ends = np.cumsum([0, *map(len, lists)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(lists) if lists else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), lists], ["vec_id", "embedding", "part", "codes", "near"])

    indexed = vectors.mapInArrow(common.lean(coded), "vec_id long, embedding array<double>, part int, codes binary, near array<int>")
    made = common.stored(indexed.withColumn("uid", F.monotonically_increasing_id()), "ann-index")
    asked = made.where(is_query).select(F.col("uid").alias("query_uid"), F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), "near")
    sampled = spark.sparkContext.broadcast(x.astype(np.float32))  # about MAX_SAMPLE vectors at most
    passing = min(len(x), max(SAMPLED, -(-SHORTLIST * len(x) // n)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = _matrix(batch.column(2)).astype(np.float32)
            found = [np.partition(q[i : i + 256] @ sampled.value.T, len(x) - passing, axis=1)[:, len(x) - passing] for i in range(0, len(q), 256)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(found) if found else np.zeros(0, np.float32))], [*batch.schema.names, "cut"])

    probes = asked.mapInArrow(common.lean(cut), "query_uid long, query_id long, query array<double>, near array<int>, cut float").select("query_uid", "query_id", "query", "cut", F.explode("near").alias("part"))
    # at most as many rows as there are partitions
    sizes = made.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).join(asked.select(F.explode("near").alias("part")).groupBy("part").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("query_blocks")), "part")
    sizes = spark.createDataFrame([tuple(r) for r in sizes.select("part", "blocks", "query_blocks").collect()], "part int, blocks int, query_blocks int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    of = lambda key, n: F.pmod(F.xxhash64(key, F.lit(1)), F.col(n)).cast("int")
    left = made.join(F.broadcast(sizes), "part").select("part", of("uid", "blocks").alias("block"), each("query_blocks").alias("query_block"), "uid", "vec_id", "embedding", "codes")
    right = probes.join(F.broadcast(sizes), "part").select("part", each("blocks").alias("block"), of("query_uid", "query_blocks").alias("query_block"), "query_uid", "query_id", "query", "cut")

    def block(rows: pa.Table, queries: pa.Table) -> pa.Table:
        found: tuple = (np.zeros(0, np.int64),) * 3 + (np.zeros(0),)
        named = np.zeros(0, np.int64)
        if len(rows) and len(queries):
            codes = np.frombuffer(b"".join(rows["codes"].to_pylist()), np.uint8).reshape(len(rows), -1)
            uids, ids = queries["query_uid"].to_numpy(), queries["query_id"].to_numpy()
            own, q = Index(*shared.value), _matrix(queries["query"])
            beyond = queries["cut"].to_numpy() - q @ own.centres[rows["part"][0].as_py()]  # what a row's residual has to add
            found = searched(uids, q, beyond, rows["uid"].to_numpy(), rows["vec_id"].to_numpy(), _matrix(rows["embedding"]), codes, own, k)
            order = np.argsort(uids)
            named = ids[order[np.searchsorted(uids, found[0], sorter=order)]]
        return pa.table({"query_uid": pa.array(found[0], pa.int64()), "query_id": pa.array(named, pa.int64()), "vec_id": pa.array(found[1], pa.int64()), "uid": pa.array(found[2], pa.int64()), "score": pa.array(found[3], pa.float64())})

    keys = ["part", "block", "query_block"]
    found = left.groupBy(keys).cogroup(right.groupBy(keys)).applyInArrow(block, "query_uid long, query_id long, vec_id long, uid long, score double")
    rank = F.row_number().over(Window.partitionBy("query_uid").orderBy(F.desc("score"), "vec_id", "uid"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
