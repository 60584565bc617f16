"""Quality classifier: naive Bayes support vectors.

Features are indicators of n-grams: words, pairs of words, and pairs of word shapes, hashed into 2^BITS places. Each is
scaled by its class log-count ratio, and a linear hinge-loss model over the scaled indicators is fitted by dual
coordinate descent. The margin becomes a score through a logistic curve fitted on the training rows.

The model is fitted on the driver from at most about MAX_TRAIN labelled rows with at most about MAX_FEATURES features in
all, chosen by a hash; every document is then scored, whole, where it is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from plumbline.llm import common
from plumbline.llm.tokens import in_slices
from plumbline.llm.words import Words, mixed, words_of

BITS = 20
#: Labelled rows that the model is fitted on: all of them up to this number, about this many beyond it.
MAX_TRAIN = 4000
#: Features of these rows in all: where the texts are so long that they have more, fewer rows are taken.
MAX_FEATURES = 40_000_000
SMOOTH = 1.0
COST = 0.1
EPOCHS = 12
SEED = 11


def shapes(distinct: pa.Array) -> pa.Array:
    """Words with each run of capitals, small letters or digits made one character, and repeats of other marks made two."""
    out = pc.replace_substring_regex(distinct, r"\p{Lu}+", "A")
    out = pc.replace_substring_regex(out, r"[\p{Ll}\p{Lo}]+", "a")
    out = pc.replace_substring_regex(out, r"\p{N}+", "0")
    return pc.replace_substring_regex(out, r"[^\p{L}\p{N}]{2,}", "##")


def features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(place of each feature, offsets by text): each text's different features, ascending."""
    by_shape = shapes(words.distinct).dictionary_encode()
    shape = Words(by_shape.indices.to_numpy(), words.offsets, by_shape.dictionary).hashes()[by_shape.indices.to_numpy().astype(np.int64)][words.codes]
    word = words.hashes()[words.codes]
    of_text = words.of_text
    inner = of_text[1:] == of_text[:-1]
    pair = lambda x, salt: mixed(x[:-1] * np.uint64(3) + mixed(x[1:] + np.uint64(salt)))[inner]
    again = (words.codes[1:] == words.codes[:-1])[inner].astype(np.uint64)
    of_pair = of_text[1:][inner]
    found = [(of_text, mixed(word)), (of_pair, pair(word, 1)), (of_pair, mixed(pair(shape, 2) + again)), (of_text, mixed(shape + np.uint64(5)))]
    keys = np.concatenate([(t.astype(np.uint64) << np.uint64(BITS)) | (h >> np.uint64(64 - BITS)) for t, h in found])
    keys = np.sort(keys)
    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys
    counts = np.bincount((keys >> np.uint64(BITS)).astype(np.int64), minlength=len(words.offsets) - 1)
    return (keys & np.uint64((1 << BITS) - 1)).astype(np.int32), np.concatenate([[0], np.cumsum(counts)])


class Model(NamedTuple):
    weights: np.ndarray  # of each place, the log-count ratio included
    bias: float
    slope: float
    shift: float

    def scores(self, found: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(self.weights[found], dtype=np.float64)])
        n = np.diff(offsets)
        margin = (sums[offsets[1:]] - sums[offsets[:-1]]) / np.sqrt(np.maximum(n, 1)) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30)))


def fit(rows: list[np.ndarray], labels: np.ndarray, cost: float = COST, epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """Fit from each training row's features and its label, 0 or 1. Rows are scaled to unit length before the ratios.

    Without rows of both classes, the score is the one class's everywhere, or 0.5 without any.
    """
    y = np.where(labels == 1, 1.0, -1.0)
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(1 << BITS, np.float32), 0.0, 1.0, 5.0 * float(y[0]) if len(y) else 0.0)
    counts = {s: np.full(1 << BITS, SMOOTH) for s in (1.0, -1.0)}
    for r, v in zip(rows, y, strict=True):
        counts[v][r] += 1  # a row's features differ from each other
    ratio = np.log(counts[1.0] / counts[1.0].sum()) - np.log(counts[-1.0] / counts[-1.0].sum())
    values = [(ratio[r] / np.sqrt(max(len(r), 1))).astype(np.float32) for r in rows]
    squares = np.array([float(v @ v) + 1.0 for v in values])
    weight, bias, alpha = np.zeros(1 << BITS), 0.0, np.zeros(len(rows))
    by_class = np.where(y > 0, cost * len(y) / (2 * (y > 0).sum()), cost * len(y) / (2 * (y < 0).sum()))
    random = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in random.permutation(len(rows)):
            gradient = y[i] * (weight[rows[i]] @ values[i] + bias) - 1
            new = min(max(alpha[i] - gradient / squares[i], 0.0), by_class[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                weight[rows[i]] += step * values[i]
                bias += step
                alpha[i] = new
    margin = np.array([weight[r] @ v + bias for r, v in zip(rows, values, strict=True)])
    slope, shift = 1.0, 0.0
    target = np.where(y > 0, ((y > 0).sum() + 1) / ((y > 0).sum() + 2), 1 / ((y < 0).sum() + 2))
    for _ in range(30):  # a logistic curve over the margins, by Newton's method with a little ridge
        p = 1 / (1 + np.exp(-np.clip(slope * margin + shift, -30, 30)))
        d, q = p - target, p * (1 - p) + 1e-9
        h = np.array([[q @ (margin * margin) + 1e-3, q @ margin], [q @ margin, q.sum() + 1e-3]])
        change = np.linalg.solve(h, [d @ margin + 1e-3 * (slope - 1), d.sum()])
        slope, shift = slope - change[0], shift - change[1]
    return Model((weight * ratio).astype(np.float32), float(bias), float(max(slope, 1e-3)), float(shift))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, max_features: int = MAX_FEATURES) -> Model:
    """Fit on labelled documents that are not held out; null labels, ids and texts are passed over.

    Labels and documents that are there several times count once each; an id with both labels counts for both. Empty texts
    are rows without features. Without labelled documents, all scores are 0.5. Other columns are ignored.
    """
    labelled = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int")).where("doc_id IS NOT NULL AND quality IN (0, 1)").where(~held_out(F.col("doc_id"))).distinct()
    n = labelled.count()
    below = lambda share, *by: F.pmod(F.xxhash64(*by, F.lit(SEED)), F.lit(1 << 30)) < int(share * (1 << 30))
    some = labelled.where(below(min(1.0, max_train / max(n, 1)), "doc_id"))  # about max_train rows at most

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in in_slices(batch.column(0), 1_000_000):
                found, offsets = features(words_of(batch.column(0)[a:b]))
                yield pa.RecordBatch.from_arrays([*(c[a:b] for c in batch.columns[1:]), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(found))], ["doc_id", "quality", "key", "found"])

    texts = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("long"), "text").join(F.broadcast(some), "doc_id").select("text", "doc_id", "quality", F.xxhash64("text").alias("key"))
    made = common.stored(texts.mapInArrow(common.lean(rows), "doc_id long, quality int, key long, found array<int>"), "quality-features")
    total = made.agg(F.coalesce(F.sum(F.size("found")), F.lit(0))).first()[0]
    if total > max_features:
        made = made.where(below(max_features / total, "doc_id", "key"))
    table = made.dropDuplicates(["doc_id", "quality", "key"]).toArrow().sort_by([(c, "ascending") for c in ("doc_id", "quality", "key")]).combine_chunks()
    if not len(table):
        return fit([], np.zeros(0))
    lists = table["found"].chunk(0)
    values, at = lists.values.to_numpy(), lists.offsets.to_numpy()
    model = fit([values[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], table["quality"].to_numpy())
    del table, made, lists, values
    common.release()
    return model


def scored(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """`docs` (all columns) with the score as column `name`, which must be new; by each whole text alone.

    Null and empty texts score the model's bias; repeated rows score each by itself; an empty table gives none.
    """
    spark, names = docs.sparkSession, docs.columns
    if common.unused(names, name) != name:
        raise ValueError(f"there is a column {name} already")
    shared = spark.sparkContext.broadcast(tuple(model))  # 2^BITS floats, whatever the input
    at = names.index("text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            for a, b in in_slices(batch.column(at), 1_000_000):
                part = batch.slice(a, b - a)
                score = own.scores(*features(words_of(part.column(at))))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score)], [*plain, "score"])

    plain = [f"c{i}" for i in range(len(names))]  # within, names may have dots
    fields = [StructField(c, f.dataType, f.nullable) for c, f in zip(plain, docs.schema.fields, strict=True)]
    made = docs.toDF(*plain).mapInArrow(common.lean(rows), StructType([*fields, StructField("score", DoubleType())]))
    return made.toDF(*names, name)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = train(docs, common.table(spark, sf_dir, "labels"))
    out = scored(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
