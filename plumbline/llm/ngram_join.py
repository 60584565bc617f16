"""Jaccard join over word n-grams with Bayesian pruning of candidates.

1. Sketch. A text's shingles (windows of SHINGLE words) give HASHES MinHash values of 16 bits. Equal texts are one node.
2. Candidates. Nodes that agree in a band of ROWS values share a bucket. A bucket's rows are compared to its first node,
   its pivot; rows far enough from the pivot are compared among themselves, in blocks. Agreements high enough that a
   link could hide behind them join nodes to groups; see `_candidates` for why no link between members is lost.
3. Pruning. Within a group, blocks of nodes meet pairwise, with nothing but their MinHash values. These are compared step by
   step; a pair goes once the posterior probability that its similarity reaches the threshold falls below TOLERANCE. A
   block pair yields the nodes that are left with a partner.
4. Verification. Texts of such nodes alone become sets of 64-bit shingle hashes, each once, and decide the remaining pairs.
   A block pair yields each node's number of links and a spanning forest of them, never the pairs.

Groups are connected components of edge tables, found by rounds of joins over tables in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm import common
from plumbline.llm.tokens import hashes as string_hashes
from plumbline.llm.tokens import in_slices
from plumbline.llm.words import mixed, windows, words_of

SHINGLE = 5
THRESHOLD = 0.8
ROWS, BANDS = 5, 32
HASHES = ROWS * BANDS
TOLERANCE = 1e-6
STEP = 32
#: Agreement with a bucket's pivot from which a row needs no comparison with the bucket's other rows.
SETTLED = 0.75
BLOCK = 128
#: Parts in which a group's rows look up its size, so that a group with many rows is not dealt to one task.
SALTS = 16
SEED = 17


def shingle_hashes(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all texts' shingles, offsets by text). A text of fewer than `size` words is one shingle of them all."""
    words = words_of(texts)
    hashes = string_hashes(words.distinct)[0][words.codes]  # 64 bits of a whole word
    found, first = windows(hashes, words.offsets, size)
    n = np.diff(words.offsets)
    counts = np.maximum(n - size + 1, 0)
    short = np.flatnonzero((n > 0) & (n < size))
    offsets = np.concatenate([[0], np.cumsum(counts + ((n > 0) & (n < size)))])
    out = np.zeros(offsets[-1], np.uint64)
    of_window = words.of_text[first]
    out[offsets[of_window] + first - words.offsets[of_window]] = found
    for i in short:
        h = np.full(1, n[i], np.uint64)
        for x in hashes[words.offsets[i] : words.offsets[i + 1]]:
            h = mixed(h * np.uint64(3) + x)
        out[offsets[i]] = h[0]
    return out, offsets


def _multipliers(seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(seed)
    return random.integers(0, 1 << 31, HASHES, np.uint32) * np.uint32(2) + np.uint32(1), random.integers(0, 1 << 32, HASHES, np.uint32)


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray, chunk: int = 4096) -> np.ndarray:
    """16 bits, folded from the 32 of the least value of each hash over the shingles."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), chunk):
        np.minimum(least, (x[None, i : i + chunk] * a[:, None] + b[:, None]).min(1), out=least)
    return (least ^ (least >> np.uint32(16))).astype(np.uint16)


def _sketch(docs: DataFrame) -> DataFrame:
    """uid, doc_id, key (md5 of the text) and sig of every row; key and sig are null for texts without words."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _multipliers()
        for batch in batches:
            for i, j in in_slices(batch.column(2), 1_000_000):
                found, offsets = shingle_hashes(batch.column(2)[i:j])
                sig = [signature(found[s:e], a, b).tobytes() if e > s else None for s, e in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], batch.column(1)[i:j], pa.array(sig, pa.binary())], ["doc_id", "key", "sig"])

    made = docs.select(F.col("doc_id").cast("long"), F.unhex(F.md5("text")).alias("key"), "text").mapInArrow(common.lean(rows), "doc_id long, key binary, sig binary")
    return made.select(F.monotonically_increasing_id().alias("uid"), "doc_id", F.when(F.col("sig").isNotNull(), F.col("key")).alias("key"), "sig")


def by_group(rows: DataFrame, keys: list[str], apply: Callable[[pa.Table], pa.RecordBatch | None], schema: str) -> DataFrame:
    """`apply` to each group of `keys`, each small enough for one task; a partition's groups stream through one worker."""
    n_keys = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(i).to_numpy() for i in range(n_keys)]
            change = np.zeros(batch.num_rows, bool)
            for c in columns:
                change[1:] |= c[1:] != c[:-1]
            first = tuple(c[0] for c in columns)
            change[0] = first != last
            last = tuple(c[-1] for c in columns)
            bounds = [0, *[i for i in np.flatnonzero(change).tolist() if i], batch.num_rows]
            for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                if (k or change[0]) and held:
                    if (out := apply(pa.Table.from_batches(held))) is not None:
                        yield out
                    held = []
                held.append(batch.slice(a, b - a))
        if held and (out := apply(pa.Table.from_batches(held))) is not None:
            yield out

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(common.lean(run), schema)


def least_matches(hashes: int = HASHES, step: int = STEP, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """(values compared, least number of matches): with fewer, the posterior probability of reaching `threshold`, from a
    uniform prior over similarities, is below `tolerance`."""
    out = []
    for n in [*range(step, hashes, step), hashes]:
        tail, m = 0.0, 0
        while m <= n:  # P(similarity >= t | m of n match) = sum of i <= m of C(n + 1, i) t^i (1 - t)^(n + 1 - i)
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= tolerance:
                break
            m += 1
        out.append((n, m))
    return out


#: Agreement from which two nodes share a group. A node below it differs from one that is SETTLED in more values than
#: pruning lets a pair differ in, so no pair is lost here that would not be pruned.
GROUPED = (SETTLED * HASHES - HASHES + least_matches()[-1][1]) / HASHES


def pruned(x: np.ndarray, y: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (row of x, row of y) whose similarity may still reach the threshold after all values."""
    matches = np.zeros(len(left), np.int32)
    start = 0
    for n, least in least_matches():
        for a in range(0, len(left), 65536):
            matches[a : a + 65536] += (x[left[a : a + 65536], start:n] == y[right[a : a + 65536], start:n]).sum(1, dtype=np.int32)
        keep = matches >= least
        left, right, matches, start = left[keep], right[keep], matches[keep], n
    return left, right


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Each of n items' least connected item, by the pairs (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _signatures(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, HASHES)


def _pairs(blocks: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows that a unit (block i, block j) has to compare: at most BLOCK-sized blocks on either side."""
    if i == j:
        return np.triu_indices(len(blocks), 1)
    left, right = np.flatnonzero(blocks == i), np.flatnonzero(blocks == j)
    return np.repeat(left, len(right)), np.tile(right, len(left))


def _sized(rows: DataFrame, group: str, sizes: DataFrame, id_: str) -> DataFrame:
    """Rows of the groups in `sizes` with `blocks`, the number of blocks of their group; slim rows, before texts join them."""
    salt = F.pmod(F.xxhash64(id_, F.lit(SEED + 1)), F.lit(SALTS)).cast("int")
    blocks = sizes.select(group, F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    return rows.withColumn("_salt", salt).join(_grows(blocks), [group, "_salt"]).drop("_salt")


def _dealt(rows: DataFrame, id_: str) -> DataFrame:
    """Rows with `block`, and once for each unit (i, j) of two blocks of their group; a small group is the unit (0, 0)."""
    there = rows.withColumn("block", F.pmod(F.xxhash64(id_, F.lit(SEED)), F.col("blocks")).cast("int"))
    there = there.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return there.withColumns({"i": F.least("block", "_other"), "j": F.greatest("block", "_other")}).drop("blocks", "_other")


def components(edges: DataFrame, name: str) -> DataFrame:
    """node, label: each node's least connected node, for the nodes of the edges (a, b).

    Labels pass along edges and then to the label's own label, so that paths halve; each round is a table in the shared
    folder, and only the number of changes comes to the driver.
    """
    spark = edges.sparkSession
    # each node's edges downwards meet in its least neighbour: the same components over little more than an edge a node
    down = common.stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-down")
    # stored, so that the join has a plain exchange on either side, whose large partitions Spark can split
    least = common.stored(down.groupBy("a").agg(F.min("b").alias("least")), f"{name}-least")
    moved = down.join(_grows(least), "a").select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b")
    fewer = moved.union(least.select("a", F.col("least").alias("b"))).distinct()
    alone = edges.where("a = b").select("a", "b").distinct()
    both = common.stored(fewer.union(fewer.select("b", "a")).union(alone).distinct(), f"{name}-edges")
    labels, path = common.stored_at(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), f"{name}-labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(seen, "node").select("node", F.least("label", "near").alias("low"), F.col("label").alias("old"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("far"))
        new, new_path = common.stored_at(lower.join(jump, "low").select("node", F.least("low", "far").alias("label"), "old"), f"{name}-labels")
        changed = new.where("label <> old").limit(1).count()
        common.removed(spark, path)
        labels, path = new.select("node", "label"), new_path
        if not changed:
            return labels


def _grows(side: DataFrame) -> DataFrame:
    """A side of a join that grows with the corpus: never broadcast, whatever its estimated size."""
    return side.hint("merge")


def _agreement(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """(node, pivot, share): the share of MinHash values that two nodes have in common."""

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (_signatures(batch.column(i)) for i in (2, 3))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((x == y).mean(1))], ["node", "pivot", "share"])

    both = pairs.join(sigs.select("node", F.col("sig").alias("own")), "node").join(sigs.select(F.col("node").alias("pivot"), F.col("sig").alias("other")), "pivot")
    return both.select("node", "pivot", "own", "other").mapInArrow(common.lean(share), "node long, pivot long, share double")


def _candidates(nodes: DataFrame) -> DataFrame:
    """Edges (a, b) whose components hold every link between nodes that share a bucket.

    A link is a distance (1 - similarity) of 0.2 at most, and distances obey the triangle inequality. Of a link's two
    nodes in a bucket, either one agrees with the pivot by SETTLED or more; then the other agrees with it by GROUPED or
    more, and both have an edge to the pivot, or the two differ in so many values that the pair would be pruned. Or
    neither does; then they are compared with each other among the rows that are not settled.
    """

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = mixed(np.arange(1, BANDS + 1))
        for batch in batches:
            if batch.num_rows:
                values = _signatures(batch.column(1)).reshape(-1, BANDS, ROWS).astype(np.uint64)
                key = np.broadcast_to(salt, values.shape[:2]).copy()
                for r in range(ROWS):
                    key = mixed(key * np.uint64(3) + values[:, :, r])
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), BANDS))], ["bucket", "node"])

    rows = nodes.select("node", "sig").mapInArrow(common.lean(bands), "bucket long, node long")
    buckets = rows.groupBy("bucket").agg(F.min("node").alias("pivot"), F.max("node").alias("last")).where("pivot < last").select("bucket", "pivot")
    members = common.stored(rows.join(_grows(buckets), "bucket").where("node <> pivot"), "join-members")
    pairs = common.stored(members.select("node", "pivot").distinct(), "join-pairs")
    involved = pairs.select("node").union(pairs.select("pivot")).distinct()
    sigs = common.stored(nodes.select("node", "sig").join(_grows(involved), "node"), "join-signatures")
    shares = common.stored(_agreement(pairs, sigs), "join-shares")
    open_ = members.join(shares.where(F.col("share") < SETTLED), ["node", "pivot"]).select("bucket", "node")
    sizes = open_.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    open_ = _dealt(_sized(open_, "bucket", sizes, "node"), "node").join(sigs, "node").select("bucket", "i", "j", "block", "node", "sig")

    def compare(table: pa.Table) -> pa.RecordBatch | None:
        ids, blocks = table["node"].to_numpy(), table["block"].to_numpy()
        sig = _signatures(table["sig"])
        a, b = pruned(sig, sig, *_pairs(blocks, table["i"][0].as_py(), table["j"][0].as_py()))
        root = forest(a, b, len(ids))
        own = np.flatnonzero(root != np.arange(len(ids)))
        return pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(ids[root[own]])], ["a", "b"]) if len(own) else None

    rest = by_group(open_, ["bucket", "i", "j"], compare, "a long, b long")
    # a node and its pivots, one a band at most, are joined through the least of them: fewer edges, the same components
    star = shares.where(F.col("share") >= GROUPED).groupBy("node").agg(F.collect_set("pivot").alias("pivots"))
    star = star.select(F.array_append("pivots", F.col("node")).alias("all")).select(F.explode("all").alias("a"), F.array_min("all").alias("b"))
    return star.where("a <> b").distinct().union(rest)


def shared_shingles(x: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact sizes of the intersections of some pairs of sorted arrays without repeats."""
    if not len(left):
        return np.zeros(0, np.int64)
    used = np.unique(np.concatenate([left, right]))
    every, at = np.unique(np.concatenate([x[i] for i in used]), return_inverse=True)
    n = np.bincount(at)
    column = np.where(n > 1, np.cumsum(n > 1) - 1, -1)[at]  # a hash that one array alone has is in no intersection
    row = np.repeat(np.arange(len(used)), [len(x[i]) for i in used])
    row, column = row[column >= 0], column[column >= 0]
    place = {int(i): k for k, i in enumerate(used)}
    l, r = (np.fromiter((place[int(i)] for i in side), np.int64, len(side)) for side in (left, right))
    total = np.zeros(len(left), np.int64)
    width = int(column.max()) + 1 if len(column) else 0
    if len(used) ** 2 * width < 200_000 * len(left):  # many pairs over few columns: products of 0/1 matrices
        product = np.zeros((len(used), len(used)), np.float32)
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        for a in range(0, width, 4096):
            lo, hi = np.searchsorted(column, [a, a + 4096])
            m = np.zeros((len(used), min(4096, width - a)), np.float32)
            m[row[lo:hi], column[lo:hi] - a] = 1
            product += m @ m.T
        return product[l, r].astype(np.int64)
    for k, (i, j) in enumerate(zip(left, right, strict=True)):
        total[k] = len(np.intersect1d(x[i], x[j], assume_unique=True))
    return total


def _unpruned(grouped: DataFrame) -> DataFrame:
    """grp, i, j, block, node: of each unit of two blocks of a group, the nodes with a partner that pruning leaves."""

    def prune(table: pa.Table) -> pa.RecordBatch | None:
        grp, i, j = (table[c][0].as_py() for c in ("grp", "i", "j"))
        sig, blocks = _signatures(table["sig"]), table["block"].to_numpy()
        some = np.unique(np.concatenate(pruned(sig, sig, *_pairs(blocks, i, j))))
        if not len(some):
            return None
        same = lambda v, kind: pa.array(np.full(len(some), v), kind)
        return pa.RecordBatch.from_arrays([same(grp, pa.int64()), same(i, pa.int32()), same(j, pa.int32()), pa.array(blocks[some], pa.int32()), table["node"].combine_chunks().take(pa.array(some))], ["grp", "i", "j", "block", "node"])

    sizes = grouped.groupBy("grp").agg(F.count(F.lit(1)).alias("size"))
    units = _dealt(_sized(grouped.select("grp", "node", "sig"), "grp", sizes, "node"), "node").select("grp", "i", "j", "block", "node", "sig")
    return by_group(units, ["grp", "i", "j"], prune, "grp long, i int, j int, block int, node long")


def _verified(docs: DataFrame, grouped: DataFrame, threshold: float) -> DataFrame:
    """(node, links, root): per unit of two blocks, each linked node's number of links and its least linked node."""
    limit = Fraction(threshold).limit_denominator(1000)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in in_slices(batch.column(1), 1_000_000):
                found, offsets = shingle_hashes(batch.column(1)[i:j])
                own = [np.unique(found[s:e]).tobytes() for s, e in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(own, pa.binary())], ["node", "shingles"])

    def verify(table: pa.Table) -> pa.RecordBatch | None:
        ids = table["node"].to_numpy()
        sig, blocks = _signatures(table["sig"]), table["block"].to_numpy()
        own = [np.frombuffer(x, np.uint64) for x in table["shingles"].to_pylist()]
        size = np.array([len(x) for x in own], np.int64)
        a, b = _pairs(blocks, table["i"][0].as_py(), table["j"][0].as_py())
        near = np.minimum(size[a], size[b]) * limit.denominator >= np.maximum(size[a], size[b]) * limit.numerator
        a, b = pruned(sig, sig, a[near], b[near])
        both = shared_shingles(own, a, b)
        linked = both * (limit.numerator + limit.denominator) >= limit.numerator * (size[a] + size[b])
        a, b = a[linked], b[linked]
        if not len(a):
            return None
        links = np.bincount(np.concatenate([a, b]), minlength=len(ids))
        root, some = forest(a, b, len(ids)), np.flatnonzero(links)
        return pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(links[some]), pa.array(ids[root[some]])], ["node", "links", "root"])

    units = common.stored(_unpruned(grouped), "join-units")
    wanted = grouped.join(_grows(units.select("node").distinct()), "node").alias("g")
    keyed = docs.select(F.col("doc_id").cast("long"), F.unhex(F.md5("text")).alias("key"), "text").alias("d")
    texts = keyed.join(_grows(wanted), F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("d.key") == F.col("g.key"))).select("g.node", "d.text")
    made = texts.mapInArrow(common.lean(sets), "node long, shingles binary").groupBy("node").agg(F.first("shingles").alias("shingles"))  # a row given twice is one node
    full = units.join(_grows(made), "node").join(_grows(grouped.select("node", "sig")), "node")
    return by_group(full.select("grp", "i", "j", "block", "node", "shingles", "sig"), ["grp", "i", "j"], verify, "node long, links long, root long")


def join(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of `docs`: doc_id, key (md5 of the text), class_id, n_links and is_first.

    A link joins two different texts whose sets of shingles have a Jaccard similarity of `threshold`, 0.8 or more. A class
    is a component of links and equal texts; its id is its least doc_id. `n_links` counts the different texts linked
    to a document's own; `is_first` marks one row of each class. Texts that are null or without words take no part:
    each is a class of its own. Null ids share the class of their text (its id is null if all ids in it are). Columns
    other than doc_id and text are ignored; an empty table gives none.
    """
    sketch = common.stored(_sketch(docs), "join-sketch")
    nodes = common.stored(sketch.where("key IS NOT NULL").groupBy("key").agg(F.min("uid").alias("node"), F.min("doc_id").alias("least_id")), "join-nodes")
    own = sketch.select(F.col("uid").alias("node"), "doc_id", "key", "sig").join(_grows(nodes.select("node")), "node")
    groups = components(_candidates(own.select("node", "sig")), "join-groups")
    grouped = common.stored(groups.select("node", F.col("label").alias("grp")).join(_grows(sketch.select(F.col("uid").alias("node"), "doc_id", "key", "sig")), "node"), "join-grouped")
    found = common.stored(_verified(docs, grouped, threshold), "join-links")
    classes = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), "join-classes")
    counted = found.groupBy("node").agg(F.sum("links").alias("links")).join(classes, "node")
    named = counted.join(nodes, "node").select("node", "links", "label", "least_id")
    first = named.groupBy("label").agg(F.min("least_id").alias("class_least"))
    by_node = nodes.join(_grows(named.select("node", "links", "label")), "node", "left").join(first, "label", "left")
    by_node = by_node.select("key", "node", F.coalesce("class_least", "least_id").alias("class_id"), F.coalesce("links", F.lit(0)).alias("n_links"), F.coalesce("label", "node").alias("first_uid"))
    rows = sketch.where("key IS NOT NULL").select("uid", "doc_id", "key").join(_grows(by_node), "key")
    named = rows.select("doc_id", "key", "class_id", F.col("n_links").cast("long").alias("n_links"), (F.col("uid") == F.col("first_uid")).alias("is_first"))
    alone = sketch.where("key IS NULL").select("doc_id", "key", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("is_first"))
    return named.unionByName(alone)


def deduplicated(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """`docs` with one row of each class of near duplicates; texts without words all stay.

    All columns are kept, whatever their names and types. Of rows that are equal in doc_id and text, the one whose other
    columns come first as JSON stays. An empty table gives none.
    """
    first = common.stored(join(docs, threshold).where("is_first AND key IS NOT NULL").select("doc_id", "key"), "join-first")
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    order = F.to_json(F.struct(*others)) if others else F.lit("")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.unhex(F.md5("text")).alias("hash"), (common.n_words(F.col("text")) > 0).alias("words"), order.alias("order"))
    kept = rows.where("words").join(_grows(first), F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("key"))).select("row", "id", "hash", "order")
    once = F.row_number().over(Window.partitionBy("id", "hash").orderBy("order"))
    return kept.withColumn("nth", once).where("nth = 1").select("row.*").unionByName(rows.where("NOT words").select("row.*"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(common.table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


_WORD = r"'[^\x20\x09-\x0D]+'"
#: All pairs of texts that share a shingle: for tables of a few thousand documents.
OP6_SQL = rf"""
WITH RECURSIVE t AS (SELECT row_number() OVER () AS node, text, min(doc_id) AS least FROM documents WHERE regexp_matches(text, {_WORD}) GROUP BY text),
w AS (SELECT node, regexp_extract_all(text, {_WORD}) AS words FROM t),
s AS (SELECT DISTINCT node, array_to_string(words[i:i + {SHINGLE - 1}], ' ') AS shingle FROM w, unnest(range(1, greatest(len(words) - {SHINGLE - 1}, 1) + 1)) AS r(i)),
n AS (SELECT node, count(*) AS size FROM s GROUP BY node),
p AS (SELECT a.node AS a, b.node AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.node < b.node GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.node = a JOIN n y ON y.node = b WHERE 5 * shared >= 4 * (x.size + y.size - shared)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT node, node AS other FROM t UNION SELECT r.node, e.b FROM reach r JOIN e ON e.a = r.other),
c AS (SELECT r.node, min(t.least) AS class_id FROM reach r JOIN t ON t.node = r.other GROUP BY r.node),
k AS (SELECT a AS node, count(*) AS n_links FROM e GROUP BY a)
SELECT d.doc_id, CASE WHEN t.node IS NULL THEN d.doc_id ELSE class_id END AS class_id, coalesce(n_links, 0) AS n_links FROM documents d LEFT JOIN t ON d.text = t.text LEFT JOIN c ON c.node = t.node LEFT JOIN k ON k.node = t.node
"""
