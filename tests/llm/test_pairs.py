import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.llm import ann, ngram_join


def brute_join(rows, threshold=0.8):
    """class id and number of linked texts of each (doc_id, text), by comparing all different texts."""
    ids = collections.defaultdict(list)
    for doc, text in rows:
        ids[text].append(doc)
    sets = {}
    for text in ids:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        if w:
            sets[text] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}
    texts = sorted(sets)
    parent = {t: t for t in texts}

    def root(t):
        while parent[t] != t:
            t = parent[t]
        return t

    links = collections.Counter()
    for i, a in enumerate(texts):
        for b in texts[:i]:
            if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-12:
                links[a] += 1
                links[b] += 1
                parent[root(a)] = root(b)
    least = {}
    for t in texts:
        own = [d for d in ids[t] if d is not None]
        least[root(t)] = min([*own, least.get(root(t), 10**9)])
    return sorted((str(d), str(least[root(t)] if t in sets else d), links[t]) for d, t in rows)


def near_copies(rng, n_groups=6, size=12):
    rows, doc = [], 0
    for g in range(n_groups):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randint(8, 150))]
        for _ in range(size):
            words = list(base)
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = f"v{rng.randrange(999)}"
            rows.append((doc, " ".join(words)))
            doc += 1
    return rows


EDGES = [(900, None), (901, ""), (902, " \n"), (903, "one two"), (904, "one  two"), (905, "one two"), (906, "two one"), (903, "one two"), (907, "x " * 4000), (908, "x " * 3000)]


def test_join_is_exact(spark):
    rows = near_copies(random.Random(5)) + EDGES
    docs = spark.createDataFrame([(*r, "a", 1) for r in rows], "doc_id long, text string, key string, n_links int")
    found = ngram_join.join(docs).collect()
    assert sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in found) == brute_join(rows)
    kept = ngram_join.deduplicated(docs).collect()
    classes = {r.class_id for r in found if r.key is not None}
    by_id = {r.doc_id: r.class_id for r in found}
    with_words = [r for r in kept if r.text and r.text.strip()]
    assert sorted(by_id[r.doc_id] for r in with_words) == sorted(classes) and len(kept) == len(with_words) + 3
    assert ngram_join.join(docs.limit(0)).count() == 0


def test_join_of_blocks_is_the_same(spark, monkeypatch):
    """Groups and buckets beyond a block are compared by pairs of blocks."""
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    rows = near_copies(random.Random(8), 3, 15)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in ngram_join.join(docs).collect()) == brute_join(rows)


def test_join_on_the_documents(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").where("doc_id < 300").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in ngram_join.join(docs).collect()) == brute_join(rows)


def test_pruning_rarely_drops_what_reaches_the_threshold():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 1 << 16, (20_000, ngram_join.HASHES)).astype(np.uint16)
    at = np.arange(len(y))
    for similarity, low, high in ((0.8, 0.9999, 1.0), (0.4, 0.0, 0.001)):
        x = np.where(rng.random(y.shape) < similarity, y, y + 1).astype(np.uint16)
        share = len(ngram_join.pruned(x, y, at, at)[0]) / len(y)
        assert low <= share <= high


def test_a_link_that_pruning_keeps_is_in_one_group(spark):
    """One node settled, the other as far from the pivot as a pair that is not pruned allows, in their one bucket."""
    least = ngram_join.least_matches()[-1][1]
    y = ngram_join.HASHES - least  # values in which the two differ, at least one in each band but the first
    differ = [5 * band + r for r in range(5) for band in range(1, ngram_join.BANDS)][:y]
    other = [i for i in range(5, ngram_join.HASHES) if i not in differ][:40]
    pivot = np.arange(ngram_join.HASHES, dtype=np.uint16)
    a, b = pivot.copy(), pivot.copy()
    a[other] += 1000
    b[other] += 1000
    b[differ] += 2000
    assert (a == pivot).mean() == ngram_join.SETTLED and (a == b).sum() == least
    nodes = spark.createDataFrame([(i, x.tobytes()) for i, x in enumerate((pivot, a, b))], "node long, sig binary")
    labels = {r.node: r.label for r in ngram_join.components(ngram_join._candidates(nodes), "test").collect()}
    assert labels == {0: 0, 1: 0, 2: 0}


def test_shared_shingles_both_ways():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 300, 120)).astype(np.uint64) for _ in range(20)]
    left, right = np.triu_indices(20, 1)
    want = [len(np.intersect1d(sets[i], sets[j])) for i, j in zip(left, right, strict=True)]
    assert ngram_join.shared_shingles(sets, left, right).tolist() == want
    few = ngram_join.shared_shingles([np.arange(a, a + 200_000, dtype=np.uint64) for a in (0, 100_000)], np.array([0]), np.array([1]))
    assert few.tolist() == [100_000]


def test_agreement_of_signatures_is_the_similarity():
    words = [f"w{i}" for i in range(900)]
    other = words[:700] + [f"v{i}" for i in range(200)]
    found, at = ngram_join.shingle_hashes(pa.array([" ".join(words), " ".join(other)]))
    a, b = (ngram_join.signature(found[s:e], *ngram_join._multipliers()) for s, e in zip(at[:-1], at[1:], strict=True))
    exact = 696 / (896 * 2 - 696)
    assert abs((a == b).mean() - exact) < 0.15


def vectors(spark, extra=()):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=16).tolist(), 1) for i in range(3000)]
    rows += [(5000 + i, rows[7][1], 1) for i in range(200)]
    return rows + list(extra), "vec_id long, embedding array<double>, rank int"


def test_neighbours_against_brute_force(spark):
    bad = [(7001, None, 1), (7000, [0.0] * 16, 1), (7020, [float("nan")] * 16, 1), (7040, [None] + [1.0] * 15, 1), (7060, [float("inf")] * 16, 1), (7080, [1.0] * 5, 1), (7100, [], 1), (None, [1.0] * 16, 1)]
    rows, schema = vectors(spark, bad)
    out = ann.search(spark.createDataFrame(rows, schema), F.col("vec_id") % 20 == 0, k=10).collect()
    ids = np.array([r[0] for r in rows[: -len(bad)]])
    x = np.array([r[1] for r in rows[: -len(bad)]])
    found = collections.defaultdict(list)
    for r in out:
        found[r.query_id].append(r)
    assert set(found) == {i for i in ids.tolist() if i % 20 == 0}
    hits = 0
    for i in np.flatnonzero(ids % 20 == 0):
        score = (x * x[i]).sum(1)
        score[i] = -np.inf
        best = np.lexsort((ids, -score))[:10]
        own = sorted(found[ids[i]], key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 11))
        assert [(r.score, -r.vec_id) for r in own] == sorted(((r.score, -r.vec_id) for r in own), reverse=True)
        assert all(r.score == pytest.approx(float(score[ids == r.vec_id][0]), abs=1e-12) for r in own)
        hits += len({r.vec_id for r in own} & set(ids[best].tolist()))
    assert hits / (10 * len(found)) >= 0.9


def test_small_tables_visit_as_many_partitions_as_the_sample_asks_for(spark, monkeypatch):
    """And a query is never left with fewer than k rows while there are more."""
    asked = []
    monkeypatch.setattr(ann, "visits", lambda *a: asked.append(a) or 1)
    rng = np.random.default_rng(6)
    rows = [(i, (rng.normal(size=8) + 9 * np.eye(8)[i % 8]).tolist()) for i in range(120)]
    found = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, k=60).collect()
    assert len(asked) == 1 and collections.Counter(r.query_id for r in found) == {i: 60 for i in range(0, 120, 20)}


def test_vectors_of_each_length_are_ranked(spark):
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=8 if i < 60 else 5).tolist()) for i in range(70)] + [(80, [1.0])]
    found = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.lit(True), k=4).collect()
    assert collections.Counter(r.query_id for r in found) == {i: 4 for i in range(70)}
    assert all((r.query_id < 60) == (r.vec_id < 60) for r in found)


def test_few_or_no_neighbours(spark):
    schema = "vec_id long, embedding array<float>"
    out = ann.search(spark.createDataFrame([(0, [1.0, 2.0, 3.0]), (1, [1.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0])], schema), F.col("vec_id") == 0).collect()
    assert sorted((r["rank"], r.vec_id, r.score) for r in out) == [(1, 1, 1.0), (2, 2, 1.0)]
    assert ann.search(spark.createDataFrame([], schema), F.lit(True)).count() == 0


def test_codes_weigh_the_parallel_error():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2000, 16))
    loss = {}
    for eta in (1.0, 4.0):
        index = ann.fit(x, 8)._replace(eta=eta)
        at = np.argmax(x @ index.centres.T - 0.5 * (index.centres**2).sum(1), 1)
        codes = ann._codes(x, x - index.centres[at], index)
        near = index.centres[at] + np.stack([index.codebooks[s][codes[:, s]] for s in range(8)], 1).reshape(len(x), 16)
        loss[eta] = float((((x - near) * x).sum(1) ** 2 / (x * x).sum(1)).mean())
        scanned = ann.scan(x[:5], codes, index)
        assert np.allclose(scanned, x[:5] @ (near - index.centres[at]).T, atol=1e-4)
    assert loss[4.0] < loss[1.0]


def test_words_of_one_crc_and_length_are_different():
    import pyarrow as pa

    one, two = (ngram_join.shingle_hashes(pa.array([f"a b c {w} d e f"]))[0] for w in ("gnyijstj", "etislvlf"))
    assert not set(one.tolist()) & set(two.tolist())
