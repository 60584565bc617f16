"""Divergence of sources, whitening and packing by differencing against brute force, with odd rows."""

import collections
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.llm import chunks, differencing, divergence, whitening

# --- op11 ---


def plain_audit(rows, min_docs, top):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))) for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        in_docs = collections.Counter(t for d in own for t in set(d[2]))
        kept = sorted(t for t, n in in_docs.items() if n >= min_docs)
        counts = {s: collections.Counter() for s in {d[1] for d in own}}
        for _, s, terms in own:
            counts[s].update(t for t in terms if in_docs[t] >= min_docs)
        total = sum(counts.values(), collections.Counter())

        def share(c, kept=kept):
            n = sum(c.values())
            return {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}

        p, q = {s: share(c) for s, c in counts.items()}, share(total)
        for s in counts:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in counts if o != s)
            terms = sorted((q[t] - p[s][t], t.encode()) for t in kept if counts[s][t] and p[s][t] > q[t])[:top]
            out += [(lang, s, part, item.decode(), -v, i + 1) for part, found in (("pair", pairs), ("term", terms)) for i, (v, item) in enumerate(found)]
    return sorted(out)


def audited(df, **options):
    return sorted(tuple(r) for r in divergence.audit(df, **options).collect())


def test_divergence_of_odd_rows(spark):
    rng = random.Random(3)
    words = ["alpha", "Beta", "BETA", "épée", "Éa", "ÉA", "x1y", "日本", "b_c", "İ", "z" * 3000]
    rows = [(rng.choice(["en", "de", None, ""]), rng.choice(["s", "S", "é", None, "z"]), " ".join(rng.choices(words, k=rng.randint(0, 9)))) for _ in range(120)]
    rows += [("en", "quiet", None), ("en", "still", ""), ("xx", "a", "one 12 !"), ("xx", "b", None), ("fr", "a", None), *rows[:5], ("en", "s", "alpha " * 50_000)]
    df = spark.createDataFrame(rows, "lang string, source string, text string").withColumns({"term": F.lit("x"), "n": F.lit(1), "at": F.lit(None).cast("string"), "value": F.lit(2.5), "block": F.lit("y")})
    assert audited(df, min_docs=3, top=4, terms=2, slice_bytes=2_000) == plain_audit(rows, 3, 4)
    assert audited(df, min_docs=1, top=2) == plain_audit(rows, 1, 2)


def test_divergence_over_blocks_of_sources(spark, monkeypatch):
    """More sources than a block holds, and terms that only some of them have."""
    monkeypatch.setattr(divergence, "SOURCES", 4)
    rows = [("en", f"s{i % 11}", f"all w{i % 7} w{i % 5} only{i % 11}") for i in range(150)]
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    a, b = np.zeros(4, np.int64) + 3, np.zeros(2, np.int64) + 5
    head = {"lang": "en", "a": 0, "b": 1, "v": 2, "block": -1, "zeros_a": a.tolist(), "zeros_b": b.tolist()}
    assert divergence.tile(pa.Table.from_pylist([head]), pa.table({})).column("value").to_pylist() == [4] * 8
    head["block"] = 0
    entries = pa.table({"term": ["t", "t", "u"], "at": [1, 5, 4], "of": [0, 1, 1], "p": [9, 2, 8], "q": [5, 5, 5]})
    made = divergence.tile(pa.Table.from_pylist([head]), entries).to_pylist()
    p = {0: (3, 3), 1: (9, 3), 2: (3, 3), 3: (3, 3), 4: (5, 8), 5: (2, 5)}
    assert {(r["at"], r["other"]): r["value"] for r in made} == {(i, j): sum(abs(x - y) for x, y in zip(p[i], p[j], strict=True)) - 4 for i in range(4) for j in (4, 5)}
    monkeypatch.undo()
    assert audited(df, min_docs=2, terms=3) == plain_audit(rows, 2, 50)
    many = [("en", f"s{i:03}", f"t{i % 9} u{i % 4}") for i in range(270)]
    assert audited(spark.createDataFrame(many, df.schema), min_docs=2) == plain_audit(many, 2, 50)


def test_probabilities_are_exact(spark):
    cases = [(0, 0, 1), (0, 10**15, 10**6), (10**15, 10**15, 1), (123_456_789_012, 10**13 + 7, 991), (3, 17, 0)]
    got = spark.createDataFrame(cases, "n long, t long, v long").select(divergence.probability(F.col("n"), F.col("t"), F.col("v"))).collect()
    assert [r[0] for r in got] == [1 + 10**9 * (n + 5) // (t + 5 * v) if v or t else None for n, t, v in cases]


def test_divergence_of_an_empty_table(spark):
    df = spark.createDataFrame([], "lang string, source string, text string")
    assert audited(df) == []


# --- op12 ---


def plain_whitening(vectors, k):
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(0)
    centred = x - 1_000_000 - (s - 1_000_000 * n) / n
    values, turn = np.linalg.eigh(centred.T @ centred / n)
    values, turn = values[::-1], turn[:, ::-1]
    deviation = ((n * x.astype(object) - s.astype(object)) ** 2).sum(1).tolist()
    return centred @ turn[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum(), deviation


def whitened(spark, rows, kind="float", **options):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").withColumns({"n": F.lit("x"), "key": F.lit(1), "v": F.lit(2), "whitened": F.lit(0)})
    return whitening.whiten(df, **options).collect()


@pytest.mark.parametrize(("dims", "k"), [(6, 32), (40, 3)])
def test_whitening_is_that_of_the_covariance(spark, dims, k):
    rng = np.random.default_rng(dims)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((300, dims)) * np.linspace(1, 9, dims) + 5)]
    odd = [(900, None), (901, [float("nan")] * dims), (902, [1.0] * (dims - 1) + [float("inf")]), (903, [None] + [1.0] * (dims - 1)), (904, [])]
    rows += [(None, rows[0][1]), (1, rows[1][1])]
    got = whitened(spark, rows + odd, "double", k=k)
    want, explained, deviation = plain_whitening([v for _, v in rows], k)
    by_row = {(r.deviation, round(r.whitened[0] * r.whitened[1], 6)): r for r in got}
    assert len(got) == len(rows) and collections.Counter(r.vec_id for r in got) == collections.Counter(i for i, _ in rows)
    sides = None
    for w, d in zip(want, deviation, strict=True):
        r = by_row[d, round(w[0] * w[1], 6)] if (d, round(w[0] * w[1], 6)) in by_row else by_row[d, round(-w[0] * w[1], 6)]
        sides = np.sign(np.array(r.whitened) * w) if sides is None else sides
        assert np.allclose(np.array(r.whitened) * sides, w, atol=1e-8)
        assert (r.n, len(r.whitened)) == (len(rows), min(k, dims)) and np.allclose(r.explained, explained, rtol=1e-9) and r.identity_error < 1e-9


def test_a_narrow_block_takes_passes_until_certified(spark):
    rng = np.random.default_rng(5)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((400, 30)) * np.geomspace(20, 1, 30))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    model = whitening.fit(df, "embedding", 30, k=4, spare=8)
    want = plain_whitening([v for _, v in rows], 4)
    assert model.passes > 3 and np.allclose(model.values / model.trace, want[1], rtol=1e-9)
    with pytest.raises(RuntimeError, match="not certified after 2 passes"):
        whitening.fit(df, "embedding", 30, k=4, spare=8, max_passes=2)


def test_whitening_of_few_or_equal_vectors(spark):
    assert whitened(spark, []) == []
    assert [(r.n, r.deviation, r.whitened, r.explained) for r in whitened(spark, [(1, [1.0, 2.0])] * 3)] == [(3, 0, [], [])] * 3
    flat = whitened(spark, [(i, [float(i), 7.0]) for i in range(4)])
    assert {len(r.whitened) for r in flat} == {1} and abs(flat[0].explained[0] - 1) < 1e-12  # one positive eigenvalue
    two = whitened(spark, [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0]), (4, [2.0])])
    assert sorted((r.vec_id, r.n) for r in two) == [(1, 2), (2, 2), (3, 2), (4, 2)]


def test_deviations_beyond_64_bits_are_exact(spark):
    rows = [(i, [float(v)] * 3) for i, v in enumerate([1e9, -1e9, 12345.5, 1e300, -3e38])]
    x = [[min(max(int(np.floor(64 * v)) if abs(v) < 1e17 else int(np.sign(v)) << 60, -(1 << 45)), 1 << 45)] * 3 for _, (v, *_) in rows]
    n, s = len(x), [sum(c) for c in zip(*x, strict=True)]
    got = {r.vec_id: int(r.deviation) for r in whitened(spark, rows, "double")}
    assert got == {i: sum((n * a - b) ** 2 for a, b in zip(v, s, strict=True)) for i, v in enumerate(x)}


# --- op13 ---


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(differencing.default_tokenizer())


def test_chunks_are_encoded_as_whole_texts(tokenizer):
    rng = random.Random(1)
    marks = [" ", "  ", "\n", "\t", "a", "Bc", "é", "à", "\xa0", "　", " ", " ", " ", "\x85", "'s", "'ll", "1", "23", "<|endoftext|>", "#", "\x1c", "\x1f", "ā", "漢", "😀", "Ġ", "\x00", "\r"]
    texts = ["", None, "  a  ", *("".join(rng.choices(marks, k=rng.randint(1, 40))) for _ in range(1500))]
    encoder = chunks.ChunkEncoder(differencing.default_tokenizer(), cache_words=500)
    for some in (texts[:700], texts[700:], texts):
        ids, n = encoder.encode(pa.array(some, pa.string()))
        ends = np.cumsum(n)
        assert [ids[e - k : e].tolist() for e, k in zip(ends, n, strict=True)] == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in some]


def plain_differencing(sizes, ways):
    """Largest differencing over lists of lists."""
    parts = [[(s, [i])] + [(0, [])] * (ways - 1) for i, s in enumerate(sizes)]
    made = {i: p for i, p in enumerate(parts)}
    while len(made) > 1:
        (i, a), (j, b) = sorted(made.items(), key=lambda x: (x[1][-1][0] - x[1][0][0], x[0]))[:2]
        merged = [(x[0] + y[0], x[1] + y[1]) for x, y in zip(a, b[::-1], strict=True)]
        del made[i], made[j]
        made[max([*made, i, j, len(sizes) - 1]) + 1] = sorted(merged, key=lambda x: -x[0])
    return sorted(s for s, _ in next(iter(made.values())))


def test_differencing_gives_the_sums_of_the_plain_method():
    rng = np.random.default_rng(2)
    for n, ways in itertools.product((1, 2, 5, 40), (1, 2, 3, 7)):
        sizes = rng.integers(1, 300, n)
        sums = np.bincount(differencing.differenced(sizes, ways), sizes, ways)
        assert sums.sum() == sizes.sum() and sorted(sums.tolist()) == plain_differencing(sizes.tolist(), ways)


def test_windows_rise_until_all_fit():
    rng = np.random.default_rng(4)
    for lengths in (np.array([250] * 900), np.array([1] * 5000), rng.integers(1, 257, 3000), np.array([7]), np.array([2047, 2047, 2047])):
        window, ways = differencing.windows(lengths)
        sums = np.bincount(window, lengths, ways)
        assert sums.max() <= 2048 and len(window) == len(lengths)
    assert differencing.windows(np.array([250] * 900))[1] > 900 * 250 / 2048 + 1  # eight of 250 to a window


def checked(docs, rows, tokenizer, capacity):
    """Rows of a packing against the texts' own ids; returns its sequences' lengths."""
    ids = collections.defaultdict(list)
    for doc, text in docs:
        ids[doc].append([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1])
    sequences = collections.defaultdict(list)
    for doc, own in ids.items():
        parts = sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows if r.doc_id == doc)
        want = []
        for one in own:  # cuts may lie anywhere: those of the rows that start a text anew
            starts = sorted({s for s, _, _, t in parts if t == len(one)})
            for a, b in zip(starts, [*starts[1:], len(one)], strict=True):
                want.append((a, b - a, zlib.crc32(np.array(one[a:b], "<u4").tobytes()), len(one)))
        assert parts == sorted(want)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == list(itertools.accumulate([n for _, n in parts[:-1]], initial=0))
    sums = [sum(n for _, n in parts) for parts in sequences.values()]
    assert max(sums, default=0) <= capacity
    return sums


def test_packing_covers_each_id_once(spark, tokenizer, small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").limit(300).collect()]
    docs += [(9_000, None), (9_001, ""), (None, "no id"), (9_002, "twice"), (9_002, "twice"), (9_003, "word " * 30_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"length": F.lit("x"), "place": F.lit(1), "group": F.lit(2)})
    sums = checked(docs, differencing.pack(df, group_windows=16).collect(), tokenizer, 2048)
    assert sum(sums) / (2048 * len(sums)) > 0.97
    sums = checked(docs, differencing.pack(df, capacity=100, piece=30, group_windows=50).collect(), tokenizer, 100)
    assert sum(sums) / (100 * len(sums)) > 0.95


def test_packing_of_an_empty_table(spark):
    assert differencing.pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []
