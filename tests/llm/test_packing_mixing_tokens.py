import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.llm import mixing, packing, token_files, tokens

tokenizers = pytest.importorskip("tokenizers")
ODD = ["", " ", "a", "Don't STOP, it's 12.5%!!", "<|endoftext|> x<|startoftext|>", "é É ß ﬁ İ ΑΣ σς", "a\x0bb\x0cc\td\x85e　f\x1fg", "日本語 テスト。", "x" * 5000, "á é!", "!!! ... ##", "\n\n1 2 3", "naïve,naïve;", "²½ ª º µ", "🙂🙂 ok🙂"]


@pytest.fixture(scope="module")
def plain():
    return tokenizers.Tokenizer.from_file(packing.default_tokenizer())


def ids_of(plain, text):
    return plain.encode(text or "", add_special_tokens=False).ids


def test_cached_ids_are_the_tokenizers(plain):
    encoder = tokens.WordEncoder(packing.default_tokenizer(), cache_words=20)
    for texts in (ODD, ODD[::-1], [*ODD, None]):
        ids, n = encoder.encode(pa.array(texts, pa.string()))
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [ids_of(plain, t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aAbéÉß'sS.,!<|>{}12 \t\n\x0b́　🙂Σ"), max_size=30), max_size=4))
def test_cached_ids_of_any_text(texts):
    own = tokens.encoder(packing.default_tokenizer())
    ids, n = own.encode(pa.array(texts, pa.string()))
    assert [x.tolist() for x in np.split(ids, np.cumsum(n))[: len(texts)]] == [own.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.integers(2, 40).flatmap(lambda c: st.tuples(st.just(c), st.dictionaries(st.integers(1, c), st.integers(1, 30), max_size=c))))
def test_plan_fills_each_place_once(case):
    capacity, counts = case
    rows = packing.plan(counts, capacity)
    held: dict[int, list] = {}
    for length, n in counts.items():
        own = [r for r in rows if r[0] == length]
        for rank in range(n):
            _, since, first, offset, each = max((r for r in own if r[1] <= rank), key=lambda r: r[1])
            j = rank - since
            held.setdefault(first + j // each, []).append((offset + j % each * length, length))
    for content in held.values():
        end = 0
        for offset, length in sorted(content):
            assert offset == end
            end += length
        assert end <= capacity
    room: list[int] = []  # best-fit decreasing, a piece at a time
    for length in sorted((k for k, n in counts.items() for _ in range(n)), reverse=True):
        fits = [i for i, left in enumerate(room) if left >= length]
        if fits:
            room[min(fits, key=lambda i: room[i])] -= length
        else:
            room.append(capacity - length)
    assert len(held) == len(room)


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, length string, rank int, source string")


def test_packing_keeps_all_ids_and_cuts_long_texts_only(spark, plain):
    long_text = " ".join(f"w{i}" for i in range(3000))
    rows = [(1, "a b c", "x", 1, "s"), (2, None, None, None, None), (3, "", "x", 1, "s"), (4, long_text, "x", 1, "s"), (5, "a b c", "x", 1, "s"), (5, "a b c", "x", 1, "s"), (None, "z", "x", 1, "s")]
    out = packing.pack(documents(spark, rows), capacity=64).collect()
    by_doc: dict = {}
    for r in out:
        by_doc.setdefault(r.doc_id, []).append(r)
    for doc, text in {1: "a b c", 2: None, 3: "", 4: long_text, None: "z"}.items():
        ids = np.array([*ids_of(plain, text), packing.END_ID], "<u4")
        found = sorted(by_doc[doc], key=lambda r: r.piece)
        assert [(r.start, r.length, r.ids_crc32) for r in found] == [(s, len(ids[s : s + 64]), zlib.crc32(ids[s : s + 64].tobytes())) for s in range(0, len(ids), 64)]
    assert len(by_doc[5]) == 2
    places = sorted((r.sequence_id, r.offset, r.length) for r in out)
    for (s, o, n), (t, p, _) in zip(places, places[1:], strict=False):
        assert p == (o + n if s == t else 0)
    assert packing.pack(documents(spark, [])).count() == 0


def test_packing_is_near_the_bound_on_the_documents(spark, small):
    out = packing.op1_pack(spark, small)
    total, used = out.agg(F.sum("length"), F.count_distinct("sequence_id")).first()
    assert used <= -(-total // packing.CAPACITY) * 1.01 + 1


def water(sizes, weights, epochs):
    """Targets by plain rounds over exact fractions."""
    from fractions import Fraction

    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped: set = set()
    while True:
        left = sum(sizes.values()) - sum(epochs * sizes[s] for s in capped)
        w = sum(weight[s] for s in names if s not in capped)
        over = {s for s in names if s not in capped and Fraction(weight[s] * left, w) > epochs * sizes[s]}
        if not over:
            return {s: epochs * sizes[s] if s in capped else Fraction(weight[s] * left, w) for s in names}
        capped |= over


def test_mix_meets_targets(spark):
    rows = [(i, "w " * (i % 7), "x", 1, "abcd"[i % 4] if i % 9 else None) for i in range(400)] + [(1000, "w " * 30, "x", 1, "zz"), (1001, None, "x", 1, "zero"), (None, "w w", "x", 1, "a"), (5, "w", "x", 1, "a"), (5, "w", "x", 1, "a")]
    docs = documents(spark, rows).withColumn("size", F.when(F.col("text").isNull(), 0).otherwise(F.size(F.expr("filter(split(text, ' '), w -> w <> '')"))).cast("long"))
    out = mixing.mix(docs).collect()
    assert len(out) == len(rows)
    sizes: dict = {}
    for r in out:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    want = water(sizes, mixing.WEIGHTS, mixing.EPOCHS)
    taken: dict = {}
    for r in out:
        assert r.target == pytest.approx(float(want[r.source])) and 0 <= r.copies <= mixing.EPOCHS and r.source_size == sizes[r.source]
        taken[r.source] = taken.get(r.source, 0) + r.copies * r.size
    for s in want:
        assert abs(taken[s] - want[s]) <= max((r.size for r in out if r.source == s), default=0)
    taken_of = lambda found: sorted(((r.doc_id, r.source, r.size, r.copies) for r in found), key=str)
    assert taken_of(mixing.mix(docs.repartition(7)).collect()) == taken_of(out)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mix_is_the_sql(same_as_sql):
    assert same_as_sql(mixing.op3_mix, mixing.OP3_SQL)


def test_token_files_come_back_whole(spark, plain, tmp_path):
    rows = [(i * 7 % 50, t, "x", 1, "s") for i, t in enumerate([*ODD, None])] + [(None, "first", "x", 1, "s"), (7, "again", "x", 1, "s")]
    path = f"file://{tmp_path}/files"
    token_files.write(documents(spark, rows), path)
    files = token_files.read(spark, path)
    assert {(r.doc_id, tuple(r.tokens)) for r in files.collect()} == {(d, (*ids_of(plain, t), token_files.END_ID)) for d, t, *_ in rows}
    out = sorted(token_files.digests(files).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in out] == sorted((d for d, *_ in rows), key=lambda d: -1 if d is None else d)
    at = 0
    for r in out:
        assert r.start == at
        at += r.n_tokens
    assert {(r.doc_id, r.start, r.n_tokens) for r in token_files.positions(files).collect()} == {(r.doc_id, r.start, r.n_tokens) for r in out}
    token_files.write(documents(spark, []), f"{path}-none")
    assert token_files.digests(token_files.read(spark, f"{path}-none")).count() == 0


def test_token_files_have_dictionaries_and_page_indexes(spark, small, tmp_path):
    import pyarrow.parquet as pq

    token_files.write(spark.read.parquet(f"{small}/documents.parquet"), f"file://{tmp_path}/files")
    meta = pq.ParquetFile(next((tmp_path / "files").glob("*.parquet"))).metadata.row_group(0)
    columns = {meta.column(i).path_in_schema: meta.column(i) for i in range(meta.num_columns)}
    ids = next(c for name, c in columns.items() if name.startswith("tokens"))
    assert ids.has_dictionary_page and ids.has_offset_index and "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
