"""How sources of a language differ in their words: smoothed probabilities of terms, compared over dense tiles.

Tasks count terms of many texts at a time; Spark sums the counts by (language, source, term). Terms in enough documents
are dealt, by hash, to blocks of about `TERMS` terms of a language, and sources, by order, to blocks of `SOURCES`. A tile
is one block of terms against one pair of blocks of sources: a dense int64 matrix, group by term, on which all pairs are
computed by broadcasting. It gives, for each pair, a partial sum, and for each group a heap of its best terms; Spark sums
the one and merges the other. A term that neither group of a pair has differs by the same amount for all of them, so
tiles hold only terms that occur in their sources, and sum what a pair's terms add to that amount.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm import common, tokens
from plumbline.llm.words import words_of

MIN_DOCS = 30
SCALE = 1_000_000_000
SMOOTH = 5
TOP = 50
TERMS = 512
SOURCES = 256
#: Bytes of text whose words are counted together in a task.
SLICE_BYTES = 12_000_000
COUNTS = "lang string, source string, term string, n long, docs long"
#: Bytes of terms as they are and lower-cased; all others part terms.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def folded(texts: pa.Array) -> pa.Array:
    """Texts whose terms are lower-cased, in A to Z alone, and parted by spaces."""
    texts = pc.fill_null(texts, "")
    at = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset)
    held = texts.buffers()[2].to_pybytes()[at[0] : at[-1]] if at[-1] > at[0] else b""
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer((at - at[0]).astype(np.int32).tobytes()), pa.py_buffer(held.translate(_FOLD)))


def counts(docs: DataFrame, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """lang, source, term, occurrences and documents that hold it; a row without a term for every group."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in tokens.in_slices(batch.column(2), slice_bytes):
                words = words_of(folded(batch.column(2)[a:b]))
                group = pa.StructArray.from_arrays([pc.fill_null(batch.column(i)[a:b], "") for i in (0, 1)], ["lang", "source"])
                names = pa.table({"lang": group.field(0), "source": group.field(1), "at": pa.array(np.arange(b - a))}).group_by(["lang", "source"]).aggregate([("at", "min"), ("at", "list")])
                of_text = np.empty(b - a, np.int64)
                of_text[pc.list_flatten(names["at_list"]).to_numpy()] = pc.list_parent_indices(names["at_list"].combine_chunks()).to_numpy()
                size = max(len(words.distinct), 1)
                of_doc, times = np.unique(words.of_text * size + words.codes, return_counts=True)
                key, inverse = np.unique(of_text[of_doc // size] * size + of_doc % size, return_inverse=True)
                n = np.bincount(inverse, times, len(key)).astype(np.int64)
                own, empty = key // size, np.arange(len(names))
                at = np.concatenate([own, empty])
                term = pa.concat_arrays([words.distinct.take(pa.array(key % size)), pa.array([""] * len(names), pa.string())])
                yield pa.RecordBatch.from_arrays(
                    [names["lang"].combine_chunks().take(pa.array(at)), names["source"].combine_chunks().take(pa.array(at)), term, pa.array(np.append(n, 0 * empty)), pa.array(np.append(np.bincount(inverse, minlength=len(key)), 0 * empty))],
                    ["lang", "source", "term", "n", "docs"],
                )

    read = docs.select(F.col("lang").cast("string"), F.col("source").cast("string"), F.col("text").cast("string"))
    return read.mapInArrow(common.lean(count), COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def probability(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE (count + SMOOTH) / (total + SMOOTH terms)), exactly; null where there are no terms."""
    part = (count + SMOOTH).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)")
    every = (total + SMOOTH * terms).cast("decimal(19,0)")
    return F.when(every > 0, F.call_function("div", part, F.when(every > 0, every)) + 1)


def tile(heads: pa.Table, entries: pa.Table, top: int = TOP) -> pa.Table:
    """A tile's partial sums of pairs (`item` null) and its groups' best terms (`other` null).

    `heads` is one row: the probability of a missing term in each source of the one block (`a`) and of the other (`b`),
    by place, the number of the language's terms (`v`), and the block of terms, -1 for what all terms have in common.
    """
    head = heads.slice(0, 1).to_pylist()[0]
    a, b = (np.array(head[x], np.int64) for x in ("zeros_a", "zeros_b"))
    one_block = head["a"] == head["b"]
    base = np.abs(a[:, None] - b)
    if head["block"] < 0:
        sums, best = base * head["v"], []
    else:
        at, term = entries["at"].to_numpy(), entries["term"].combine_chunks().dictionary_encode()
        code, p, of_block = term.indices.to_numpy(), entries["p"].to_numpy(), entries["of"].to_numpy()
        width = len(term.dictionary)

        def dense(zeros: np.ndarray, block: int) -> np.ndarray:
            out = np.repeat(zeros[:, None], width, 1)
            own = of_block == block
            out[at[own] - block * SOURCES, code[own]] = p[own]
            return out

        left, right = dense(a, head["a"]), dense(b, head["b"])
        sums = np.empty_like(base)
        for i in range(len(a)):  # a group against all groups of the other block at a time
            sums[i] = np.abs(right - left[i]).sum(1)
        sums -= base * width
        best = _heaps(entries, top) if one_block else []
    i, j = np.nonzero(np.triu(np.ones_like(base), 1)) if one_block else np.indices(base.shape).reshape(2, -1)
    n, m = len(i), sum(len(x) for x, _ in best)
    lang, terms = pa.array([head["lang"]] * (n + m), pa.string()), [t.take(pa.array(x)) for x, t in best]
    return pa.table(
        {
            "lang": lang,
            "at": np.concatenate([head["a"] * SOURCES + i, *(entries["at"].to_numpy()[x] for x, _ in best)]).astype(np.int64),
            "other": pa.concat_arrays([pa.array(head["b"] * SOURCES + j, pa.int64()), pa.nulls(m, pa.int64())]),
            "item": pa.concat_arrays([pa.nulls(n, pa.string()), *(pa.array(t.to_pylist(), pa.string()) for t in terms)]),
            "value": np.concatenate([sums[i, j], *((entries["p"].to_numpy() - entries["q"].to_numpy())[x] for x, _ in best)]).astype(np.int64),
        }
    )


def _heaps(entries: pa.Table, top: int) -> list[tuple[np.ndarray, pa.Array]]:
    """Places of each group's `top` terms above the language's probability, by difference, then term."""
    gain = entries["p"].to_numpy() - entries["q"].to_numpy()
    above = entries.append_column("gain", pa.array(gain)).append_column("place", pa.array(np.arange(len(gain)))).filter(pa.array(gain > 0))
    above = above.append_column("bytes", above["term"].cast(pa.binary())).select(["at", "gain", "bytes", "place"]).sort_by([("at", "ascending"), ("gain", "descending"), ("bytes", "ascending")])
    at = above["at"].to_numpy()
    first = np.searchsorted(at, at)
    place = above["place"].to_numpy()[np.arange(len(at)) - first < top]
    return [(place, entries["term"].combine_chunks())]


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, terms: int = TERMS, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """lang, source, part (`pair` or `term`), item, value, rank: how each source of a language differs from its others.

    Columns read: lang, source, text, null as ''; others, whatever their names, may be there. Null, empty and very long
    texts are read whole; every row is a document, repeated ones too; a group without terms has pairs and no terms; a
    language without kept terms has pairs of value 0; ties are ranked by item in order of its UTF-8 bytes; an empty
    table gives none.
    """
    counted = common.stored(counts(docs, slice_bytes), "term-counts")
    in_docs = F.sum("docs").over(Window.partitionBy("lang", "term"))
    in_lang = F.sum("n").over(Window.partitionBy("lang", "term"))
    kept = counted.where("term != ''").withColumns({"in_docs": in_docs, "in_lang": in_lang}).where(F.col("in_docs") >= min_docs)
    kept = common.stored(kept.select("lang", "source", "term", "n", "in_lang"), "kept-terms")

    langs = kept.groupBy("lang", "term").agg(F.first("in_lang").alias("n")).groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("lang_n"))
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("source_n"))
    groups = counted.where("term = ''").select("lang", "source").join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
    filled = {c: F.coalesce(c, F.lit(0)) for c in ("source_n", "lang_n", "v")}
    groups = groups.withColumns(filled).withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    groups = groups.withColumns({"of": F.floor(F.col("at") / SOURCES), "zero": F.coalesce(probability(F.lit(0), F.col("source_n"), F.col("v")), F.lit(0).cast("long"))})
    groups = common.stored(groups, "term-groups")  # its size tells Spark whether to broadcast it

    # one row a block of sources: at most SOURCES values
    blocks = groups.groupBy("lang", "of", "v").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "zero"))), lambda x: x["zero"]).alias("zeros"))
    one, two = (blocks.select("lang", "v", F.col("of").alias(x), F.col("zeros").alias(f"zeros_{x}")) for x in "ab")
    pairs = common.stored(one.join(two.drop("v"), "lang").where("a <= b"), "source-blocks")

    rated = kept.join(groups.select("lang", "source", "source_n", "lang_n", "v", "at", "of"), ["lang", "source"])
    block = F.pmod(F.xxhash64("term"), F.ceil(F.col("v") / terms)).cast("long")
    rated = rated.select("lang", "term", "at", "of", block.alias("block"), probability(F.col("n"), F.col("source_n"), F.col("v")).alias("p"), probability(F.col("in_lang"), F.col("lang_n"), F.col("v")).alias("q"))
    rated = common.stored(rated, "rated-terms")
    keys = ["lang", "block", "a", "b"]
    sides = pairs.select("lang", "a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("of"))
    entries = rated.join(sides, ["lang", "of"]).select(*keys, "term", "at", "of", "p", "q")
    whole = pairs.withColumn("block", F.lit(-1).cast("long"))
    heads = whole.unionByName(pairs.join(rated.select("lang", "block", F.col("of")).distinct().join(sides, ["lang", "of"]).select(*keys).distinct(), ["lang", "a", "b"]))
    heads = common.stored(heads, "tile-heads")
    made = heads.groupBy(*keys).cogroup(entries.groupBy(*keys)).applyInArrow(lambda h, e: tile(h, e, top), "lang string, at long, other long, item string, value long")
    made = common.stored(made, "term-tiles")

    names = groups.select("lang", "at", "source")
    sums = made.where("item IS NULL").groupBy("lang", "at", "other").agg(F.sum("value").alias("value"))
    both = sums.select("lang", "value", F.explode(F.array(F.struct(F.col("at").alias("at"), F.col("other").alias("other")), F.struct(F.col("other").alias("at"), F.col("at").alias("other")))).alias("x")).select("lang", "value", "x.*")
    pair = both.join(names, ["lang", "at"]).join(names.select("lang", F.col("at").alias("other"), F.col("source").alias("item")), ["lang", "other"]).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    best = made.where("item IS NOT NULL").join(names, ["lang", "at"]).select("lang", "source", F.lit("term").alias("part"), "item", "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")).cast("int")
    ranked = pair.withColumn("rank", rank).unionByName(best.withColumn("rank", rank).where(F.col("rank") <= top))
    return ranked.select("lang", "source", "part", "item", "value", "rank")


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(common.table(spark, sf_dir, "documents"))


OP11_SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS doc, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
terms AS (
  SELECT doc, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*)::HUGEINT AS n FROM terms GROUP BY lang, term HAVING count(DISTINCT doc) >= {MIN_DOCS}),
langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS n FROM kept GROUP BY lang),
counted AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM terms SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
groups AS (
  SELECT g.lang, g.source, coalesce(c.n, 0)::HUGEINT AS n
  FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN (SELECT lang, source, sum(n) AS n FROM counted GROUP BY lang, source) c USING (lang, source)),
rated AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    (1 + {SCALE}::HUGEINT * (coalesce(c.n, 0) + {SMOOTH}) // (g.n + {SMOOTH} * l.v))::BIGINT AS p,
    (1 + {SCALE}::HUGEINT * (k.n + {SMOOTH}) // (l.n + {SMOOTH} * l.v))::BIGINT AS q
  FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce((
    SELECT sum(abs(x.p - y.p)) FROM rated x JOIN rated y USING (lang, term) WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source != b.source),
best AS (SELECT lang, source, term AS item, p - q AS value FROM rated WHERE n > 0 AND p > q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM pairs
  UNION ALL SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER FROM best)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= {TOP}
"""
