import pytest
from pyspark.sql import functions as F

from plumbline.llm import common
from tests.llm.test_pairs import brute_join

corpus_pipeline = pytest.importorskip("corpus_pipeline")  # all tests of this file are of its stages

#: Names that stages and operators use within themselves, or that they add.
CLASHES = "score _score score_ row key hash order words nth id n_docs target size copies source_size whole bucket sum before running no_source document _key _n _words _spans spans blocks text_key place uid node class_id n_links is_first quality".split()


def clashing(docs):
    """`docs` with a column for each such name, a map column and one whose name needs quotes."""
    more = [F.concat(F.lit(f"{name}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(name) for name in CLASHES]
    return docs.select("*", *more, F.create_map(F.lit("a"), F.col("doc_id")).alias("tags"), F.lit(1.5).alias("a.b"))


def odd(spark):
    text = "An honest page of ordinary words that says one thing after another until it has said enough for anyone to learn from it. "
    rows = [(1, text * 3, "en", "a", 5), (1, text * 3, "en", "a", 5), (2, None, "en", None, None), (3, "", None, "b", 0), (None, text + "tail", "en", "a", 9), (None, text + "tail", "en", "a", 9), (4, "x " * 30_000, "en", "c", 60_000), (5, "mail me at someone@example.org or 10.0.0.1 now", "en", "b", 2), (6, " \n\t", "en", "b", 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES[:-1])
def test_stages_keep_columns_of_any_name(spark, small, name, stage):
    docs = clashing(odd(spark))
    out = stage(spark, docs, small)
    assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    others = [c for c in docs.columns if c not in ("text", "n_chars", "tags")]
    known = {tuple(r) for r in docs.select([F.col(f"`{c}`") for c in others]).collect()}
    found = [tuple(r) for r in out.select([F.col(f"`{c}`") for c in others]).collect()]
    assert set(found) <= known and found
    plain = stage(spark, odd(spark), small)
    assert sorted(map(str, plain.collect())) == sorted(map(str, out.select("doc_id", "text", "lang", "source", "n_chars").collect()))


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stages_take_empty_tables(spark, small, name, stage):
    docs = odd(spark).limit(0)
    assert stage(spark, docs, small).count() == 0


def test_what_stages_do_with_odd_rows(spark, small):
    docs, stages = odd(spark), dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted((r.doc_id for r in df.collect()), key=str)
    assert ids(stages["near_duplicates"](spark, docs, small)) == sorted([1, 2, 3, None, 4, 5, 6], key=str)
    safe = {r.doc_id: r for r in stages["personal_data"](spark, docs, small).collect()}
    assert safe[5].text == "mail me at [email] or [ip] now" and safe[5].n_chars == len(safe[5].text)
    assert (safe[2].text, safe[2].n_chars, safe[3].text, safe[4].n_chars) == (None, None, "", 60_000)
    mixed = stages["mixture"](spark, docs, small).collect()
    assert not [r for r in mixed if r.doc_id in (2, 3, 6)] and all(1 <= sum(r.doc_id == d for r in mixed) <= 6 for d in {r.doc_id for r in mixed})
    packed = stages["packing"](spark, docs, small)
    assert packed.where("piece = 0").count() == docs.count() and packed.where("doc_id = 4").count() > 1
    judged = stages["quality"](spark, docs, small)
    assert [ids(judged).count(d) for d in (1, None)] in ([2, 2], [0, 0], [2, 0], [0, 2])


def test_free_names_are_free():
    assert common.unused(["a", "Score", "score_"], "score") == "score__" and common.unused([], "score") == "score"


def test_pipeline_stages(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet").where("doc_id < 400")
    columns, n, seen = docs.columns, docs.count(), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, small).write.parquet(f"{tmp_path}/{name}")
        docs = seen[name] = spark.read.parquet(f"{tmp_path}/{name}")
        assert name == "packing" or docs.columns == columns
    sizes = {k: v.count() for k, v in seen.items()}
    assert n > sizes["quality"] > sizes["near_duplicates"] == sizes["personal_data"]
    rows = [(r.doc_id, r.text) for r in seen["quality"].select("doc_id", "text").collect()]
    assert sorted(str(r.doc_id) for r in seen["near_duplicates"].collect()) and len({c for _, c, _ in brute_join(rows)}) == sizes["near_duplicates"]
    assert seen["personal_data"].where("text RLIKE '[a-z]@[a-z]+[.]' OR text LIKE '%+1 (%'").count() == 0
    copies = seen["mixture"].groupBy("doc_id").count().agg(F.max("count")).first()[0]
    assert 1 <= copies <= 3
    words = lambda df: df.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0]
    assert abs(words(seen["mixture"]) - words(seen["personal_data"])) < 0.05 * words(seen["personal_data"])
    assert seen["packing"].where("piece = 0").count() == sizes["mixture"]
