import pytest
from pyspark.sql import functions as F

from plumbline.functions import paths, stats, text
from plumbline.sources import files


def one(spark, column, **values):
    names = {k: F.lit(v) for k, v in values.items()}
    return spark.range(1).select(*[v.alias(k) for k, v in names.items()]).select(column).first()[0]


@pytest.mark.parametrize(("k", "n", "low"), [(34, 34, 0.8985), (35, 35, 0.9011), (0, 11, 0.0), (0, 0, 0.0)])
def test_wilson_lower(spark, k, n, low):
    assert one(spark, stats.wilson_lower(F.lit(k), F.lit(n))) == pytest.approx(low, abs=5e-5)


def test_bounds_hold_the_ratio(spark):
    rows = spark.range(1, 121).withColumnRenamed("id", "n").withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n"))))
    k, n = F.col("k"), F.col("n")
    bad = rows.where((stats.wilson_lower(k, n) > k / n) | (stats.wilson_upper(k, n) < k / n) | (stats.wilson_upper(k, n) > 1))
    assert bad.count() == 0


@pytest.mark.parametrize(("n", "floor"), [(1, 1), (9, 3), (16, 4), (100, 25), (400, 60)])
def test_applicability_floor(spark, n, floor):
    assert one(spark, stats.applicability_floor(F.lit(n))) == floor


@pytest.mark.parametrize(("n", "floor", "ceiling"), [(12, 3, 120), (2025, 8, 127), (100_000, 8, 500)])
def test_area_sizes(spark, n, floor, ceiling):
    assert one(spark, stats.area_floor(F.lit(n))) == floor
    assert one(spark, stats.area_ceiling(F.lit(n))) == ceiling


def test_authors_required(spark):
    assert [one(spark, stats.authors_required(F.lit(x).cast("double"))) for x in (0, 1, 2, 9, None, float("nan"))] == [1, 1, 2, 2, 2, 2]


@pytest.mark.parametrize(("word", "cls"), [("a-b", "kebab-case"), ("a_b", "snake_case"), ("aB", "camelCase"), ("Ab", "PascalCase"), ("ab", None), ("A_B", None), ("_a_b", None)])
def test_classify_word(spark, word, cls):
    assert one(spark, paths.classify_word(F.lit(word))) == cls


@pytest.mark.parametrize(("path", "cls"), [("x/001_my_file.rb", "snake_case"), ("MyFile.test.tsx", "PascalCase"), ("20240101.rb", None), ("Makefile", None)])
def test_classify_basename(spark, path, cls):
    assert one(spark, paths.classify_basename(F.lit(path))) == cls


@pytest.mark.parametrize(("path", "ext", "stem"), [("a/b.rb", "rb", "b"), (".env", "", ".env"), ("a.b/c", "", "c"), ("x/index.d.ts", "d.ts", "index")])
def test_extension_and_stem(spark, path, ext, stem):
    assert one(spark, paths.extension(F.lit(path))) == ext
    assert one(spark, paths.stem(F.lit(path))) == stem


def test_words_prefixes_languages(spark):
    assert one(spark, paths.stem_words(F.lit("a/httpClient-v2_x.js"))) == ["http", "client", "v2", "x"]
    assert [one(spark, paths.prefix_class(F.lit(x))) for x in ("IComment", "IO", "Name")] == ["I", "none", "none"]
    assert [one(spark, paths.language(F.lit(x))) for x in ("a.rb", "b.tsx", "Gemfile", "x.unknown")] == ["ruby", "jsx", "ruby", "js"]
    assert one(spark, paths.ancestors(F.lit("a/b"))) == [".", "a", "a/b"]
    assert one(spark, paths.version(F.lit("1.10")) > paths.version(F.lit("1.9")))


@pytest.mark.parametrize(
    ("path", "content", "reason"),
    [(".git/config", "", "denied"), ("node_modules/a.js", "", "excluded"), ("build/a.js", "", "excluded"), ("src/build/a.js", "", None), ("a.md", "", "not-source"), ("a.rb", "# DO NOT EDIT", None), ("a.rb", "# GENERATED FILE - DO NOT EDIT", "generated"), ("a.rb", "\n" * 11 + "@generated", None)],
)
def test_drop_reason(spark, path, content, reason):
    assert one(spark, files.drop_reason(F.lit(path), F.lit(content), F.lit(False))) == reason


def test_scan_of_a_tree(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.rb").write_text("x")
    (tmp_path / "src" / "b.rb").write_text("# Code generated by y")
    (tmp_path / "big.rb").write_text("z" * 100)
    rows = {r.rel: r.drop_reason for r in files.scan(spark, str(tmp_path), 50).collect()}
    assert rows == {"src/a.rb": None, "src/b.rb": "generated", "big.rb": "oversize"}


def test_encoded(spark):
    """Marks of structure go, a mark within a line stays; long texts are cut between characters as a reader counts them."""
    flag = "e\u0301"
    rows = [("ﬁ  `x`\n#y",), (None,), ("## 1. > policy",), ("a --- b | c <!-- d",), ("====",), (flag * 250,), ("\u202ea\u200bb",)]
    found = [r.t for r in spark.createDataFrame(rows, "t string").select(text.encoded("t").alias("t")).collect()]
    assert found == ["fi x #y", "", "policy", "a b c d", "", "é" * 200 + "…", "a b"]
    paths = spark.createDataFrame([("src/a.js",), ("src/а.js",), ('a"b',), (None,)], "t string").select(text.encoded_path("t").alias("t")).collect()
    assert [r.t for r in paths] == ['"src/a.js"', '"<path with mixed scripts, 8 chars>"', '"a\\"b"', '""']


@pytest.mark.parametrize(("dir_", "specifier", "path"), [("a/b", "./c", "a/b/c"), ("a/b", "../c?x#y", "a/c"), ("a", "../../c", None), (".", "./c", "c"), ("a", "c", None), ("a", "..", ""), ("a/b", "./../b/./d", "a/b/d")])
def test_imported_path(spark, dir_, specifier, path):
    assert one(spark, paths.imported_path(F.lit(dir_), F.lit(specifier))) == path
