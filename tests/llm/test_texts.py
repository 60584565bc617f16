import collections
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.llm import language, license_scan, quality_model, quality_rules
from plumbline.llm.words import words_of

WORD = r"[^\x20\x09-\x0D]+"


def frame(spark, texts, **more):
    rows = [(i, t, "x", 1.0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, kept string, score double")


def test_words_are_those_of_the_pattern():
    texts = [None, "", "  a b\n", "a b", "x\x0by\x0cz\t", "é　ü"]
    w = words_of(pa.array(texts))
    found = [w.distinct.take(pa.array(w.codes[a:b])).to_pylist() for a, b in zip(w.offsets[:-1], w.offsets[1:], strict=True)]
    assert found == [re.findall(WORD, t or "") for t in texts]


def brute_rules(text):
    words = re.findall(WORD, text)
    at = collections.defaultdict(list)
    for i in range(len(words) - 7):
        at[tuple(words[i : i + 8])].append(i)
    repeat = len({i + j for found in at.values() if len(found) > 1 for i in found for j in range(8)})
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    failed = len(words) < 20 or 100 * repeat > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), repeat, failed


def test_base_measures(spark, small):
    texts = [None, "", "a " * 30, " ".join(map(str, range(30))), "x\nx\n \n \nx", "é# ü|", ("a b c d e f g h " * 2 + "z ") * 2, "𝔘 " * 21] + [r.text for r in spark.read.parquet(f"{small}/documents.parquet").limit(150).collect()]
    out = {r.doc_id: r for r in quality_rules.measure(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        r = out[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_rules(t or "")
        assert not (r.base_failed and r.kept)


@pytest.mark.parametrize(("line", "rule"), [("Home | News | About | Contact", "navigation"), ("to%%% be*** or&&& not###", "symbols"), ("BUY!! THIS!! NOW!! CHEAP!!", "shouting"), ("Read our cookie policy here.", "boilerplate"), ("Chapter one", "fragment"), ("spam " * 12 + ".", "stutter"), ("An ordinary line, with enough words.", "")])
def test_line_rules(line, rule):
    assert quality_rules.line_rule(line.encode()) == rule


def test_cleaning_removes_lines_and_documents(spark):
    good = "These are twenty different words that make one honest line of plain prose so that nothing at all is lost here."
    docs = frame(spark, [good + "\nHome | News | About | Contact", "BUY!! THIS!! NOW!! CHEAP!!\n" * 9, None])
    out = quality_rules.clean(docs).collect()
    assert [(r.doc_id, r.text, r.kept) for r in out] == [(0, good, "x")]


def test_classifier_held_out(spark, small):
    out = quality_model.op5_quality(spark, small)
    labels = spark.read.parquet(f"{small}/labels.parquet")
    both = out.join(labels, "doc_id").where("held_out").agg(F.avg((F.col("predicted") == F.col("quality")).cast("double")), F.count("*")).first()
    assert both[0] >= 0.97 and both[1] > 50
    assert out.where("score < 0 OR score > 1 OR score IS NULL").count() == 0 and out.count() == spark.read.parquet(f"{small}/documents.parquet").count()


def test_dual_coordinate_descent_reaches_the_optimum():
    random = np.random.default_rng(1)
    rows = [np.unique(random.choice(np.arange(60) + 40 * (i % 2), 12)).astype(np.int32) for i in range(80)]
    y = np.array([i % 2 for i in range(80)])
    model = quality_model.fit(rows, y, epochs=200)
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    score = model.scores(np.concatenate(rows), offsets)
    assert ((score >= 0.5) == (y == 1)).mean() >= 0.95
    more = quality_model.fit(rows, y, epochs=400)
    assert np.allclose(model.weights, more.weights, atol=1e-3)  # nothing is left to gain


def test_classifier_edges(spark):
    labels = spark.createDataFrame([(0, 1), (2, None), (None, 0)], "doc_id long, quality int")
    docs = frame(spark, ["a b", None, ""])
    model = quality_model.train(docs, labels)
    out = quality_model.scored(docs.withColumnRenamed("score", "_s"), model).collect()
    assert len(out) == 3 and all(r.score > 0.5 and r.kept == "x" for r in out)
    nothing = quality_model.train(docs.limit(0), labels.limit(0))
    assert {r.score for r in quality_model.scored(docs.drop("score"), nothing).collect()} == {0.5}


def test_language_held_out(spark, small):
    out = language.op8_language(spark, small)
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "lang")
    right = out.join(docs, "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right >= 0.97


def brute_grams(text):
    padded = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
    found = collections.Counter()
    for n in (1, 2, 3):
        for i in range(len(padded) - n + 1):
            g = padded[i : i + n]
            if not g.isspace() and not (n == 3 and g[1] == " "):
                found[g] += 1
    return found


def decoded(gram):
    out = ""
    while gram:
        out = chr(gram & 0x1FFFFF) + out
        gram >>= 21
    return out


@pytest.mark.parametrize("text", ["Ab ab", " ab  ", "a1b", "é", "12 .", "", "abc def\nghi", "日本 語", "x"])
def test_n_grams(text, monkeypatch):
    want = brute_grams(text) if any(c.isalpha() for c in text) else {}
    for block in (2_000_000, 3):
        monkeypatch.setattr(language, "BLOCK", block)
        grams, counts = language.n_grams(text)
        assert {decoded(int(g)): n for g, n in zip(grams, counts, strict=True)} == want


def test_language_edges(spark):
    texts = ["the cat and the dog and the bird " * 3] * 6 + ["der hund und die katze und der vogel " * 3] * 6
    known = spark.createDataFrame([(i, t, "en" if i < 6 else "de") for i, t in enumerate(texts)] + [(50, None, "en"), (51, "x", None), (None, "y", "fr")], "doc_id long, text string, lang string")
    profiles = language.train(known)
    out = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(frame(spark, [None, "", "12 !", "the dog and the cat", "und der hund " * 5000]), profiles).collect()}
    assert [out[i] for i in (0, 1, 2)] == [("und", 0.0)] * 3 and out[3][0] == "en" and out[4][0] == "de" and 0 < out[4][1] <= 1
    nothing = language.train(known.limit(0))
    assert {r.lang_pred for r in language.identify(known, nothing).collect()} == {"und"}


def test_alignment_is_a_common_subsequence():
    random = np.random.default_rng(2)
    for _ in range(200):
        a, b = (random.integers(0, 12, random.integers(0, 25)).tolist() for _ in range(2))
        found = license_scan.align(a, b)
        assert all(a[i] == b[j] for i, j in found) and all(i < k and j < m for (i, j), (k, m) in zip(found, found[1:], strict=False))
    same = list(range(30))
    assert license_scan.align(same, same) == [(i, i) for i in same]


def test_increasing_is_longest():
    assert [3, 1, 2, 5, 4][license_scan.increasing([3, 1, 2, 5, 4])[0]] == 1 and len(license_scan.increasing([3, 1, 2, 5, 4])) == 3


def test_license_scan(spark):
    mit = license_scan.TEMPLATES["mit-permission"]
    texts = [None, "", "Licensed under CC BY-NC 4.0.", "intro words\n" + mit.replace(", merge", "").upper() + "\nand more", "Released the cat under a tree with a License from MIT once", "x " * 5000 + "Released under the MIT License. y Released under the MIT License."]
    out = {r.doc_id: [(m.name, m.start, m.end) for m in r.matches] for r in license_scan.find(frame(spark, texts)).collect()}
    assert out[0] == out[1] == out[4] == [] and out[2] == [("cc-by-nc-4.0", 0, 5)]
    assert [m[0] for m in out[3]] == ["mit-permission"] and out[3][0][1] == 2
    assert out[5] == [("mit", 5000, 5005), ("mit", 5006, 5011)]
    assert license_scan.find(frame(spark, [])).count() == 0


def test_copies_of_a_notice_in_a_row_are_each_found():
    notice = license_scan.Scanner(license_scan.TEMPLATES).templates["mit"]
    for copies in (1, 2, 4, 9):
        words = ["before"] * 20 + notice * copies + ["after"] * 20
        found = license_scan.Scanner(license_scan.TEMPLATES).scan(words)
        assert [m[:3] for m in found] == [("mit", 20 + 5 * i, 25 + 5 * i) for i in range(copies)]


def test_copies_of_a_long_notice_with_a_word_changed_are_each_found():
    scanner = license_scan.Scanner(license_scan.TEMPLATES)
    notice = scanner.templates["mit-permission"]
    for gone in (3, len(notice) // 2, len(notice) - 3):
        copy = notice[:gone] + notice[gone + 1 :]
        found = scanner.scan(["before"] * 20 + copy * 3 + ["after"] * 20)
        assert [m[0] for m in found] == ["mit-permission"] * 3 and [m[1] for m in found] == [20 + len(copy) * i for i in range(3)]
