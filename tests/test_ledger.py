"""Records of what was read: outcomes, attempts, reuse, and what the engine makes of files that could not be read."""

import os
import signal

import pytest
from pyspark.sql import functions as F

from plumbline.api import Engine, write_map
from plumbline.operators import tallies
from plumbline.plans import verdict_queries
from plumbline.registry import DIMENSIONS
from plumbline.sources import facets, ledger, lexical

SCHEMA = "rel string, lang string, stripped boolean, content string"
SWALLOWED = tuple(d for d in DIMENSIONS if d.key == "swallowed_error")


def reader():
    def read(rel, lang, text, attempt):
        if text == "ends" or (text == "ends once" and attempt == 1):
            os.kill(os.getpid(), signal.SIGKILL)
        if text == "odd":
            raise ValueError(text)
        return "ok", [{"pre": 0, "post": 0, "depth": 0, "type": text[:9], "name": None, "above": [], "fn": None, "cls": None, "line": 1, "attrs": [("a", "1")]}]

    return read  # pickled by value: workers do not know this module


read = reader()


def outcomes(df):
    return {r.rel: (r.kind, r.attempts, len(r.nodes or [])) for r in df.collect()}


def files(spark, rows):
    return spark.createDataFrame([(f"f{i}", "js", t) for i, t in enumerate(rows)], "rel string, lang string, content string")


def test_each_file_has_one_outcome(spark):
    there = files(spark, ["fine", "ends", "odd", None, "x" * 50, "ends once", "fine too", ""])
    book = ledger.Ledger(spark, max_bytes=20)
    want = {"f0": ("ok", 1, 1), "f1": ("crashed", 2, 0), "f2": ("rejected", 1, 0), "f3": ("unreadable", 0, 0), "f4": ("oversize", 0, 0), "f5": ("ok", 2, 1), "f6": ("ok", 1, 1), "f7": ("ok", 1, 1)}
    records = book.settle(there, ledger.reading(read, isolated=True))
    assert outcomes(records) == want
    assert sorted((r.rel, r.type, r.attrs["a"]) for r in ledger.nodes(records).collect()) == [("f0", "fine", "1"), ("f5", "ends once", "1"), ("f6", "fine too", "1"), ("f7", "", "1")]
    assert sorted(map(tuple, tallies.unexamined(records).collect())) == [("crashed", 1), ("oversize", 1), ("rejected", 1), ("unreadable", 1)]
    assert outcomes(ledger.Ledger(spark).settle(there.limit(0), ledger.reading(read))) == {}


def test_a_measure_may_leave_files_out(spark):
    there = files(spark, ["a", "b", "c"])
    seen = []

    def some(todo):
        seen.append(sorted((r.rel, r.attempt) for r in todo.collect()))
        return ledger.reading(read)(todo.where("rel <> 'f1'"))

    assert outcomes(ledger.Ledger(spark).settle(there, some)) == {"f0": ("ok", 1, 1), "f1": ("crashed", 2, 0), "f2": ("ok", 1, 1)}
    assert seen == [[("f0", 1), ("f1", 1), ("f2", 1)], [("f1", 2)]]


def test_only_new_content_is_read(spark, tmp_path):
    asked = []

    def measure(todo):
        asked.append(sorted(r.rel for r in todo.select("rel").collect()))
        return ledger.reading(read)(todo)

    one, two = files(spark, ["a", "b", "odd"]), files(spark, ["a", "new", "odd", "more"])
    for there, again in ((one, ["f0", "f1", "f2"]), (one, None), (two, ["f1", "f3"]), (one, None)):
        asked.clear()
        got = outcomes(ledger.Ledger(spark, f"{tmp_path}/book").settle(there, measure))
        assert len(got) == there.count() and asked == ([again] if again else [])
    ledger.Ledger(spark, f"{tmp_path}/book", version="2").settle(one, measure)
    assert asked == [["f0", "f1", "f2"]]  # another reader answers anew


def test_a_stream_of_files_is_settled_once(spark, tmp_path):
    for i, there in enumerate((files(spark, ["a", "b"]), files(spark, ["a", "c"]))):
        there.coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(files(spark, []).schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    book = ledger.Ledger(spark, f"{tmp_path}/book")
    assert book.follow(stream, ledger.reading(read), f"{tmp_path}/state").awaitTermination(120)
    assert sorted((r.rel, r.kind) for r in book.rows().where("kind IS NOT NULL").collect()) == [("f0", "ok"), ("f1", "ok"), ("f1", "ok")]


CODE = "try { run(); } catch (e) { report(e); }"


def tree(spark, good, bad, odd=0):
    rows = [(f"src/a/f{i}.js", "js", False, CODE) for i in range(good)] + [(f"src/a/g{i}.js", "js", False, None) for i in range(bad)] + [(f"src/a/h{i}.js", "js", False, "x" * 2_000_000) for i in range(odd)]
    return spark.createDataFrame(rows, SCHEMA)


def test_unread_files_are_in_no_denominator(spark):
    found = Engine(spark, SWALLOWED).scan(tree(spark, 10, 30, 2), frameworks=())
    assert [(r.lang_files, r.applicability, r.area_files) for r in found.slots.collect()] == [(10, 10, 42)]
    assert sorted(map(tuple, tallies.unexamined(found.records).collect())) == [("oversize", 2), ("unreadable", 30)]


def test_an_unread_producer_owes_nothing(spark):
    rows = [(f"app/models/m{i}.rb", "ruby", False, "class M\nend" if i % 2 else None) for i in range(12)] + [(f"spec/models/m{i}_spec.rb", "ruby", False, None) for i in range(6)]
    engine = Engine(spark, tuple(d for d in DIMENSIONS if d.key == "model_spec"))
    sites = engine.sites(spark.createDataFrame(rows, SCHEMA), frameworks=("rails",))
    assert sorted((r.rel, r.conforming) for r in sites.collect()) == sorted((f"app/models/m{i}.rb", i < 6) for i in range(1, 12, 2))


def test_a_second_scan_reads_no_file_again(spark, tmp_path):
    asked = []

    def measure(todo):
        asked.append(todo.count())
        return ledger.reading(lexical.read)(todo)

    def scanned():
        return sorted(map(tuple, Engine(spark, SWALLOWED, ledger.Ledger(spark, f"{tmp_path}/book"), measure).scan(tree(spark, 9, 1), frameworks=()).slots.collect()))

    assert scanned() == scanned() and asked == [9]


def test_the_map_of_a_blind_run_is_left_alone(spark, tmp_path):
    engine = Engine(spark, SWALLOWED)
    names = write_map(engine.scan(tree(spark, 12, 1), frameworks=()), f"file://{tmp_path}/map")
    assert len(names) == 1
    before = (tmp_path / "map" / names[0]).read_text()
    assert write_map(engine.scan(tree(spark, 0, 12), frameworks=()), f"file://{tmp_path}/map") == names
    assert (tmp_path / "map" / names[0]).read_text() == before


@pytest.mark.parametrize(
    ("path", "text", "site"),
    [
        ("db/migrate/1.rb", 'class A < ActiveRecord::Migration[7.0]\n  def change\n    execute "UPDATE pets SET a = %s"\n  end\nend' % ("1" * 3000), ("Call", "execute", {"rows": "1"})),
        ("a.js", "import logger from './lib/logger';\nlogger." + ".".join(f"member{i}" for i in range(60)) + ".info('a');", ("CallExpression", "info", {"wrapper": "logging"})),
        ("a.js", "import logger from './lib/logger';\nlogger." + "m" * 3000 + ".info('a');", ("CallExpression", "info", {"wrapper": "logging"})),
    ],
)
def test_long_statements_are_read_whole(path, text, site):
    nodes = lexical.read(path, "ruby" if path.endswith("rb") else "js", text)[1]
    assert any((n["type"], n["name"]) == site[:2] and site[2].items() <= dict(n["attrs"]).items() for n in nodes)


def test_few_splits_are_read_by_many_tasks_in_pieces(spark):
    """Small files of one split are dealt to tasks, and a worker holds a piece of a batch at a time."""
    import pyarrow as pa

    there = spark.range(3 * ledger.FILES).coalesce(1).selectExpr("concat('f', id) AS rel", "'js' AS lang", "'a' AS content")
    seen = []

    def measure(todo):
        seen.append(todo.rdd.getNumPartitions())
        return ledger.reading(read)(todo)

    assert ledger.Ledger(spark).settle(there, measure).where("kind = 'ok'").count() == 3 * ledger.FILES
    assert seen[0] >= spark.sparkContext.defaultParallelism
    assert facets.extract(there).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    texts = ["x" * ledger.TEXT * 2, None, *["y" * (ledger.TEXT // 4)] * 8, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["content"])
    parts = [p.column(0).to_pylist() for p in ledger.pieces(batch)]
    assert [x for p in parts for x in p] == texts and [len(p) for p in parts] == [1, 4, 3, 3]


def test_a_check_reads_a_file_of_both_snapshots_once(spark, small, monkeypatch):
    """`engine_check` reads its base, and of the head what differs."""
    asked, reading = [], ledger.reading

    def counted(read):
        def measure(todo):
            asked.append(todo.count())
            return reading(read)(todo)

        return measure

    monkeypatch.setattr(ledger, "reading", counted)
    assert verdict_queries.engine_check(spark, small).count()
    customers = spark.read.parquet(f"{small}/customer.parquet")
    differ = customers.where(f"NOT ({verdict_queries._BAD_BASE}) AND ({verdict_queries._BAD_HEAD})").count()
    assert 0 < differ and sum(asked) == customers.count() + differ
