from pyspark.sql import functions as F

from plumbline.sources import records, snapshots


def test_facts_come_back_and_newer_ones_are_counted(spark, tmp_path):
    slots = spark.createDataFrame([("a", "k", "claim", 10, 9, None, 5), ("a", "j", None, 3, 1, "x", 5), ("b", "k", None, 1, 1, None, 2)], "area string, key string, states string, candidates long, conforming long, learned string, area_files long")
    records.write_facts(slots, f"{tmp_path}/facts")
    (tmp_path / "facts" / "extra.json").write_text('{"schema": 99, "area": "z"}\nnot json\n{"schema": 1, "area": "old"}\n')
    rows, counts = records.read_facts(spark, f"{tmp_path}/facts")
    assert {r.area: None if r.dimensions is None else [d["key"] for d in r.dimensions] for r in rows.collect()} == {"a": ["j", "k"], "b": ["k"], "old": None}
    assert tuple(counts.first()) == (3, 2)


def test_events_of_logs(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "s.jsonl").write_text('{"type": "delivery", "session": "s", "uuid": 1, "path": "p"}\n{"type": "other"}\n{"type": "compact", "session": "s", "uuid": 2}\n{"type": "delivery", broken\n')
    (tmp_path / "x" / "s.txt").write_text('{"type": "delivery"}')
    found = records.events(spark, str(tmp_path)).orderBy("ord").collect()
    assert [(r.ord, r.kind, r.path, r.scoped) for r in found] == [(1, "delivery", "p", False), (2, "compact", None, False)]


def test_write_plan_touches_our_own_files_only(spark):
    planned = spark.createDataFrame([("new", "1"), ("same", "1"), ("changed", "2"), ("theirs", "1")], "path string, text string")
    existing = spark.createDataFrame([("same", "1", True), ("changed", "1", True), ("theirs", "0", False), ("gone", "1", True), ("foreign", "1", False)], "path string, text string, owned boolean")
    plan = lambda blind: {r.path: r.action for r in records.write_plan(planned, existing, F.lit(blind)).collect()}
    assert plan(False) == {"new": "create", "same": "keep", "changed": "update", "theirs": "keep", "gone": "remove", "foreign": "keep"}
    assert set(plan(True).values()) == {"keep"} and "new" not in plan(True)


def test_renames_pair_equal_contents_in_order(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "2"), ("d", "3")], "rel string, hash string")
    new = spark.createDataFrame([("x", "1"), ("c", "9"), ("d", "3"), ("y", "5")], "rel string, hash string")
    assert {tuple(r) for r in snapshots.changes(old, new).collect()} == {("R", "a", "x"), ("D", "b", None), ("M", "c", "c"), ("A", None, "y")}


def test_reports(spark):
    found = spark.createDataFrame([("MUST-FIX", "a.rb", 3, "m")], "severity string, path string, line long, message string")
    row = found.select(*[snapshots.reported(found, f).alias(f) for f in ("text", "json", "github")]).first()
    assert tuple(row) == ("MUST-FIX a.rb:3 m", '{"severity":"MUST-FIX","path":"a.rb","line":3,"message":"m"}', "::error file=a.rb,line=3::m")
