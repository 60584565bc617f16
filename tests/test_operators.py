from pyspark.sql import functions as F

from plumbline.operators import baseline, check, companions, gates, hierarchy, layout, nodes, ordering, slots


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def slot(spark, **changes):
    base = dict(candidates=100, conforming=100, squares=400, top_candidates=2, top_conforming=2, applicability=50, lang_files=60, area_files=60, authors=3, repo_authors=5, dirs=3, area_dirs=3, rest_candidates=0, rest_conforming=0, has_counter=True)
    return spark.createDataFrame([tuple((base | changes).values())], ", ".join(f"{k} {'boolean' if k == 'has_counter' else 'long'}" for k in base))


def gate(spark, **changes):
    return gates.judged(slot(spark, **changes)).first()


def test_each_gate_is_the_first_to_fail(spark):
    assert gate(spark).states == "claim"
    assert gate(spark, conforming=89).failed == "ratio"
    assert gate(spark, candidates=34, conforming=34, squares=34).failed == "evidence"
    assert gate(spark, squares=5000).failed == "concentration"
    assert gate(spark, applicability=14).failed == "applicability"
    assert gate(spark, authors=1).failed == "authors"
    assert gate(spark, dirs=1).failed == "directories"
    assert gate(spark, dirs=1, area_dirs=1).failed is None
    assert gate(spark, candidates=0, conforming=0, squares=0, top_candidates=0, top_conforming=0).failed == "ratio"


def test_borrowing_and_counter_side(spark):
    lent = gate(spark, candidates=30, conforming=30, squares=30, rest_candidates=1000, rest_conforming=990)
    assert lent.states == "claim" and lent.borrowed
    inverse = gate(spark, conforming=0, top_conforming=0)
    assert inverse.states == "counter"
    assert gate(spark, conforming=0, top_conforming=0, has_counter=False).states is None


def test_both_sides_never_state(spark):
    both = slot(spark).drop("conforming").crossJoin(spark.range(101).withColumnRenamed("id", "conforming"))
    assert gates.judged(both).where("failed IS NULL AND counter_failed IS NULL").count() == 0


def test_a_tied_vote_learns_nothing(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "x", 1), ("b", None, 2), ("c", "x", 1), ("c", "x", 1), ("c", "y", 2)], "area string, class string, grp long")
    assert [(r.area, r.learned) for r in slots.learned(df, ["area"]).orderBy("area").collect()] == [("a", None), ("b", "x"), ("c", "x")]
    assert [(r.area, r.learned) for r in slots.learned(df, ["area"], group="grp").orderBy("area").collect()] == [("a", None), ("b", "x"), ("c", None)]


def test_largest_file_is_the_least_of_equals(spark):
    df = spark.createDataFrame([("a", "k", "f2", 3, 1), ("a", "k", "f1", 3, 2), ("a", "k", "f3", 1, 1)], "area string, key string, rel string, candidates long, conforming long")
    top = slots.slot_counts(df).first()
    assert (top.top_candidates, top.top_conforming, top.squares) == (3, 2, 19)


def test_owner_is_separator_aware(spark):
    paths = spark.createDataFrame([("a/b/c",), ("ab",), ("a/bc",)], "path string")
    areas = spark.createDataFrame([("a",), ("a/b",)], "area string")
    assert rows(hierarchy.deepest(paths, areas), "path", "owner") == [("a/b/c", "a/b"), ("a/bc", "a"), ("ab", None)]


def test_fold_makes_parents_but_never_the_root():
    assert hierarchy.fold([("s/a", 2), ("s/b", 3), ("t", 9)], 2) == ([("s", 5), ("t", 9)], 0)
    assert hierarchy.fold([("a", 1), ("b", 2)], 1) == ([("b", 2)], 1)
    assert hierarchy.fold([("s/[id]/a", 1), ("s/[id]/b", 2), ("t", 9)], 2) == ([("s", 3), ("t", 9)], 0)  # no glob spells s/[id]


def test_layout_roots_open_shells_and_wrappers(spark):
    """A shell's own files are a line of their own, a wrapper is its child, and a shell with nothing tall in it is a root."""
    dirs = {".": 2, "src": 4, "src/core": 9, "src/tiny": 1, "wrap/only": 10, "lib/a": 2, "lib/b": 2, "doc": 5}
    files = spark.createDataFrame([(d, None if d == "doc" else "js") for d, n in dirs.items() for _ in range(n)], "dir string, lang string")
    found, more = layout.roots(files, budget=4)
    assert [(r.path, r.files, r.source) for r in found.orderBy("rank").collect()] == [("wrap/only", 10, 10), ("src/core", 9, 9), ("lib", 4, 4), ("src (files at this level)", 4, 4)]
    assert [tuple(r) for r in more.collect()] == [(1, 8)]  # doc, and three files below the floor
    flat, _ = layout.roots(spark.createDataFrame([(".", "js")] * 5, "dir string, lang string"))
    assert [(r.path, r.files) for r in flat.collect()] == [(".", 5)]


def test_a_test_is_told_by_code_first_then_by_name_and_place(spark):
    paths = [("a/x.test.js", None, False, False, True), ("a/x.test.js", None, False, True, False), ("a/x.js", "jest", False, True, True), ("a/login-test.js", None, False, False, True), ("test/lib/rules/v.js", None, False, False, True), ("lib/rules/v.js", None, False, False, False), ("test/v.js", None, False, False, False), ("a/__tests__/u.js", None, False, False, True), ("spec/support/h_spec.rb", None, False, False, True), ("spec/support/h.rb", None, False, False, False)]
    df = spark.createDataFrame([(i, p, "js", r, c, e) for i, (p, r, c, e, _) in enumerate(paths)], "id int, path string, lang string, runner string, test_calls boolean, empty boolean")
    assert [r.is_test for r in layout.test_files(df).orderBy("id").collect()] == [x[-1] for x in paths]


def test_many_renames_of_one_path(spark):
    """A path that is renamed back and forth, thousands of times, and chains of up to 64 hops."""
    moves = spark.range(4000).selectExpr("id AS seq", "concat('p', id % 2) AS old", "concat('p', (id + 1) % 2) AS new")
    found = {r.seq: (r.name, r.hops) for r in baseline.resolved(moves).collect()}
    assert len(found) == 4000 and found[3999] == ("p0", 1) and found[0] == ("p0", 64) and found[3999 - 9] == ("p0", 10)


def test_the_next_of_a_kind_is_in_the_own_or_a_later_bucket(spark):
    import random

    rng = random.Random(2)
    mine, theirs = ([(rng.choice("ab"), rng.randrange(500)) for _ in range(300)] for _ in range(2))
    df = lambda x: spark.createDataFrame(x, "k string, at long")
    got = sorted(((r.k, r.at, r.nxt) for r in ordering.next_after(df(mine), df(theirs), "k", "at", "nxt").collect()), key=str)
    assert got == sorted(((k, at, min((b for j, b in theirs if j == k and b > at), default=None)) for k, at in mine), key=str)
    assert ordering.next_after(df([]), df(theirs), "k", "at", "nxt").count() == 0
    assert [r["rank"] for r in ordering.numbered(df(mine).distinct(), ["k", "at"]).orderBy("k", "at").collect()] == list(range(1, len(set(mine)) + 1))


def test_rename_chain_keeps_a_reused_path_apart(spark):
    moves = spark.createDataFrame([(1, "a", "b"), (2, "b", "c"), (3, "a", "d"), (4, "x", "x")], "seq long, old string, new string")
    assert rows(baseline.resolved(moves), "seq", "path", "name", "hops") == [(1, "a", "c", 2), (2, "b", "c", 1), (3, "a", "d", 1)]


def test_multiset_difference_keeps_rows(spark):
    head = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x"), (4, "y")], "id long, fp string")
    base = spark.createDataFrame([("x",), ("z",)], "fp string")
    assert rows(check.introduced(head, base, "fp", ["id"]), "id", "fp") == [(2, "x"), (3, "x"), (4, "y")]


def test_added_lines_at_range_ends(spark):
    found = spark.createDataFrame([("p", 10), ("p", 200), ("p", 201), ("q", 10)], "path string, line long")
    ranges = spark.createDataFrame([("p", 10, 200), ("p", 5, 12), ("q", 11, 9)], "path string, low long, high long")
    assert rows(check.on_added_lines(found, ranges), "path", "line") == [("p", 10), ("p", 200)]


def test_imports_to_ambiguous_tails_have_no_target(spark):
    paths = spark.createDataFrame([("a/x.js",), ("b/x.js",), ("b/y.js",)], "path string")
    imports = spark.createDataFrame([("m", "x.js"), ("m", "y.js"), ("m", "b/x.js"), ("m", "z.js")], "importer string, specifier string")
    assert {(r.specifier, r.target) for r in companions.resolved_imports(imports, paths).collect()} == {("x.js", None), ("y.js", "b/y.js"), ("b/x.js", "b/x.js"), ("z.js", None)}


def test_nodes_within_nodes(spark):
    html = spark.createDataFrame([(1, "<ul><li><b><a href=x>1</a></b></li><li>2</li></ul><a>3</a>"), (2, None)], "rel long, content string")
    found = nodes.holding(nodes.extract(html), "li", "a")
    assert [r.conforming for r in found.orderBy("pre").collect()] == [True, False]


def test_severity_order_and_cap(spark):
    names = "key string, states string, dropped boolean, stale boolean, has_base boolean, precision string, listed boolean, pinned boolean, borrowed boolean, bound double, conforming long, candidates long"
    good = ("k", "claim", False, False, True, "precise", False, True, False, 0.95, 10, 10)
    df = spark.createDataFrame([good, (None, *good[1:]), (*good[:2], True, *good[3:]), (*good[:10], 9, 10)], names)
    assert [r.severity for r in gates.severity(df).collect()] == ["MUST-FIX", "NIT", "FIX", "FIX"]
    assert [r.severity for r in gates.severity(df, F.lit(True)).collect()] == ["FIX", "NIT", "FIX", "FIX"]


def test_a_collation_orders_paths_as_a_locale_does(spark):
    from plumbline.operators import check

    paths = ["Zoo.js", "apple.js", "Ápple.js", "Apple.js", "zoo.js", "b.js", "æ.js"]
    df = spark.createDataFrame([("FIX", p, i) for i, p in enumerate(paths)], "severity string, path string, line int")
    by = lambda **o: [r.path for r in check.ordered(df, **o).orderBy("rank").collect()]
    assert by() == sorted(paths)
    assert by(collation="UNICODE") == ["æ.js", "apple.js", "Apple.js", "Ápple.js", "b.js", "zoo.js", "Zoo.js"]


def test_configurations_are_followed_within_their_root(spark):
    from plumbline.operators import config

    rows = [("a", "tsconfig.json", "./base"), ("a", "base.json", "./lib/x.json"), ("a", "lib/x.json", None), ("b", "tsconfig.json", "../up.json"), ("c", "tsconfig.json", "./lib/y"), ("c", "lib/y.json", "../tsconfig.json"), ("d", "tsconfig.json", "./gone.json"), ("e", "other.json", None), ("f", "tsconfig.json", "/etc/x.json")]
    df = spark.createDataFrame(rows, "root string, path string, extends string")
    roots = df.select("root").union(spark.createDataFrame([("g",)], "root string"))
    got = {r.root: r.reason for r in config.used(df, roots).collect()}
    assert got == {"a": None, "b": "extends-escaped", "c": "config-errors", "d": "config-errors", "e": "no-config", "f": "extends-escaped", "g": "no-config"}
    ends = {(r.root, r.path): (r.last, r.hops, r.status) for r in config.resolved(df).collect()}
    assert ends["a", "tsconfig.json"] == ("lib/x.json", 2, "ok") and ends["c", "tsconfig.json"] == ("tsconfig.json", 2, "cycle") and ends["d", "tsconfig.json"] == ("gone.json", 1, "missing")
    assert config.resolved(df.limit(0)).count() == 0
