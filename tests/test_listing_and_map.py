"""Listings read in splits, and maps that are written whole or not at all."""

import pytest

from plumbline.sources import listing, map_sink


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("listing")
    (at / "part-0").write_bytes(b"".join(b"h%d %d\t%s\0" % (i, i, p.encode()) for i, p in enumerate(sorted(PATHS))))
    (at / "_SUCCESS").write_bytes(b"")
    listing.register(spark)
    return str(at)


PATHS = [f"{d}/some file\n{i}.js" for d in ("a", "é", "lib/x") for i in range(40)]


def rows(spark, root, **options):
    return spark.read.format(listing.NAME).options(path=root, **{k: str(v) for k, v in options.items()}).load()


@pytest.mark.parametrize("split", [1, 7, 64, 1 << 20])
def test_each_record_is_in_one_split(spark, root, split):
    reader = listing.ListingReader({"path": root, "split_bytes": str(split)})
    got = [r for s in reader.partitions() for b in reader.read(s) for r in b.to_pylist()]
    assert [r["rel"] for r in got] == sorted(PATHS) and [r["bytes"] for r in got] == list(range(len(PATHS)))


def test_filters_are_taken_and_end_a_sorted_listing_early(spark, root):
    there = rows(spark, root, split_bytes=200, sorted="true")
    assert there.count() == len(PATHS)
    wanted = there.where("rel LIKE 'lib/%' AND rel < 'lib/x/some file\n3' AND bytes >= 50")
    assert sorted(r.rel for r in wanted.collect()) == [p for i, p in enumerate(sorted(PATHS)) if p.startswith("lib/") and p < "lib/x/some file\n3" and i >= 50]
    plan = wanted._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan.replace("PushedFilters", "") or "StartsWith" not in plan.split("BatchScan")[0]
    reader = listing.ListingReader({"path": root, "sorted": "true"})
    reader.filters = [("rel", "eq", "a/some file\n1.js")]
    taken = []
    passes = reader._passes
    reader._passes = lambda row: taken.append(row["rel"]) or passes(row)
    assert [r["rel"] for b in reader.read(reader.partitions()[0]) for r in b.to_pylist()] == ["a/some file\n1.js"] and len(taken) < 5


def test_a_cut_or_endless_record_is_an_error(spark, tmp_path):
    (tmp_path / "cut").write_bytes(b"h 1\ta\0h 2\tb")
    (tmp_path / "long").write_bytes(b"h 1\t" + b"a" * 5000 + b"\0")
    for name, match in (("cut", "ends within"), ("long", "longer than 4096")):
        reader = listing.ListingReader({"path": str(tmp_path / name), "max_record": "4096"})
        with pytest.raises(ValueError, match=match):
            list(reader.read(reader.partitions()[0]))
    (tmp_path / "none").write_bytes(b"")
    assert rows(spark, str(tmp_path / "none")).count() == 0


def texts(spark, **named):
    return spark.createDataFrame([(f"{k}.md", v) for k, v in named.items()], "name string, text string")


def left(tmp_path):
    return {p.name: p.read_text() for p in (tmp_path / "map").iterdir() if p.suffix == ".md"}


def test_a_map_is_renewed_and_only_its_own_files_go(spark, tmp_path):
    root = f"{tmp_path}/map"
    assert map_sink.write(spark, texts(spark, overview="o", aaaaaaaa="1", bbbbbbbb="2"), root) == ["aaaaaaaa.md", "bbbbbbbb.md", "overview.md"]
    (tmp_path / "map" / "cccccccc.md").write_text("by hand")
    (tmp_path / "map" / "notes.md").write_text("by hand")
    kept = (tmp_path / "map" / "aaaaaaaa.md").stat().st_mtime_ns
    map_sink.write(spark, texts(spark, overview="o2", aaaaaaaa="1"), root)
    assert left(tmp_path) == {"overview.md": "o2", "aaaaaaaa.md": "1", "cccccccc.md": "by hand", "notes.md": "by hand"}
    assert (tmp_path / "map" / "aaaaaaaa.md").stat().st_mtime_ns == kept  # what is the same is not written again
    assert map_sink.write(spark, texts(spark), root, blind=True) == ["aaaaaaaa.md", "overview.md"] and len(left(tmp_path)) == 4
    assert map_sink.write(spark, texts(spark), root) == [] and set(left(tmp_path)) == {"cccccccc.md", "notes.md"}
    assert not [p for p in (tmp_path / "map").iterdir() if p.name.startswith(".drafts")]


@pytest.mark.parametrize("bad", [{"../out": "x"}, {"aaaaaaaa": "x", "eeeeeeee": "folder"}])
def test_an_aborted_write_leaves_the_map_whole(spark, tmp_path, bad):
    root = f"{tmp_path}/map"
    map_sink.write(spark, texts(spark, aaaaaaaa="1", bbbbbbbb="2"), root)
    (tmp_path / "map" / "eeeeeeee.md").mkdir()
    with pytest.raises(Exception, match="no name of the map's own|is a folder"):
        map_sink.write(spark, texts(spark, dddddddd="4", **bad), root)
    (tmp_path / "map" / "eeeeeeee.md").rmdir()
    assert left(tmp_path) == {"aaaaaaaa.md": "1", "bbbbbbbb.md": "2"}
    assert not [p for p in (tmp_path / "map").iterdir() if p.name.startswith(".drafts")]


def test_two_texts_of_one_name_are_refused(spark, tmp_path):
    twice = texts(spark, aaaaaaaa="1").unionByName(texts(spark, aaaaaaaa="2"))
    with pytest.raises(Exception, match="the same name"):
        map_sink.write(spark, twice, f"{tmp_path}/map")
    assert not left(tmp_path)


def test_records_of_a_stream_of_any_chunks():
    data = b"".join(b"%d\0" % i for i in range(300))
    for size in (1, 3, 1000):
        at = [0]

        def chunk(_, size=size, at=at):
            at[0] += size
            return data[at[0] - size : at[0]]

        assert list(listing.records(chunk, False, len(data), 10)) == data.split(b"\0")[:-1]

