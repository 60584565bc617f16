"""A listing of a tree as a data source: NUL-terminated records, read in splits, filtered as they are read.

A record is `<hash> <bytes>\\t<path>`; paths may hold any other character, line ends too. Files of a listing are cut into
splits of `split_bytes`; a record belongs to the split that its first byte lies in. Filters on the columns are applied
while reading, and where a listing's files are sorted by path a split is left as soon as no further path can pass. A
record beyond `max_record` bytes, or a file that ends within one, is an error: part of an answer is not the answer.

    listing.register(spark)
    spark.read.format("plumbline_listing").option("path", root).option("sorted", "true").load().where("rel LIKE 'lib/%'")
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringStartsWith

NAME = "plumbline_listing"
SCHEMA = "rel string, hash string, bytes long"
SPLIT_BYTES = 32 << 20
MAX_RECORD = 1 << 16
_CHUNK = 1 << 20
_ROWS = 10_000
_ARROW = pa.schema([("rel", pa.string()), ("hash", pa.string()), ("bytes", pa.int64())])


def at(path: str) -> tuple[FileSystem, str]:
    """The file system and path of a URI or a plain local path."""
    return FileSystem.from_uri(path) if ":" in path.split("/", 1)[0] else FileSystem.from_uri(f"file://{path}")


@dataclass
class Split(InputPartition):
    path: str
    start: int
    end: int


def records(chunks: Callable[[int], bytes], skip: bool, room: int, max_record: int) -> Iterator[bytes]:
    """Records that begin within the first `room` bytes of a stream; with `skip`, the first is the tail of one before it."""
    rest, begins = b"", 0  # `begins`: the place of `rest` in the stream
    while begins < room:
        chunk = chunks(_CHUNK)
        if not chunk:
            if rest:
                raise ValueError("the listing ends within a record")
            return
        *whole, rest = (rest + chunk).split(b"\0")
        for record in whole:
            if len(record) > max_record:
                raise ValueError(f"a record is longer than {max_record} bytes")
            if begins >= room:
                return
            begins += len(record) + 1
            if skip:
                skip = False
            else:
                yield record
        if len(rest) > max_record:
            raise ValueError(f"a record is longer than {max_record} bytes")


class ListingReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.split_bytes = int(options.get("split_bytes", SPLIT_BYTES))
        self.max_record = int(options.get("max_record", MAX_RECORD))
        self.sorted = options.get("sorted", "false").lower() == "true"
        self.filters: list[tuple[str, str, object]] = []

    _PUSHED = {EqualTo: "eq", In: "in", StringStartsWith: "prefix", LessThan: "lt", LessThanOrEqual: "le", GreaterThan: "gt", GreaterThanOrEqual: "ge"}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Take comparisons of a column with a constant; Spark applies all others."""
        for f in filters:
            if type(f) in self._PUSHED and len(f.attribute) == 1 and f.value is not None:
                self.filters.append((f.attribute[0], self._PUSHED[type(f)], f.value))
            else:
                yield f

    def partitions(self) -> list[Split]:
        store, root = at(self.path)
        info = store.get_file_info(root)
        files = [info] if info.type == FileType.File else store.get_file_info(FileSelector(root, recursive=True))
        plain = sorted((f.path, f.size) for f in files if f.type == FileType.File and f.base_name[0] not in "._")
        cut = [Split(path, a, min(a + self.split_bytes, size)) for path, size in plain for a in range(0, size, self.split_bytes)]
        return cut or [Split("", 0, 0)]

    def _passes(self, row: dict) -> bool:
        tests = {"eq": lambda a, b: a == b, "in": lambda a, b: a in b, "prefix": lambda a, b: a.startswith(b), "lt": lambda a, b: a < b, "le": lambda a, b: a <= b, "gt": lambda a, b: a > b, "ge": lambda a, b: a >= b}
        code = lambda v: v.encode() if isinstance(v, str) else tuple(map(code, v)) if isinstance(v, (tuple, list)) else v
        return all(tests[how](code(row[column]), code(value)) for column, how, value in self.filters)

    def _past(self, rel: str) -> bool:
        """Whether neither this path nor one behind it in order can pass."""
        mine = rel.encode()
        for column, how, value in self.filters:
            if column == "rel":
                last = max(v.encode() for v in value) if how == "in" else value.encode()
                if how in ("eq", "in", "le") and mine > last or how == "lt" and mine >= last or how == "prefix" and mine > last and not mine.startswith(last):
                    return True
        return False

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        store, _ = at(self.path)
        with store.open_input_file(partition.path) as file:
            back = 1 if partition.start else 0
            file.seek(partition.start - back)
            rows: list[tuple] = []
            for record in records(file.read, bool(back), partition.end - partition.start + back, self.max_record):
                head, _, rel = record.decode().partition("\t")
                hash_, _, size = head.partition(" ")
                row = {"rel": rel, "hash": hash_, "bytes": int(size)}
                if self.sorted and self._past(rel):
                    break
                if self._passes(row):
                    rows.append(tuple(row.values()))
                if len(rows) == _ROWS:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


class Listing(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> ListingReader:
        return ListingReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the source known to a session, and let it take filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Listing)


def write(files: DataFrame, root: str) -> None:
    """Write files (rel, hash, bytes) as a listing, each of its files in order of path."""
    record = F.concat("hash", F.lit(" "), F.col("bytes").cast("string"), F.lit("\t"), "rel")
    files.sortWithinPartitions("rel").select(record.alias("value")).write.option("lineSep", "\0").text(root)
