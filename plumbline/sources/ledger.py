"""Parse records in a ledger of attempts: what was read of each file, with which outcome, after how many tries.

A ledger is a folder of append-only tables, keyed by path, content hash, language and the reader's version. Only files
whose key has no outcome yet are read, so a second run over an unchanged tree reads none. A pass writes what its files
answered; a file that gave no answer (its reader ended the process, or left it out) stays open for one more pass, and is
then recorded as `crashed` and never tried again. Reading is a DataFrame function that a caller may replace.
"""

from __future__ import annotations

import os
import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plumbline.operators.dimensions import NODES
from plumbline.tables import dealt, shared_path, stored

#: Outcomes: the reader answered (`ok`, `rejected`), never saw the file (`unreadable`, `oversize`), or gave no answer twice.
KINDS = ("ok", "rejected", "unreadable", "oversize", "crashed")
ATTEMPTS = 2
MAX_BYTES = 1 << 20
KEY = ["rel", "hash", "lang"]
FILES = 4096  # that a task reads at most, where `dealt_out` deals them
TEXT = 1 << 20  # bytes that a worker reads at a time, a kilobyte a file added
_NODE = f"array<struct<{', '.join(f'{n}: {t}' for n, t in (x.split(' ', 1) for x in NODES.split(', ') if not x.startswith('rel ')))}>>"
ANSWER = f"rel string, hash string, lang string, kind string, nodes {_NODE}"
_ROW = f"{ANSWER}, version string, attempt int"
_NAMES = ("pre", "post", "depth", "type", "name", "above", "fn", "cls", "line", "attrs")
_ARROW = pa.list_(pa.struct(list(zip(_NAMES, (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string()), pa.int32(), pa.int32(), pa.int32(), pa.map_(pa.string(), pa.string())), strict=True))))

#: (rel, lang, content, attempt) to (kind, nodes).
Read = Callable[[str, str, str, int], tuple[str, list[dict]]]
#: Files (rel, hash, lang, content, attempt) to answers (ANSWER); a file may be missing there.
Measure = Callable[[DataFrame], DataFrame]


def dealt_out(files: DataFrame, n: int) -> DataFrame:
    """`files` (rel, ...), `n` of them, over as many tasks as reading takes: a table of many small files has few splits."""
    return dealt(files, n, "rel", most=FILES)


def pieces(batch: pa.RecordBatch, column: str = "content") -> Iterator[pa.RecordBatch]:
    """`batch` in pieces of TEXT, or of one file that is longer, so that a worker holds no more of texts and answers."""
    low = held = 0
    for i, size in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
        if i > low and held + size + 1024 > TEXT:
            yield batch.slice(low, i - low)
            low, held = i, 0
        held += size + 1024
    yield batch.slice(low)


def guarded(read: Callable, rows: list[tuple]) -> Iterator[tuple[int, object]]:
    """(place, answer) of each row that `read` answers, read in a child process: a row that ends it has no answer, and the
    rows behind it are read in another."""
    at = 0
    while at < len(rows):
        mine, theirs = os.pipe()
        child = os.fork()
        if not child:
            try:
                os.close(mine)
                with os.fdopen(theirs, "wb") as out:
                    for i in range(at, len(rows)):
                        out.write(pickle.dumps((i, read(*rows[i]))))
                        out.flush()
            finally:
                os._exit(0)
        os.close(theirs)
        answered = at - 1
        with os.fdopen(mine, "rb") as answers:
            while True:
                try:
                    answered, answer = pickle.load(answers)
                except (EOFError, pickle.UnpicklingError):
                    break
                yield answered, answer
        os.waitpid(child, 0)
        at = answered + 2


def reading(read: Read, isolated: bool = False) -> Measure:
    """`read` as a measure over files. `isolated` contains what ends a process, at the price of one more for each piece of a batch;
    without it, errors that Python can catch are answers of kind `rejected`."""

    def attempt(*row: object) -> tuple[str, list[dict]]:
        try:
            return read(*row)
        except (RecursionError, ValueError, LookupError):  # an odd file is unread, the others are not
            return "rejected", []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in pieces(whole)):
            rel, hash_, lang, content, tries = (c.to_pylist() for c in batch.columns)
            rows = list(zip(rel, lang, content, tries, strict=True))
            found = dict(guarded(attempt, rows)) if isolated else {i: attempt(*r) for i, r in enumerate(rows)}
            at = sorted(found)
            pick = lambda x: pa.array([x[i] for i in at], pa.string())
            nodes = pa.array([[{n: node[n] for n in _NAMES} for node in found[i][1]] for i in at], _ARROW)
            yield pa.RecordBatch.from_arrays([pick(rel), pick(hash_), pick(lang), pa.array([found[i][0] for i in at], pa.string()), nodes], ["rel", "hash", "lang", "kind", "nodes"])

    return lambda files: files.select("rel", "hash", "lang", "content", "attempt").mapInArrow(run, ANSWER)


class Ledger:
    """Outcomes below `path`, a folder that executors and driver share; without one, a folder that nothing else uses."""

    def __init__(self, spark: SparkSession, path: str | None = None, version: str = "1", attempts: int = ATTEMPTS, max_bytes: int = MAX_BYTES):
        self.spark, self.version, self.attempts, self.max_bytes = spark, version, attempts, max_bytes
        self.new = path is None
        self.path = path or shared_path(spark, "ledger")
        if not self.new:
            spark.createDataFrame([], _ROW).write.mode("append").parquet(self.path)

    def rows(self) -> DataFrame:
        """Everything written: a row for each answer, and one without a kind for each attempt that gave none."""
        return self.spark.read.schema(_ROW).parquet(self.path)

    def _known(self) -> DataFrame:
        return self.rows().where(F.col("version") == self.version)

    def _state(self) -> DataFrame:
        """Whether each key is open still, and its attempts."""
        return self._known().groupBy(*KEY).agg(F.bool_and(F.col("kind").isNull()).alias("open"), F.max("attempt").alias("attempts"))

    def _add(self, rows: DataFrame, attempt: int) -> None:
        """Append rows (KEY and, if they are there, kind and nodes)."""
        there = [F.col(n) if n in rows.columns else F.lit(None).cast(_NODE if n == "nodes" else "string").alias(n) for n in (*KEY, "kind", "nodes")]
        rows.select(*there, F.lit(self.version).alias("version"), F.lit(attempt).alias("attempt")).write.mode("append").parquet(self.path)

    def settle(self, files: DataFrame, measure: Measure) -> DataFrame:
        """rel, hash, lang, kind, attempts, nodes of each of `files` (rel, lang, content, and `bytes` if they were counted).

        A null content is unreadable, one of over `max_bytes` oversize; neither reaches the reader. Paths are unique. An
        empty table gives none.
        """
        size = F.col("bytes") if "bytes" in files.columns else F.octet_length("content")
        skipped = F.when(size > self.max_bytes, "oversize").when(F.col("content").isNull(), "unreadable")
        wanted = files.select("rel", F.coalesce(F.sha2("content", 256), F.lit("")).alias("hash"), F.coalesce("lang", F.lit("")).alias("lang"), F.when(skipped.isNull(), F.col("content")).alias("content"), skipped.alias("skipped"))
        keys = stored(wanted.select(*KEY, "skipped"), "asked")  # slim rows, so that texts are read here and by the reader only
        for attempt in range(1, self.attempts + 1):
            if self.new:
                todo, asked, self.new = wanted, keys, False
            else:
                state = self._state()
                # never tried yet, or tried as often as all passes so far and still open
                open_ = keys.join(state, KEY, "left_anti") if attempt == 1 else keys.join(state.where((F.col("attempts") == attempt - 1) & F.col("open")), KEY, "left_semi")
                asked = stored(open_, "open")
                if asked.isEmpty():
                    continue
                todo = wanted.join(asked.select(*KEY), KEY, "left_semi")
            if attempt == 1:
                self._add(asked.where("skipped IS NOT NULL").select(*KEY, F.col("skipped").alias("kind")), 0)
            self._add(measure(dealt_out(todo.where("skipped IS NULL").withColumn("attempt", F.lit(attempt)), asked.count())), attempt)
            silent = asked.select(*KEY).join(self._known().where(F.col("kind").isNotNull()).select(*KEY), KEY, "left_anti")
            self._add(silent.withColumn("kind", F.lit("crashed" if attempt == self.attempts else None).cast("string")), attempt)
        answered = self._known().where(F.col("kind").isNotNull())
        return keys.select(*KEY).join(answered, KEY).select(*KEY, "kind", F.col("attempt").alias("attempts"), "nodes")

    def follow(self, files: DataFrame, measure: Measure, checkpoint: str) -> StreamingQuery:
        """Settle a stream of files as they arrive; a batch that is delivered again finds its files answered."""
        return files.writeStream.foreachBatch(lambda batch, _: self.settle(batch, measure) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def nodes(records: DataFrame) -> DataFrame:
    """The nodes of records that are ok, as an extractor gives them."""
    return records.where("kind = 'ok'").select("rel", F.explode("nodes").alias("n")).select("rel", "n.*")
