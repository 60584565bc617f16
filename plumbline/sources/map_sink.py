"""The map as a sink: files that a run writes whole or not at all.

Tasks write each text as a draft below a folder of the run's own; the driver hears names and hashes only. The commit
first notes in the manifest what it is about to own, then renames the drafts that differ from what is there, then removes
files that an earlier manifest owns and this run does not write, and last writes the manifest of this run. An aborted run
removes its drafts and leaves the map as it was; a blind one, which could not read what it describes, writes nothing.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow.fs import FileSystem, FileType
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from plumbline.sources.listing import at

NAME = "plumbline_map"
MANIFEST = ".map.json"
#: Names that a run may write or remove.
OWN = re.compile(r"(?:[0-9a-f]{8}|overview)\.md")


@dataclass
class Drafts(WriterCommitMessage):
    files: list[tuple[str, str, str]]  # name, draft, hash


def manifest(store: FileSystem, root: str) -> dict[str, str]:
    """Name to hash of the files that earlier runs wrote."""
    path = f"{root}/{MANIFEST}"
    if store.get_file_info(path).type != FileType.File:
        return {}
    with store.open_input_stream(path) as file:
        return json.loads(file.read())


def _put(store: FileSystem, path: str, data: bytes) -> None:
    with store.open_output_stream(path) as out:
        out.write(data)


def _note(store: FileSystem, root: str, drafts: str, names: dict[str, str]) -> None:
    _put(store, f"{drafts}/manifest", json.dumps(names, sort_keys=True).encode())
    store.move(f"{drafts}/manifest", f"{root}/{MANIFEST}")


class MapWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.root = options["path"].rstrip("/")
        self.blind = options.get("blind", "false").lower() == "true"
        self.run = uuid.uuid4().hex

    def _at(self) -> tuple[FileSystem, str, str]:
        store, root = at(self.root)
        return store, root, f"{root}/.drafts-{self.run}"

    def write(self, rows: Iterator[Row]) -> Drafts:
        store, root, drafts = self._at()
        made: list[tuple[str, str, str]] = []
        task = TaskContext.get()
        folder = f"{drafts}/{task.partitionId() if task else 0}-{task.attemptNumber() if task else 0}-{uuid.uuid4().hex}"
        for row in () if self.blind else rows:
            if not OWN.fullmatch(row["name"]):
                raise ValueError(f"{row['name']} is no name of the map's own")
            if store.get_file_info(f"{root}/{row['name']}").type == FileType.Directory:
                raise ValueError(f"{root}/{row['name']} is a folder; remove it and write again")
            if not made:
                store.create_dir(folder)
            data = (row["text"] or "").encode()
            _put(store, f"{folder}/{row['name']}", data)
            made.append((row["name"], f"{folder}/{row['name']}", hashlib.sha256(data).hexdigest()))
        return Drafts(made)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        if self.blind:
            return
        store, root, drafts = self._at()
        store.create_dir(drafts)
        made = {name: (draft, hash_) for m in messages if isinstance(m, Drafts) for name, draft, hash_ in m.files}
        if len(made) != sum(len(m.files) for m in messages if isinstance(m, Drafts)):
            self.abort(messages)
            raise ValueError("two rows have the same name")
        before, now = manifest(store, root), {name: hash_ for name, (_, hash_) in made.items()}
        _note(store, root, drafts, before | now)
        for name, (draft, hash_) in made.items():
            if before.get(name) != hash_ or store.get_file_info(f"{root}/{name}").type != FileType.File:
                store.move(draft, f"{root}/{name}")
        for name in sorted(set(before) - set(now)):
            if OWN.fullmatch(name) and store.get_file_info(f"{root}/{name}").type == FileType.File:
                store.delete_file(f"{root}/{name}")
        _note(store, root, drafts, now)
        store.delete_dir(drafts)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, _, drafts = self._at()
        if store.get_file_info(drafts).type == FileType.Directory:
            store.delete_dir(drafts)


class Map(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "name string, text string"

    def writer(self, schema: object, overwrite: bool) -> MapWriter:
        return MapWriter(dict(self.options))


def write(spark: SparkSession, texts: DataFrame, root: str, blind: bool = False) -> list[str]:
    """Write texts (name, text) as the map below `root`; returns the names of the map as it is now."""
    spark.dataSource.register(Map)
    texts.select("name", F.coalesce("text", F.lit("")).alias("text")).write.format(NAME).mode("append").option("path", root).option("blind", str(blind).lower()).save()
    store, path = at(root.rstrip("/"))
    return sorted(manifest(store, path))
