"""Syntax trees as tables: a node has its place in pre-order and the last place of its subtree.

"Is within" is a range of places of the same file, so predicates over enclosing or enclosed nodes are joins by file
and range, or windows over the order of places. Extractors for languages plug in behind this schema; the one here reads
tags of HTML.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCHEMA = "rel long, pre int, post int, depth int, type string, name string, parent int"
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)([^>]*?)(/?)>")
_VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))


def parsed(html: str) -> list[tuple[int, int, int, str, str, int]]:
    """(pre, post, depth, type, name, parent) of each element; elements left open end with the text."""
    nodes: list[list] = []
    open_: list[int] = []
    for m in _TAG.finditer(html):
        closing, tag, rest, empty = m.group(1), m.group(2).lower(), m.group(3), m.group(4)
        if closing:
            if any(nodes[i][3] == tag for i in open_):
                while nodes[i := open_.pop()][3] != tag:
                    nodes[i][1] = len(nodes) - 1
                nodes[i][1] = len(nodes) - 1
            continue
        named = re.search(r'\b(?:id|class|href)="([^"]*)"', rest)
        nodes.append([len(nodes), len(nodes), len(open_), tag, named.group(1) if named else "", open_[-1] if open_ else -1])
        if not empty and tag not in _VOID:
            open_.append(len(nodes) - 1)
    for i in open_:
        nodes[i][1] = len(nodes) - 1
    return [tuple(n) for n in nodes]


def extract(files: DataFrame) -> DataFrame:
    """Nodes of files (rel, content); a file whose text cannot be read has none."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(rel, *n) for rel, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for n in parsed(html or "")]
            columns = list(zip(*out, strict=True)) or [()] * 7
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in SCHEMA.split(", ")])

    return files.select("rel", "content").mapInArrow(rows, SCHEMA)


def holding(nodes: DataFrame, site: str, inner: str) -> DataFrame:
    """rel, pre, conforming: nodes of type `site`, and whether one of type `inner` is within them.

    The next node of type `inner` in the order of places is within a site just if its place is not past the site's last,
    so one window replaces a join of ranges.
    """
    some = nodes.where(F.col("type").isin(site, inner)).select("rel", "pre", "post", "type")
    # from the last place on, so that a frame grows by a row at a time
    after = Window.partitionBy("rel").orderBy(F.desc("pre")).rowsBetween(Window.unboundedPreceding, -1)
    next_ = F.last(F.when(F.col("type") == inner, F.col("pre")), ignorenulls=True).over(after)
    return some.withColumn("_next", next_).where(F.col("type") == site).select("rel", "pre", F.coalesce(F.col("_next") <= F.col("post"), F.lit(False)).alias("conforming"))
