"""Line-first cleaning: rules judge each line, failing lines go, and a document that loses too much text goes with them.

Rules of a line: navigation (a row of entries between bars), symbols (many of `#*$%&|<>`), shouting (capitals and
exclamation marks), boilerplate (a short line with a stock phrase), fragment (a few words without closing punctuation),
stutter (hardly any different words) and copy (the same line earlier in the document).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import common
from plumbline.llm.tokens import in_slices
from plumbline.llm.words import Words, mixed, windows, words_of

SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\x0b\x0c\r"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: A document that loses more than this share of its words' bytes is rejected.
MAX_LOST = 0.5
CLOSING = (b".", b"!", b"?", b":", b";", b"\"", b"'", b")", b"]", "…".encode(), "”".encode(), "»".encode(), "。".encode())
BOILERPLATE = (b"javascript", b"cookie", b"lorem ipsum", b"terms of use", b"terms of service", b"privacy policy", b"all rights reserved", b"click here", b"sign up", b"log in", b"subscribe", b"read more", b"share this", b"powered by")


def line_rule(line: bytes) -> str:
    """The first rule that a line fails, or an empty string. Lines without a word pass. Copies are judged by the document."""
    words = line.split()
    n = len(words)
    if not n:
        return ""
    if line.count(b"|") >= 2 and 3 * line.count(b"|") >= n:
        return "navigation"
    size = len(line)
    if size - len(line.translate(None, SYMBOLS)) > 0.08 * size:
        return "symbols"
    if n >= 4 and line.isupper() and 2 * line.count(b"!!") >= n:
        return "shouting"
    if n < 5 and not line.rstrip().endswith(CLOSING):
        return "fragment"
    if n >= 10 and 4 * len(set(words)) <= n:
        return "stutter"
    if n <= 12 and any(p in (low := line.lower()) for p in BOILERPLATE):
        return "boilerplate"
    return ""


def cleaned(text: bytes) -> tuple[bytes, float]:
    """A text without its failing lines, and the share of its words' bytes that went with them."""
    kept, seen, lost, total = [], set(), 0, 0
    for line in text.split(b"\n"):
        bare = line.strip()
        total += len(bare)
        if bare and (line in seen or line_rule(line)):
            lost += len(bare)
        else:
            kept.append(line)
        seen.add(line)
    return b"\n".join(kept), lost / total if total else 0.0


def repeated_words(words: Words, size: int = WINDOW) -> np.ndarray:
    """Of each text: words within windows of `size` words that the text has twice or more, the first one included.

    Windows are compared by a hash first; windows of equal hash are then compared word by word, so counts are exact.
    """
    of_text = words.of_text
    hashes, first = windows(mixed(np.arange(1, len(words.distinct) + 1))[words.codes], words.offsets, size)
    keys = mixed(hashes + np.uint64(0x632BE59BD9B4E019) * of_text[first].astype(np.uint64))
    s = np.sort(keys)
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    counts = np.zeros(len(words.offsets) - 1, np.int64)
    if not len(twice):
        return counts
    hit = np.flatnonzero(twice[np.minimum(np.searchsorted(twice, keys), len(twice) - 1)] == keys)
    order = hit[np.lexsort((first[hit], keys[hit]))]
    a, b = order[:-1], order[1:]
    same_key = keys[a] == keys[b]
    a, b = a[same_key], b[same_key]
    equal = of_text[first[a]] == of_text[first[b]]
    for j in range(size):
        equal &= words.codes[first[a] + j] == words.codes[first[b] + j]
    marks = np.zeros(len(words.codes) + 1, np.int64)
    np.add.at(marks, first[hit], 1)
    np.add.at(marks, first[hit] + size, -1)
    covered = np.cumsum(marks[:-1]) > 0
    counts += np.bincount(of_text[covered], minlength=len(counts))
    for t in np.unique(of_text[first[a][~equal]]):  # a collision of hashes: count this text by its words themselves
        own = words.codes[words.offsets[t] : words.offsets[t + 1]].tolist()
        at: dict[tuple, list[int]] = {}
        for i in range(len(own) - size + 1):
            at.setdefault(tuple(own[i : i + size]), []).append(i)
        counts[t] = len({i + j for found in at.values() if len(found) > 1 for i in found for j in range(size)})
    return counts


MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, lost double, kept boolean"


def measure(docs: DataFrame, max_lost: float = MAX_LOST) -> DataFrame:
    """doc_id, the base measures of every whole text, the share that the line rules remove, and the verdict.

    A null text has no words and fails the base; repeated rows and null ids are judged each by itself; columns other
    than doc_id and text are ignored; an empty table gives none.
    """

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in in_slices(batch.column(1)):
                texts = pc.fill_null(batch.column(1)[a:b], "")
                words = words_of(texts)
                n = np.diff(words.offsets)
                raw = texts.cast(pa.binary()).to_pylist()
                spaces = np.array([len(t) - len(t.translate(None, SPACE)) for t in raw], np.int64)
                symbols = np.array([len(t) - len(t.translate(None, SYMBOLS)) for t in raw], np.int64)
                lines = [[x for x in t.split(b"\n") if x and not x.isspace()] for t in raw]
                dup = np.array([len(x) - len(set(x)) for x in lines], np.int64)
                repeat = repeated_words(words)
                failed = (n < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * n)
                lost = np.array([cleaned(t)[1] for t in raw], float)
                chars = pc.utf8_length(texts).to_numpy().astype(np.int64) - spaces
                columns = [n, chars, symbols, dup, repeat, failed, lost, ~failed & (lost <= max_lost)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], *map(pa.array, columns)], ["doc_id", *(x.split()[0] for x in MEASURES.split(", "))])

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(common.lean(judged), f"doc_id long, {MEASURES}")


def clean(docs: DataFrame) -> DataFrame:
    """`docs` (all columns) with failing lines removed from each text; documents that lose too much or fail the base go."""
    schema, names = docs.schema, docs.columns
    at = names.index("text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column(at), "")
            words = words_of(texts)
            n, repeat = np.diff(words.offsets), repeated_words(words)
            done = [cleaned(t) for t in texts.cast(pa.binary()).to_pylist()]
            keep = ~((n < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * n)) & np.array([x[1] <= MAX_LOST for x in done], bool)
            columns = list(batch.columns)
            columns[at] = pa.array([x[0].decode() for x in done], batch.column(at).type)
            yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(keep))

    return docs.mapInArrow(common.lean(rows), schema)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = measure(common.table(spark, sf_dir, "documents"))
    return rules.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost")


_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_WORD = r"'[^\x20\x09-\x0D]+'"
_PHRASES = "|".join(p.decode() for p in BOILERPLATE)
_ENDS = "".join(("\\" if c in "[]" else "") + c.replace("'", "''") for c in (p.decode() for p in CLOSING))
OP9_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT uid, doc_id, text, regexp_extract_all(text, {_WORD}) AS words FROM d),
windows AS (SELECT uid, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS win FROM w, unnest(range(1, len(words) - {WINDOW - 2})) AS r(i)),
again AS (SELECT uid, win FROM windows GROUP BY uid, win HAVING count(*) > 1),
repeated AS (SELECT uid, count(DISTINCT i + j) AS n FROM windows JOIN again USING (uid, win), range({WINDOW}) AS k(j) GROUP BY uid),
lines AS (SELECT uid, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS nth FROM d),
read AS (SELECT uid, line, regexp_extract_all(line, {_WORD}) AS words, strlen(line) AS size, strlen(trim(line, {_WS})) AS bare, rtrim(line, {_WS}) AS cut, row_number() OVER (PARTITION BY uid, line ORDER BY nth) AS copy, length(line) - length(replace(line, '|', '')) AS bars, length(line) - length(regexp_replace(line, '[#*$%&|<>]', '', 'g')) AS symbols, (length(line) - length(replace(line, '!!', ''))) // 2 AS marks FROM lines),
failing AS (SELECT uid, bare, words <> [] AND copy > 1 AS copied, words <> [] AND (copy > 1 OR (bars >= 2 AND 3 * bars >= len(words)) OR symbols > 0.08::DOUBLE * size OR (len(words) >= 4 AND regexp_matches(line, '[A-Z]') AND NOT regexp_matches(line, '[a-z]') AND 2 * marks >= len(words))
  OR (len(words) < 5 AND NOT regexp_matches(cut, '[{_ENDS}]$')) OR (len(words) >= 10 AND 4 * len(list_distinct(words)) <= len(words)) OR (len(words) <= 12 AND regexp_matches(lower(line), '{_PHRASES}'))) AS fails FROM read),
of_lines AS (SELECT uid, count(*) FILTER (WHERE copied) AS n_dup_lines, coalesce(sum(bare) FILTER (WHERE fails), 0) / nullif(sum(bare), 0) AS lost FROM failing GROUP BY uid),
base AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0) AS lost FROM w JOIN of_lines USING (uid) LEFT JOIN repeated USING (uid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed AS base_failed, NOT failed AND lost <= {MAX_LOST}::DOUBLE AS kept, lost FROM (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS failed FROM base)
"""
