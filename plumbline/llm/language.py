"""Language identification by rank-order profiles of character n-grams.

A profile is the TOP most frequent n-grams of one to three characters, padded by a blank at word ends, by rank. A
document's profile is compared to each language's by out-of-place distance: the sum over the document's n-grams of how
far their ranks differ, TOP for those that the language lacks. The nearest language is predicted.

Profiles are counted over at most about MAX_DOCS documents of a language, chosen by a hash of their id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm import common
from plumbline.llm.tokens import in_slices

TOP = 300
#: Documents of a language that its profile is counted over: all of them up to this number, about this many beyond it.
MAX_DOCS = 1500
SEED = 5
_BITS = np.uint64(21)
#: Characters that are counted at a time: bounds memory for very long texts, not what is counted.
BLOCK = 2_000_000


def n_grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram, count), ascending, of a text's n-grams of one to three characters: letters in lower case and one blank
    between words and at either end. Every n-gram has a letter. A text without letters has none."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = np.concatenate([[False], _is_letter(codes), [False]])
    chars = np.where(letter, np.concatenate([[32], codes, [32]]), 32).astype(np.uint64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # of a run of blanks, the first; the very first of all as well
    keep[0] = True
    if not letter[1]:
        keep[1] = False
    chars = chars[keep]
    if len(chars) < 3:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for a in range(0, len(chars), BLOCK):
        c = chars[a : a + BLOCK + 2]
        n = min(BLOCK, len(chars) - a)
        two = (c[:-1] << _BITS) | c[1:]
        three = (two[:-1] << _BITS) | c[2:]
        word = c != 32
        grams = np.concatenate([c[:n][word[:n]], two[:n], three[:n][word[1:-1][:n]]])  # not across a blank
        found.append(np.unique(grams, return_counts=True))
    return found[0] if len(found) == 1 else merged(found)


def merged(counts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    grams, at = np.unique(np.concatenate([g for g, _ in counts]), return_inverse=True)
    return grams, np.bincount(at, weights=np.concatenate([n for _, n in counts]), minlength=len(grams)).astype(np.int64)


def ranked(grams: np.ndarray, counts: np.ndarray, top: int = TOP) -> np.ndarray:
    """The most frequent n-grams, ties in order of the n-gram."""
    return grams[np.argsort(-counts, kind="stable")[:top]]


_table: np.ndarray | None = None


def _is_letter(codes: np.ndarray) -> np.ndarray:
    """Whether code points are letters, by a table of all of Unicode made once."""
    global _table
    if _table is None:
        _table = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _table[codes]


class Profiles:
    """Each language's ranks over the n-grams that any language's profile has."""

    def __init__(self, profiles: dict[str, np.ndarray], top: int = TOP):
        self.languages, self.top = sorted(profiles), top
        self.grams = np.unique(np.concatenate([np.zeros(0, np.uint64), *profiles.values()]))
        self.ranks = np.full((len(profiles), len(self.grams) + 1), -1, np.int64)
        for row, language in zip(self.ranks, self.languages, strict=True):
            row[np.searchsorted(self.grams, profiles[language])] = np.arange(len(profiles[language]))

    def nearest(self, text: str | None) -> tuple[str, float]:
        """(language, score): 1 at no distance, 0 where no n-gram of the document is in the profile."""
        own = ranked(*n_grams(text or ""), self.top)
        if not len(own) or not self.languages:
            return "und", 0.0
        at = np.searchsorted(self.grams, own)
        at[at < len(self.grams)] = np.where(self.grams[at[at < len(self.grams)]] == own[at < len(self.grams)], at[at < len(self.grams)], len(self.grams))
        ranks = self.ranks[:, at]
        apart = np.where(ranks >= 0, np.abs(ranks - np.arange(len(own))), self.top).sum(1)
        best = int(np.argmin(apart))  # ties go to the first in order of name
        return self.languages[best], 1.0 - float(apart[best]) / (self.top * len(own))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, max_docs: int = MAX_DOCS, top: int = TOP) -> Profiles:
    """Profiles from texts and languages of documents that are not held out; null ids, texts and languages are passed over."""
    spark = docs.sparkSession
    known = docs.select(F.col("doc_id").cast("long"), "text", "lang").where("doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL").where(~held_out(F.col("doc_id")))
    sizes = [(r[0], min(1 << 30, int((1 << 30) * max_docs / r[1]))) for r in known.groupBy("lang").count().collect()]  # one row a language
    shares = spark.createDataFrame(sizes, "lang string, share long")
    some = known.join(F.broadcast(shares), "lang").where(F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 30)) < F.col("share"))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list] = {}
        for batch in batches:
            for language, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = found.setdefault(language, [])
                own.append(n_grams(text))
                if len(own) >= 200:
                    found[language] = [merged(own)]
        for language, own in found.items():
            grams, n = merged(own)
            yield pa.RecordBatch.from_arrays([pa.array([language] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    summed = some.select("lang", "text").mapInArrow(common.lean(counts), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    rows = summed.withColumn("place", place).where(F.col("place") <= top).collect()  # `top` rows a language
    profiles: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: r.place):
        profiles.setdefault(r.lang, []).append(r.gram)
    return Profiles({k: np.array(v, np.int64).view(np.uint64) for k, v in profiles.items()}, top)


def identify(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """doc_id, lang_pred and score of every whole text; `und` with score 0 for texts that are null or hold no letter.

    Very long texts are counted whole, a part at a time; of n-grams that are equally frequent the lesser ranks first, and of
    languages that are equally near the first by name is predicted. Repeated rows and null ids are judged each by itself;
    columns other than doc_id and text are ignored; an empty table gives none.
    """

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in in_slices(batch.column(1)):
                found = [profiles.nearest(t) for t in batch.column(1)[a:b].to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(common.lean(nearest), "doc_id long, lang_pred string, score double")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return identify(docs, train(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


#: The same over tables on which no language has more than MAX_DOCS documents, so that profiles are counted over all of them.
OP8_SQL = rf"""
WITH RECURSIVE bits AS (SELECT i AS n, i AS c, 0 AS k FROM range(256) AS r(i) UNION ALL SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY n) AS t FROM bits WHERE k = 8),
d AS (SELECT row_number() OVER () AS uid, doc_id, lang, text IS NULL AS none, coalesce(xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda a, b: xor(a >> 8, t[1 + (xor(a, b) & 255)])), 4294967295) % 4 = 2, false) AS held_out,
  trim(regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}]+', ' ', 'g')) AS words FROM documents, crc),
p AS (SELECT uid, string_split(' ' || words || ' ', '') AS c FROM d WHERE words <> ''),
q AS (SELECT uid, unnest(c) AS one, unnest(list_concat(c[2:], [NULL])) AS two, unnest(list_concat(c[3:], [NULL, NULL])) AS three FROM p),
each AS (SELECT uid, one AS gram, 1 AS n FROM q WHERE one <> ' ' UNION ALL SELECT uid, one || two, 2 FROM q WHERE two IS NOT NULL UNION ALL SELECT uid, one || two || three, 3 FROM q WHERE three IS NOT NULL AND two <> ' '),
grams AS (SELECT uid, gram, n, count(*) AS times FROM each GROUP BY ALL),
own AS (SELECT * FROM (SELECT uid, gram, row_number() OVER (PARTITION BY uid ORDER BY times DESC, n, gram) - 1 AS rank FROM grams) WHERE rank < {TOP}),
counted AS (SELECT lang, gram, n, sum(times) AS times FROM grams JOIN d USING (uid) WHERE NOT none AND lang IS NOT NULL AND doc_id IS NOT NULL AND NOT held_out GROUP BY ALL),
profile AS (SELECT * FROM (SELECT lang, gram, row_number() OVER (PARTITION BY lang ORDER BY times DESC, n, gram) - 1 AS rank FROM counted) WHERE rank < {TOP}),
apart AS (SELECT uid, l.lang, sum(coalesce(abs(p.rank - o.rank), {TOP})) AS apart, count(*) AS n FROM own o CROSS JOIN (SELECT DISTINCT lang FROM profile) l LEFT JOIN profile p ON p.lang = l.lang AND p.gram = o.gram GROUP BY ALL),
best AS (SELECT uid, first(lang ORDER BY apart, lang) AS lang_pred, 1 - min(apart)::DOUBLE / ({TOP} * min(n)) AS score FROM apart GROUP BY uid)
SELECT doc_id, held_out, coalesce(lang_pred, 'und') AS lang_pred, coalesce(score, 0)::DOUBLE AS score FROM d LEFT JOIN best USING (uid)
"""
