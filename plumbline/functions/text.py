"""Ids, fingerprints and text that is safe to print."""

from __future__ import annotations

import json
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType


def area_id(path: Column) -> Column:
    return F.substring(F.sha2(path, 256), 1, 8)


def fingerprint(path: Column, key: Column, kind: Column, text: Column) -> Column:
    """What makes two findings the same one: path, dimension, kind and text."""
    return F.substring(F.sha2(F.concat_ws("\0", path, key, kind, text), 256), 1, 16)


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def line_at(text: Column, offset: Column) -> Column:
    """The line, from 1, of a code-point offset."""
    head = F.substring(text, F.lit(1), offset.cast("int"))
    return (F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1).cast("long")


def rounded(x: Column) -> Column:
    """A double to four places, by its exact binary value; a true tie goes away from zero.

    `round` goes by the shortest decimal, which is right but for decimal ties: there the double lies a little above or below
    the tie, and which, the error of its product with 20000 tells, made exactly of two halves.
    """
    size = F.abs(x)
    twice = F.rint(size * 20000.0)
    split = size * 134217729.0  # 2^27 + 1
    high = split - (split - size)
    error = (high * 20000.0 - twice) + (size - high) * 20000.0
    tie = (twice / 20000.0 == size) & (F.pmod(twice, F.lit(2.0)) == 1.0) & (twice < 2.0**52)
    near = F.when(error < 0, (twice - 1) / 2).otherwise((twice + 1) / 2) / 10000.0
    return F.when(tie, F.signum(x) * near).otherwise(F.round(x, 4))


#: What is taken out of a text that is printed, in this order; each leaves a blank.
STRUCTURAL = (r"-{3,}", r"~{3,}", r"<!--", r"--!?>", r"`+", r"\|")
MAX_TEXT, MAX_PATH = 200, 120


def printable(value: str | None, most: int = MAX_TEXT, path: bool = False) -> str:
    """A text from a repository that is safe to print on a line of its own: see `encoded`."""
    import regex

    text = unicodedata.normalize("NFKC", value or "")
    blanks = lambda t: regex.sub(" {2,}", " ", t).strip(" ")
    text = blanks(regex.sub(r"[^\p{L}\p{M}\p{N}\p{P}\p{S} ]", " ", text))
    for pattern in STRUCTURAL:
        text = regex.sub(pattern, " ", text)
    text = regex.sub(r"^(?:(?:[#>*+-]+|\d+[.)])\s*)+", "", blanks(text))
    if regex.fullmatch("=+", text):
        text = ""
    if path and text and not regex.fullmatch(r"[\p{Script=Latin}\p{Script=Common}\p{Script=Inherited}]*", text):
        return f'"<path with mixed scripts, {len(text)} chars>"'
    parts = regex.findall(r"\X", text)
    text = "".join(parts[:most]) + "…" if len(parts) > most else text
    return json.dumps(text, ensure_ascii=False) if path else text


@pandas_udf(StringType())
def encoded(text: pd.Series) -> pd.Series:
    """NFKC; what is not printable, and marks that structure a page, give way to blanks; no marks of a block at the start;
    200 characters as a reader counts them at most, with an ellipsis where there are more. A null text is an empty one.

    Spark SQL has no `normalize`, so this function and `encoded_path` leave the JVM, a batch at a time.
    """
    return text.map(printable)


@pandas_udf(StringType())
def encoded_path(path: pd.Series) -> pd.Series:
    """As `encoded`, in quotes and 120 characters at most; a path of mixed scripts shows none of itself."""
    return path.map(lambda p: printable(p, MAX_PATH, True))
