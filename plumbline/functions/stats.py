"""Counts to bounds and floors. Every division is guarded: a missing denominator gives a value, never null or an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_RATIO = 0.9
Z = 1.96
MIN_EFFECTIVE_FILES = 3
AUTHOR_EVIDENCE = 2
MIN_APPLICABILITY_SHARE = 0.25
APPLICABILITY_SHARE_CAP = 3
DRIFT_SHARE = 0.25


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def area_floor(n: Column) -> Column:
    """Files that an area needs, from the corpus size."""
    return clamp(F.floor(F.sqrt(n) / 6 + 0.5), 3, 8).cast("long")


def area_ceiling(n: Column) -> Column:
    """Areas that a corpus may have."""
    return clamp(F.ceil(n / 16), 120, 500).cast("long")


def min_root_files(n: Column) -> Column:
    return F.greatest(F.lit(3), F.ceil(n * 0.01)).cast("long")


def applicability_floor(files: Column) -> Column:
    """Files a dimension must touch: the root of the files, or a quarter of them up to three roots."""
    root = F.ceil(F.sqrt(files))
    return F.greatest(root, F.least(F.ceil(files * MIN_APPLICABILITY_SHARE), root * APPLICABILITY_SHARE_CAP)).cast("long")


def authors_required(repo_authors: Column) -> Column:
    known = repo_authors.isNotNull() & ~F.isnan(repo_authors.cast("double")) & (F.abs(repo_authors.cast("double")) < float("inf"))
    return F.when(known, clamp(F.floor(repo_authors), 1, AUTHOR_EVIDENCE)).otherwise(F.lit(AUTHOR_EVIDENCE)).cast("long")


def _wilson(k: Column, n: Column, z: float) -> tuple[Column, Column, Column]:
    n = F.greatest(n.cast("double"), F.lit(1e-300))
    p = F.least(k / n, F.lit(1.0))
    z2 = z * z
    return p, (p + z2 / (2 * n)), z * F.sqrt((p * (1 - p) + z2 / (4 * n)) / n) + F.lit(0.0)


def wilson_lower(k: Column, n: Column, z: float = Z) -> Column:
    """Lower bound of the Wilson interval; 0 without trials or successes."""
    _, mid, half = _wilson(k, n, z)
    return F.when((n <= 0) | (k <= 0), F.lit(0.0)).otherwise((mid - half) / (1 + z * z / F.greatest(n.cast("double"), F.lit(1e-300))))


def wilson_upper(k: Column, n: Column, z: float = Z) -> Column:
    """Upper bound of the Wilson interval, the ratio at least and 1 at most; 1 without trials."""
    p, mid, half = _wilson(k, n, z)
    return F.when(n <= 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(p, (mid + half) / (1 + z * z / F.greatest(n.cast("double"), F.lit(1e-300))))))


def ratio(k: Column, n: Column) -> Column:
    """k / n; 0 without a denominator."""
    return F.when(n > 0, k / n).otherwise(F.lit(0.0))
