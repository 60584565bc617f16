"""The gate battery: ordered tests of a slot's counts, the first failure recorded, on both sides of a claim."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.stats import MIN_EFFECTIVE_FILES, MIN_RATIO, applicability_floor, authors_required, ratio, wilson_lower, wilson_upper


def _c(name: str) -> Column:
    return F.col(name)


def first_failure(conforming: Column, top_conforming: Column, rest_conforming: Column, history_read: Column | None = None) -> tuple[Column, Column]:
    """(name of the first gate that fails, null if none does; whether the evidence was borrowed from the pool)."""
    n, own = _c("candidates"), wilson_lower(conforming, _c("candidates"))
    rest_ratio = ratio(rest_conforming, _c("rest_candidates"))
    borrows = (wilson_lower(rest_conforming, _c("rest_candidates")) >= MIN_RATIO) & (wilson_upper(conforming, n) >= rest_ratio)
    without_top = ratio(conforming - top_conforming, n - _c("top_candidates"))
    even = (n * n >= MIN_EFFECTIVE_FILES * _c("squares")) & (without_top >= MIN_RATIO)
    files = F.coalesce(F.nullif(_c("lang_files"), F.lit(0)), _c("area_files"), F.lit(0))
    gates = [
        ("ratio", ratio(conforming, n) >= MIN_RATIO),
        ("evidence", (own >= MIN_RATIO) | borrows),
        ("concentration", even),
        ("applicability", (files > 0) & (_c("applicability") >= applicability_floor(files))),
        ("history-unread", F.lit(True) if history_read is None else history_read),
        ("authors", _c("authors") >= authors_required(_c("repo_authors"))),
        ("directories", (_c("area_dirs") <= 1) | (_c("dirs") >= 2)),
    ]
    failed = F.coalesce(*[F.when(~F.coalesce(holds, F.lit(False)), F.lit(name)) for name, holds in gates])
    return failed, failed.isNull() & (own < MIN_RATIO)


def judged(slots: DataFrame, history_read: Column | None = None) -> DataFrame:
    """`slots` with failed, borrowed, states (claim, counter or null) by the gates; the claim wins over its counter.

    Slots need the columns that the gates read, and `has_counter`: only such rows may state the inverse. A history that was
    not read is no history of few authors: with `history_read` false, slots that come that far fail as `history-unread`.
    """
    failed, borrowed = first_failure(_c("conforming"), _c("top_conforming"), _c("rest_conforming"), history_read)
    counter, counter_borrowed = first_failure(_c("candidates") - _c("conforming"), _c("top_candidates") - _c("top_conforming"), _c("rest_candidates") - _c("rest_conforming"), history_read)
    there = slots.withColumns({"failed": failed, "claim_borrowed": borrowed, "counter_failed": counter, "counter_borrowed": counter_borrowed})
    states = F.when(_c("failed").isNull(), "claim").when(_c("has_counter") & _c("counter_failed").isNull(), "counter")
    borrowed = F.when(states == "claim", _c("claim_borrowed")).when(states == "counter", _c("counter_borrowed")).otherwise(F.lit(False))
    return there.withColumns({"states": states, "borrowed": borrowed}).drop("claim_borrowed", "counter_borrowed")


def sided(slots: DataFrame) -> DataFrame:
    """`slots` with side (claim or counter) and side_conforming: the sentence that a slot is printed on, stated or not.

    A slot that states nothing shows its counter only where no site conforms, of two at least, or where the counter's own
    lower bound is above a half: a plurality is no majority.
    """
    against = _c("candidates") - _c("conforming")
    majority = ((_c("candidates") > 1) & (_c("conforming") == 0)) | (wilson_lower(against, _c("candidates")) > 0.5)
    counter = F.coalesce(_c("has_counter") & ((_c("states") == "counter") | (_c("states").isNull() & majority)), F.lit(False))
    return slots.withColumns({"side": F.when(counter, "counter").otherwise("claim"), "side_conforming": F.when(counter, against).otherwise(_c("conforming"))})


def blocked_by(truncated: Column, degraded: Column, area_gate: Column, learned_moved: Column) -> Column:
    """Why a slot may state nothing whatever its counts, in order of precedence; null if nothing stands in its way."""
    return F.when(truncated, "corpus-truncated").when(degraded, "degraded-semantic").otherwise(F.coalesce(area_gate, F.when(learned_moved, F.lit("learned-moved"))))


#: Severity of a finding, first rule that holds; each rule is (name, SQL predicate, severity).
SEVERITY = (
    ("no-dimension", "key IS NULL", "NIT"),
    ("not-stated", "states IS NULL", "NIT"),
    ("dropped", "dropped", "FIX"),
    ("stale", "stale OR NOT has_base", "FIX"),
    ("partial", "precision = 'partial'", "FIX"),
    ("exception-listed", "listed", "FIX"),
    ("no-baseline", "NOT pinned", "FIX"),
    ("borrowed", "borrowed", "FIX"),
    ("thin-bound", "bound < 0.9", "FIX"),
    ("imperfect", "conforming < candidates", "FIX"),
)


def severity(findings: DataFrame, capped: Column | None = None) -> DataFrame:
    """`findings` with reason and severity; MUST-FIX where no rule speaks against it, lowered to FIX where `capped`."""
    reason = F.coalesce(*[F.when(F.expr(p), F.lit(name)) for name, p, _ in SEVERITY], F.lit("clear"))
    level = F.coalesce(*[F.when(F.expr(p), F.lit(s)) for _, p, s in SEVERITY], F.lit("MUST-FIX"))
    level = level if capped is None else F.when((level == "MUST-FIX") & capped, "FIX").otherwise(level)
    return findings.withColumns({"reason": reason, "severity": level})
