"""Scopes, bindings and comments as relations over token tables: what a name means where it stands.

A token has its file (`rel`), its place (`at`, a whole number, one token a place) and a kind. Scopes are intervals of
places that nest. "Innermost interval around a place" is the one operator behind all of it: starts, ends and places are
one ordered pass, a running sum is the depth, and the last start at a place's own depth is the interval that holds it, so
that no pair of an interval and a place is ever made. A declaration holds from its place to its scope's end; those of one
name nest as scopes do, so the binding of a use is again the innermost interval. A pass is by file, or file and name: a
file is bounded by the size up to which files are read. Files are dealt to tasks by the number of rows that there are, so
that what a task sorts does not grow with the table: `rows` of a function is that number, counted if it is not given.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.ordering import next_after
from plumbline.tables import dealt

OPEN, CLOSE = "open", "close"


def innermost(intervals: DataFrame, places: DataFrame, by: list[str], name: str, carried: list[str] | None = None, rows: int | None = None) -> DataFrame:
    """`places` (`by`, at, ...) with `name`: start and `carried` of the innermost of `intervals` (`by`, start, until, ...) that
    holds them, null outside all.

    An interval holds the places behind its start up to and with `until`. Those of one `by` must nest or be apart; ones
    that hold nothing are left out. Null keys are one file like others.
    """
    own = ["start", *(carried or [])]
    kept = intervals.where("until > start")
    keys = [F.col(k) for k in by]
    no_row, no_interval = F.lit(None).cast(places.select(F.struct("*")).schema[0].dataType), F.lit(None).cast(kept.select(F.struct(*own)).schema[0].dataType)
    edge = lambda at, rank, step, held: F.struct(F.col(at).alias("_at"), F.lit(rank).alias("_rank"), F.lit(step).alias("_step"), held.alias("_interval"))
    edges = kept.select(*keys, F.explode(F.array(edge("until", 1, -1, no_interval), edge("start", 2, 1, F.struct(*own)))).alias("_e"))
    events = places.select(*keys, F.col("at").alias("_at"), F.lit(0).alias("_rank"), F.lit(0).alias("_step"), F.struct("*").alias("_row"), no_interval.alias("_interval")).unionByName(
        edges.select(*by, "_e._at", "_e._rank", "_e._step", no_row.alias("_row"), "_e._interval")
    )
    events = dealt(events, places.count() + 2 * kept.count() if rows is None else rows, *by)
    before = Window.partitionBy(*by).orderBy("_at", "_rank").rowsBetween(Window.unboundedPreceding, 0)
    deep = events.withColumn("_depth", F.sum("_step").over(before))
    same = Window.partitionBy(*by, "_depth").orderBy("_at", "_rank").rowsBetween(Window.unboundedPreceding, 0)
    held = F.when(F.col("_depth") > 0, F.last("_interval", ignorenulls=True).over(same))
    # keys are the dealt columns, not the row's copies of them: what follows finds the rows dealt by them
    return deep.withColumn(name, held).where("_row IS NOT NULL").select(*[c if c in by else f"_row.{c}" for c in places.columns], name)


def scopes(tokens: DataFrame, carried: list[str] | None = None, rows: int | None = None) -> DataFrame:
    """rel, start, until, depth, parent and `carried`: a row for each `open` token (rel, at, kind, ...).

    A `close` without an open scope is passed over; a scope left open ends with its file's last token.
    """
    order = Window.partitionBy("rel").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col("kind") == OPEN, 1).when(F.col("kind") == CLOSE, -1).otherwise(0)
    more = carried or []
    there = dealt(tokens.select("rel", "at", step.alias("_step"), *more), tokens.count() if rows is None else rows, "rel")
    level = there.withColumns({"_level": F.sum("_step").over(order), "_last": F.max("at").over(Window.partitionBy("rel"))})
    depth = F.col("_level") - F.least(F.min("_level").over(order), F.lit(0))  # closes that close nothing count for nothing
    edges = level.withColumn("_depth", depth).where("_step <> 0").withColumn("depth", F.col("_depth") + F.when(F.col("_step") < 0, 1).otherwise(0))
    # at one depth an open scope's close is the next edge
    closed = edges.withColumn("_next", F.lead("at").over(Window.partitionBy("rel", "depth").orderBy("at"))).where("_step > 0")
    made = closed.select("rel", F.col("at").alias("start"), F.coalesce("_next", "_last").alias("until"), "depth", *more)
    around = Window.partitionBy("rel", "_of").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    # a scope's parent is the last scope before it that is one less deep; each is there for its own depth, and asks the one above
    both = made.select("*", F.explode(F.array(F.col("depth"), F.col("depth") - 1)).alias("_of")).withColumn("_asks", F.col("_of") < F.col("depth"))
    asked = both.withColumn("parent", F.last(F.when(~F.col("_asks"), F.col("start")), ignorenulls=True).over(around)).where("_asks")
    return asked.select("rel", "start", "until", "depth", "parent", *more)


def declared(tokens: DataFrame, made: DataFrame, kind: Column, carried: list[str], rows: int | None = None) -> DataFrame:
    """rel, name, start, until, scope and `carried` of the tokens that declare a name: each holds to the end of its scope,
    or of its file."""
    rows = 2 * tokens.count() if rows is None else rows
    last = dealt(tokens.groupBy("rel").agg(F.max("at").alias("_last")), rows, "rel")  # as the pass is, so that the join deals nothing anew
    there = innermost(made, tokens.where(kind).select("rel", "at", "name", *carried), ["rel"], "_in", ["until"], rows).join(last, "rel")
    return there.select("rel", "name", F.col("at").alias("start"), F.coalesce("_in.until", "_last").alias("until"), F.col("_in.start").alias("scope"), *carried)


def bound(declarations: DataFrame, uses: DataFrame, carried: list[str], rows: int | None = None) -> DataFrame:
    """`uses` (rel, at, name, ...) with `binding`: start and `carried` of the declaration that they mean, null without one.

    Of the declarations of a name that are visible, the innermost scope's counts, and in it the last one before the use.
    """
    return innermost(declarations, uses, ["rel", "name"], "binding", carried, rows)


def reassigned(declarations: DataFrame, assignments: DataFrame, rows: int | None = None) -> DataFrame:
    """`declarations` with `reassigned`: whether an assignment (rel, at, name) means them."""
    rows = 2 * declarations.count() + assignments.count() if rows is None else rows
    hit = dealt(bound(declarations, assignments, [], rows).where("binding IS NOT NULL").select("rel", F.col("binding.start").alias("start"), F.lit(True).alias("_hit")), rows, "rel", "start").distinct()
    return dealt(declarations, rows, "rel", "start").join(hit, ["rel", "start"], "left").withColumn("reassigned", F.coalesce("_hit", F.lit(False))).drop("_hit")


def words(path: Column) -> Column:
    """Lower-case words of a path's last part up to its first dot."""
    stem = F.regexp_extract(F.substring_index(path, "/", -1), r"^(\.?[^.]*)", 1)
    return F.filter(F.split(F.lower(F.regexp_replace(stem, "([A-Z])", "-$1")), "[-_]+"), lambda w: w != "")


def wrapped(calls: DataFrame, imports: DataFrame, concerns: dict[str, tuple[str, ...]], rows: int | None = None) -> DataFrame:
    """`calls` (rel, at, name: the first of the call's chain) with `wrapper`: the concerns, between blanks in order, whose words
    name the module of one's own (a path that begins with a dot) from which the name was imported; null without one."""
    there = bound(imports, calls, ["source"], rows)
    of = F.array_compact(F.array(*[F.when(F.arrays_overlap(words(F.col("binding.source")), F.array(*[F.lit(w) for w in known])), F.lit(c)) for c, known in sorted(concerns.items())]))
    own = F.col("binding.source").startswith(".") & (F.size(of) > 0)
    return there.withColumn("wrapper", F.when(own, F.array_join(of, " "))).drop("binding")


def with_foreign_key(references: DataFrame, keys: DataFrame) -> DataFrame:
    """`references` (rel, at, owner, column) with `foreign_key`: whether the same file declares one apart (rel, owner, and a
    column, or the table that the column's name means)."""
    plural = F.regexp_replace(F.regexp_replace("column", "_id$", ""), "([^s])$", "$1s")
    by = ["rel", "owner"]
    named = keys.where(F.col("column").isNotNull()).select(*by, "column", F.lit(True).alias("_named")).distinct()
    meant = keys.where(F.col("column").isNull()).select(*by, F.col("target").alias("_plural"), F.lit(True).alias("_meant")).distinct()
    there = references.withColumn("_plural", plural).join(named, [*by, "column"], "left").join(meant, [*by, "_plural"], "left")
    held = reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in ("_named", "_meant")])
    return there.withColumn("foreign_key", held).select(*references.columns, "foreign_key")


def documented(declarations: DataFrame, comments: DataFrame, code: DataFrame) -> DataFrame:
    """`declarations` (rel, at, ...) with `doc`: whether a comment says what they are.

    `comments` have rel, at, own_line and tool; `code` (rel, at) has every other token, declarations too. Of the comments
    between a declaration and the code before it, tools' directives on lines of their own are passed over, and the last of
    the others must stand on a line of its own. Each comment finds the code behind it; declarations join by equality.
    """
    said = comments.where("NOT (own_line AND tool)").select("rel", "at", "own_line")
    behind = next_after(said, code.select("rel", "at"), "rel", "at", "_for").where("_for IS NOT NULL")
    last = behind.groupBy("rel", F.col("_for").alias("at")).agg(F.max_by("own_line", "at").alias("_doc"))
    return declarations.join(last, ["rel", "at"], "left").withColumn("doc", F.coalesce("_doc", F.lit(False))).drop("_doc")
