"""Lines and texts of a map: what an area states, what there is beside it, and where things live.

Every line is a column of its row; a text is its lines in order. A text has a line or two for each dimension, and an overview
one for each area, of which a tree has `area_ceiling` at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators import gates, layout
from plumbline.operators.ordering import numbered

LINES, OVERVIEW_AREAS = 40, 200


def counted(n: Column, what: str, many: str | None = None) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, f" {what}").otherwise(f" {many or what + 's'}"))


def claim(slot: str = "") -> Column:
    """What a slot says, by its dimension, the class that it learned, and its side."""
    c = lambda name: F.col(f"{slot}{name}")
    return F.concat(c("key"), F.when(c("side") == "counter", " (inverse)").otherwise(""), F.coalesce(F.concat(F.lit(": "), c("learned")), F.lit("")))


def area_lines(slots: DataFrame, budget: int = LINES) -> DataFrame:
    """area, nth, line: first what is stated and what a model would not write unasked, with its counts; then, without a
    claim, the counts of the rest. Blocks that have no room go from the end; their claims are named while there is room.

    `slots` has the columns of judged slots, with learned, precision and matches_default.
    """
    c = F.col
    sided = gates.sided(slots).withColumn("told", c("states").isNotNull() & ~F.coalesce(c("matches_default"), F.lit(False)))
    of = F.concat_ws(" of ", c("side_conforming"), c("candidates"))
    counts = F.concat(F.lit("  "), of, F.lit(" sites across "), F.concat_ws(" of ", c("applicability"), c("lang_files")), F.lit(" files, "), counted(c("authors"), "author"), F.when(c("precision") == "partial", " (partial)").otherwise(""))
    rest = F.concat(F.lit("- "), claim(), F.when(c("states").isNotNull(), ": as by default, ").otherwise(": no convention, "), of, F.lit(" sites"), F.when(c("states").isNull(), F.concat(F.lit(" ("), F.coalesce(F.when(c("side") == "counter", c("counter_failed")).otherwise(c("failed")), F.lit("suppressed")), F.lit(")"))).otherwise(""))
    blocks = sided.withColumns({"block": F.when(c("told"), F.array(F.concat(F.lit("- "), claim()), counts)).otherwise(F.array(rest)), "order": F.struct((~c("told")).alias("rest"), (-c("candidates")).alias("minus"), c("key").alias("key"))}).withColumn("height", F.size("block"))
    settled = layout.settled(blocks, "area", ["order"], "height", budget)
    shown = settled.where("kept").select("area", F.lit(0).alias("part"), "order", F.posexplode("block").alias("k", "line"))
    named = settled.where("named AND states IS NOT NULL").select("area", F.lit(2).alias("part"), "order", F.lit(0).alias("k"), F.concat(F.lit("- "), claim()).alias("line"))
    hidden = settled.where("NOT kept").groupBy("area").agg(F.count(F.lit(1)).alias("n"), F.max("order").alias("order"))
    notice = hidden.select("area", F.lit(1).alias("part"), "order", F.lit(0).alias("k"), F.concat(F.lit("and "), c("n").cast("string"), F.lit(" more not shown here")).alias("line"))
    every = shown.unionByName(notice).unionByName(named)
    lines = F.array_sort(F.collect_list(F.struct("part", "order", "k", "line")))
    return every.groupBy("area").agg(lines.alias("lines")).select("area", F.posexplode("lines").alias("nth", "l")).select("area", (F.col("nth") + 1).alias("nth"), "l.line")


def texts(lines: DataFrame, by: str) -> DataFrame:
    """`by`, text: lines (nth, line) in order."""
    return lines.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "line"))), lambda x: x["line"]), "\n").alias("text"))


def overview(areas: DataFrame, slots: DataFrame, most: int = OVERVIEW_AREAS) -> DataFrame:
    """nth, line: a line for each area (area, files) that states something, largest first, and one for those that are left.

    `slots` has area, states and matches_default.
    """
    told = slots.where("states IS NOT NULL AND NOT coalesce(matches_default, false)").groupBy("area").agg(F.count(F.lit(1)).alias("stated"))
    there = areas.join(told, "area", "left").fillna(0, ["stated"])
    listed = numbered(there.where("stated > 0"), [F.desc("files"), "area"], "nth")
    line = F.concat(F.lit("- "), F.col("area"), F.lit(": "), counted(F.col("files"), "file"), F.lit(", "), counted(F.col("stated"), "claim"))
    rest = there.agg(F.count(F.lit(1)).alias("all"), F.count_if(F.col("stated") > 0).alias("some"))  # one row
    left = F.col("all") - F.least(F.col("some"), F.lit(most))
    tail = rest.where(left > 0).select(F.least(F.col("some"), F.lit(most)).alias("at"), F.concat(F.lit("- and "), counted(left, "more area"), F.lit(" that "), F.when(left == 1, "states").otherwise("state"), F.lit(" nothing shown here")).alias("line"))
    return listed.where(F.col("nth") <= most).select("nth", line.alias("line")).unionByName(tail.select((F.col("at") + 1).alias("nth"), "line"))


def layout_lines(roots: DataFrame, by: str) -> DataFrame:
    """`by`, line: what a directory holds, from `layout.root_facts`."""
    c = F.col
    kinds = F.concat(F.array_join(F.transform(F.split("exts", ","), lambda x: F.concat(F.split_part(x, F.lit(":"), F.lit(2)), F.lit(" ."), F.split_part(x, F.lit(":"), F.lit(1)))), ", "), F.when(c("other") > 0, F.concat(F.lit(" and "), c("other").cast("string"), F.lit(" other"))).otherwise(""))
    tests = counted(c("tests"), "test file")
    rest = c("files") - c("tests")
    testing = F.concat(tests, F.when(rest > 0, F.concat(F.lit(" and "), rest.cast("string"), F.lit(" other"))).otherwise(""))
    parts = F.concat_ws("; ", kinds, F.when(c("stories") > 0, counted(c("stories"), "story", "stories")), tests)
    return roots.select(by, F.concat(F.lit("- "), c(by), F.lit(": "), F.when(c("test_root"), testing).otherwise(parts)).alias("line"))
