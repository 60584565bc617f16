"""Queries over slots of the star tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import stats
from plumbline.functions.text import area_id, fingerprint, rounded
from plumbline.operators import gates, layout, slots
from plumbline.operators.ordering import numbered
from plumbline.plans.registry import query
from plumbline.sources import star
from plumbline.tables import stored

_Z = f"{stats.Z}::DOUBLE"
_Z2 = f"{stats.Z * stats.Z!r}::DOUBLE"


def _wilson_sql(k: str, n: str) -> tuple[str, str]:
    n = f"({n})::DOUBLE"
    p = f"least(({k}) / {n}, 1::DOUBLE)"
    mid, half = f"({p} + {_Z2} / (2 * {n}))", f"({_Z} * sqrt(({p} * (1 - {p}) + {_Z2} / (4 * {n})) / {n}))"
    low = f"(CASE WHEN {n} <= 0 OR ({k}) <= 0 THEN 0::DOUBLE ELSE ({mid} - {half}) / (1 + {_Z2} / {n}) END)"
    high = f"(CASE WHEN {n} <= 0 THEN 1::DOUBLE ELSE least(1::DOUBLE, greatest({p}, ({mid} + {half}) / (1 + {_Z2} / {n}))) END)"
    return low, high


def _floor_sql(files: str) -> str:
    return f"greatest(ceil(sqrt({files})), least(ceil(({files}) * 0.25::DOUBLE), ceil(sqrt({files})) * 3))::BIGINT"


_DIMS_SQL = "dims AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', {counter}, {list(langs)!r}, {blind})" for k, (_, counter, langs, blind) in star.DIMENSIONS.items()) + ") AS d(key, has_counter, langs, blind))"
BY_FILE_SQL = f"{star.SITES_SQL},\nby_file AS (SELECT area, key, rel, count(*) AS candidates, count(*) FILTER (WHERE conforming) AS conforming FROM sites GROUP BY ALL)"
SLOTS_SQL = f"""{BY_FILE_SQL},
slots AS (SELECT area, key, count(*) AS applicability, sum(candidates)::BIGINT AS candidates, sum(conforming)::BIGINT AS conforming, sum(candidates * candidates)::BIGINT AS squares,
  first(candidates ORDER BY candidates DESC, rel) AS top_candidates, first(conforming ORDER BY candidates DESC, rel) AS top_conforming FROM by_file GROUP BY area, key)"""
FULL_SQL = f"""{SLOTS_SQL},
{_DIMS_SQL},
denominators AS (SELECT area, key, count(*) AS lang_files FROM files, dims WHERE list_contains(langs, lang) AND NOT (stripped AND blind) GROUP BY area, key),
area_dirs AS (SELECT area, count(DISTINCT dir) AS area_dirs, count(*) AS area_files FROM files GROUP BY area),
who AS (SELECT area, key, count(DISTINCT author) AS authors, count(DISTINCT dir) AS dirs FROM sites GROUP BY area, key),
repo AS (SELECT count(DISTINCT l_suppkey) AS repo_authors FROM lineitem),
full_slots AS (SELECT s.*, coalesce(lang_files, 0) AS lang_files, area_dirs, area_files, authors, dirs, repo_authors, has_counter,
  (sum(s.candidates) OVER (PARTITION BY s.key) - s.candidates)::BIGINT AS rest_candidates, (sum(s.conforming) OVER (PARTITION BY s.key) - s.conforming)::BIGINT AS rest_conforming
  FROM slots s LEFT JOIN denominators d ON s.area = d.area AND s.key = d.key JOIN area_dirs a ON s.area = a.area JOIN who w ON s.area = w.area AND s.key = w.key JOIN dims m ON s.key = m.key, repo)"""


def _failed_sql(k: str, top: str, rest: str) -> str:
    own, high = _wilson_sql(k, "candidates")
    pool, _ = _wilson_sql(rest, "rest_candidates")
    ratio = lambda a, b: f"(CASE WHEN ({b}) > 0 THEN ({a}) / ({b}) ELSE 0::DOUBLE END)"
    rules = [
        ("ratio", f"{ratio(k, 'candidates')} >= 0.9::DOUBLE"),
        ("evidence", f"({own} >= 0.9::DOUBLE OR ({pool} >= 0.9::DOUBLE AND {high} >= {ratio(rest, 'rest_candidates')}))"),
        ("concentration", f"candidates * candidates >= 3 * squares AND {ratio(f'{k} - ({top})', 'candidates - top_candidates')} >= 0.9::DOUBLE"),
        ("applicability", f"coalesce(nullif(lang_files, 0), area_files) > 0 AND applicability >= {_floor_sql('coalesce(nullif(lang_files, 0), area_files)')}"),
        ("authors", "authors >= least(2, greatest(1, repo_authors))"),
        ("directories", "(area_dirs <= 1 OR dirs >= 2)"),
    ]
    return "CASE " + " ".join(f"WHEN NOT ({rule}) THEN '{name}'" for name, rule in rules) + " END"


_CLAIM = _failed_sql("conforming", "top_conforming", "rest_conforming")
_COUNTER = _failed_sql("(candidates - conforming)", "(top_candidates - top_conforming)", "(rest_candidates - rest_conforming)")
_OWN, _ = _wilson_sql("conforming", "candidates")
_COUNTER_OWN, _ = _wilson_sql("candidates - conforming", "candidates")
JUDGED_SQL = f"""{FULL_SQL},
failures AS (SELECT *, {_CLAIM} AS failed, {_COUNTER} AS counter_failed FROM full_slots),
judged AS (SELECT *, CASE WHEN failed IS NULL THEN 'claim' WHEN has_counter AND counter_failed IS NULL THEN 'counter' END AS states,
  CASE WHEN failed IS NULL THEN {_OWN} < 0.9::DOUBLE WHEN has_counter AND counter_failed IS NULL THEN {_COUNTER_OWN} < 0.9::DOUBLE ELSE false END AS borrowed FROM failures)"""


def dimensions(spark: SparkSession) -> DataFrame:
    """key, has_counter, langs, blind: the registry, one row a dimension."""
    return spark.createDataFrame([(k, counter, list(langs), blind) for k, (_, counter, langs, blind) in star.DIMENSIONS.items()], "key string, has_counter boolean, langs array<string>, blind boolean")


def by_file(files: DataFrame) -> DataFrame:
    """area, key, rel, candidates, conforming of counted files: each dimension's counts become rows last."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).alias("conforming")) for k in star.DIMENSIONS]))
    return files.where("area IS NOT NULL").select("area", "rel", F.col("n").alias("candidates"), each.alias("d")).select("area", "d.key", "rel", "candidates", "d.conforming")


def full_slots(spark: SparkSession, sf: str) -> DataFrame:
    """Slots with everything that the gates read. Line items are read once; every item is a site of all dimensions, so authors
    and directories are an area's. Slots are stored before they are pooled: the pool and what it is joined to are read there."""
    files, dims = stored(star.files_counted(spark, sf), "counted"), dimensions(spark)
    authors = files.select("area", F.explode("authors").alias("author")).distinct()
    repo = authors.agg(F.count_distinct("author").alias("repo_authors"))  # one row
    by_area = authors.where("area IS NOT NULL").groupBy("area").agg(F.count(F.lit(1)).alias("authors"))
    dirs = files.where("area IS NOT NULL").select("area", "dir").distinct().groupBy("area").agg(F.count(F.lit(1)).alias("dirs"))
    every = star.files(spark, sf)
    area_dirs = every.groupBy("area", "dir").agg(F.count(F.lit(1)).alias("n")).groupBy("area").agg(F.count(F.lit(1)).alias("area_dirs"), F.sum("n").alias("area_files"))
    there = slots.slot_counts(by_file(files)).join(slots.denominators(every, dims), slots.SLOT, "left").fillna(0, ["lang_files"]).join(by_area, "area").join(dirs, "area").join(area_dirs, "area")
    return slots.pooled(stored(there.join(F.broadcast(dims.select("key", "has_counter")), "key").crossJoin(F.broadcast(repo)), "slots"), ["key"])


def judged(spark: SparkSession, sf: str) -> DataFrame:
    return gates.judged(full_slots(spark, sf))


@query(f"WITH {BY_FILE_SQL} SELECT * FROM by_file")
def site_counts_by_file(spark: SparkSession, sf: str) -> DataFrame:
    return by_file(star.files_counted(spark, sf))


@query(f"WITH {SLOTS_SQL} SELECT *, candidates * candidates / squares AS effective_files FROM slots")
def slot_counts(spark: SparkSession, sf: str) -> DataFrame:
    return slots.slot_counts(by_file(star.files_counted(spark, sf))).withColumn("effective_files", slots.effective_files(F.col("candidates"), F.col("squares")))


@query(f"WITH {FULL_SQL} SELECT * FROM denominators")
def slot_denominator(spark: SparkSession, sf: str) -> DataFrame:
    return slots.denominators(star.files(spark, sf), dimensions(spark))


_LOW, _HIGH = _wilson_sql("k", "n")


@query(f"WITH t AS (SELECT l_suppkey, count(*) AS n, count(*) FILTER (WHERE l_quantity <= 46) AS k FROM lineitem GROUP BY 1) SELECT l_suppkey, n, k, {_LOW} AS lower, {_HIGH} AS upper FROM t")
def wilson_bounds(spark: SparkSession, sf: str) -> DataFrame:
    t = star.read(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_quantity") <= 46).alias("k"))
    return t.withColumns({"lower": stats.wilson_lower(F.col("k"), F.col("n")), "upper": stats.wilson_upper(F.col("k"), F.col("n"))})


@query(f"WITH {star.FILES_SQL}, t AS (SELECT area, count(*) AS n FROM files GROUP BY area) SELECT area, n, {_floor_sql('n')} AS applicability_floor, least(greatest(floor(sqrt(n) / 6 + 0.5::DOUBLE), 3), 8)::BIGINT AS area_floor, least(greatest(ceil(n / 16), 120), 500)::BIGINT AS area_ceiling, greatest(3, ceil(n * 0.01::DOUBLE))::BIGINT AS min_root_files FROM t")
def applicability_floor(spark: SparkSession, sf: str) -> DataFrame:
    t = star.files(spark, sf).groupBy("area").agg(F.count(F.lit(1)).alias("n"))
    n = F.col("n")
    return t.withColumns({"applicability_floor": stats.applicability_floor(n), "area_floor": stats.area_floor(n), "area_ceiling": stats.area_ceiling(n), "min_root_files": stats.min_root_files(n)})


@query(f"WITH {JUDGED_SQL} SELECT area, key, candidates, conforming, applicability, authors, dirs, coalesce(failed, 'stated') AS gate FROM judged")
def slot_gates_star(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: sites of the star tables to slots, and the first gate that each fails."""
    return judged(spark, sf).select("area", "key", "candidates", "conforming", "applicability", "authors", "dirs", F.coalesce("failed", F.lit("stated")).alias("gate"))


@query(f"WITH {JUDGED_SQL} SELECT area, key, failed, counter_failed, states, borrowed FROM judged")
def slot_gates_two_sided(spark: SparkSession, sf: str) -> DataFrame:
    return judged(spark, sf).select("area", "key", "failed", "counter_failed", "states", "borrowed")


@query(f"WITH {SLOTS_SQL}, b AS (SELECT *, applicability % 3 = 0 AS blocked FROM slots) SELECT area, key, greatest(sum(CASE WHEN NOT blocked THEN candidates ELSE 0 END) OVER (PARTITION BY key) - CASE WHEN NOT blocked THEN candidates ELSE 0 END, 0)::BIGINT AS rest_candidates, greatest(sum(CASE WHEN NOT blocked THEN conforming ELSE 0 END) OVER (PARTITION BY key) - CASE WHEN NOT blocked THEN conforming ELSE 0 END, 0)::BIGINT AS rest_conforming FROM b")
def pooled_prior_loo(spark: SparkSession, sf: str) -> DataFrame:
    counted = slots.slot_counts(by_file(star.files_counted(spark, sf)))
    return slots.pooled(counted, ["key"], F.col("applicability") % 3 == 0).select("area", "key", "rest_candidates", "rest_conforming")


@query("WITH c AS (SELECT p_brand AS brand, p_type AS class, count(*) AS n FROM part GROUP BY ALL), b AS (SELECT brand, max(n) AS votes FROM c GROUP BY brand) SELECT b.brand, CASE WHEN count(*) = 1 THEN min(class) END AS learned, votes FROM b JOIN c ON b.brand = c.brand AND c.n = b.votes GROUP BY b.brand, votes")
def learned_class_vote(spark: SparkSession, sf: str) -> DataFrame:
    parts = star.read(spark, sf, "part").select(F.col("p_brand").alias("brand"), F.col("p_type").alias("class"))
    return slots.learned(parts, ["brand"])


_GROUPED_SQL = """s AS (SELECT l_returnflag AS area, CASE WHEN l_linenumber <= 5 THEN l_orderkey END AS grp, CASE WHEN l_quantity > 2 THEN l_linestatus || (l_linenumber % 3) END AS class, l_discount <= 0.05 AS conforming FROM lineitem)"""


def _grouped(spark: SparkSession, sf: str) -> DataFrame:
    items = star.read(spark, sf, "lineitem")
    return items.select(F.col("l_returnflag").alias("area"), F.when(F.col("l_linenumber") <= 5, F.col("l_orderkey")).alias("grp"), F.when(F.col("l_quantity") > 2, F.concat("l_linestatus", (F.col("l_linenumber") % 3).cast("string"))).alias("class"), (F.col("l_discount") <= 0.05).alias("conforming"))


@query(f"WITH {_GROUPED_SQL}, v AS (SELECT DISTINCT area, grp, class FROM s WHERE grp IS NOT NULL AND class IS NOT NULL UNION ALL SELECT area, grp, class FROM s WHERE grp IS NULL AND class IS NOT NULL), c AS (SELECT area, class, count(*) AS n FROM v GROUP BY ALL), b AS (SELECT area, max(n) AS votes FROM c GROUP BY area) SELECT b.area, CASE WHEN count(*) = 1 THEN min(class) END AS learned, votes FROM b JOIN c ON b.area = c.area AND n = votes GROUP BY b.area, votes")
def learned_class_grouped(spark: SparkSession, sf: str) -> DataFrame:
    return slots.learned(_grouped(spark, sf), ["area"], group="grp")


@query(f"WITH {_GROUPED_SQL}, g AS (SELECT area, grp, bool_or(conforming) AS conforming FROM s WHERE grp IS NOT NULL GROUP BY area, grp UNION ALL SELECT area, grp, conforming FROM s WHERE grp IS NULL) SELECT area, count(*) AS sites, count(*) FILTER (WHERE conforming) AS conforming FROM g GROUP BY area")
def group_collapse(spark: SparkSession, sf: str) -> DataFrame:
    one = slots.collapsed(_grouped(spark, sf), ["area"], "grp")
    return one.groupBy("area").agg(F.count(F.lit(1)).alias("sites"), F.count_if("conforming").alias("conforming"))


@query("WITH c AS (SELECT p_brand AS area, CASE WHEN p_size > 25 THEN 'module' ELSE 'component' END AS kind, count(*) AS n FROM part GROUP BY ALL) SELECT area, first(kind ORDER BY n DESC, kind = 'module' DESC, kind) AS kind, sum(n)::BIGINT AS files FROM c GROUP BY area")
def majority_kind_split(spark: SparkSession, sf: str) -> DataFrame:
    kinds = star.read(spark, sf, "part").select(F.col("p_brand").alias("area"), F.when(F.col("p_size") > 25, "module").otherwise("component").alias("kind"))
    return slots.majority_kind(kinds, ["area"], "kind", "module")


@query(f"WITH {BY_FILE_SQL}, bad AS (SELECT area, key, rel, candidates - conforming AS bad, row_number() OVER (PARTITION BY area, key ORDER BY candidates - conforming DESC, rel) AS rank, count(*) OVER (PARTITION BY area, key) AS n FROM by_file WHERE candidates > conforming) SELECT area, key, string_agg(rel || ':' || bad, ',' ORDER BY rank) AS exceptions, greatest(max(n) - 3, 0)::BIGINT AS more_exceptions FROM bad WHERE rank <= 3 GROUP BY area, key")
def exceptions_top3(spark: SparkSession, sf: str) -> DataFrame:
    return slots.exceptions(by_file(star.files_counted(spark, sf)))


@query("WITH t AS (SELECT l_shipdate::DATE AS day, count(DISTINCT l_suppkey) FILTER (WHERE l_suppkey % 7 <> 0) AS authors FROM lineitem GROUP BY 1) SELECT day::VARCHAR AS day, authors, least(greatest(authors, 1), 2)::BIGINT AS required FROM t")
def repo_authors_required(spark: SparkSession, sf: str) -> DataFrame:
    items = star.read(spark, sf, "lineitem").select(F.to_date("l_shipdate").cast("string").alias("day"), "l_suppkey")
    t = items.groupBy("day").agg(F.count_distinct(F.when(F.col("l_suppkey") % 7 != 0, F.col("l_suppkey"))).alias("authors"))
    return t.withColumn("required", stats.authors_required(F.col("authors")))


_FINDINGS_SQL = f"""{JUDGED_SQL},
findings AS (SELECT l_orderkey AS rel, l_linenumber AS line, CASE WHEN l_linenumber = 7 THEN NULL ELSE j.key END AS key, j.area, CASE WHEN l_linenumber = 7 THEN NULL ELSE states END AS states, l_suppkey % 11 = 0 AS dropped, l_suppkey % 13 = 0 AS stale, l_suppkey % 17 <> 0 AS has_base,
  CASE WHEN j.key IN ('discount_cap', 'tax_cap') THEN 'precise' ELSE 'partial' END AS precision, l_quantity > 49 AS listed, l_suppkey % 19 <> 0 AS pinned, borrowed, {_OWN} AS bound, conforming, candidates
  FROM lineitem JOIN files ON l_orderkey = rel JOIN judged j ON files.area = j.area WHERE l_discount > 0.09 AND j.key IN ('discount_cap', 'quantity_cap'))"""


def _findings(spark: SparkSession, sf: str) -> DataFrame:
    items = star.read(spark, sf, "lineitem").where("l_discount > 0.09").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    there = items.join(star.files(spark, sf).select("rel", "area"), F.col("l_orderkey") == F.col("rel")).join(judged(spark, sf).where(F.col("key").isin("discount_cap", "quantity_cap")), "area")
    supp = lambda n: F.col("l_suppkey") % n
    last = F.col("l_linenumber") == 7
    return there.select("rel", F.col("l_linenumber").alias("line"), F.when(~last, F.col("key")).alias("key"), "area", F.when(~last, F.col("states")).alias("states"), (supp(11) == 0).alias("dropped"), (supp(13) == 0).alias("stale"), (supp(17) != 0).alias("has_base"), F.when(F.col("key").isin("discount_cap", "tax_cap"), "precise").otherwise("partial").alias("precision"), (F.col("l_quantity") > 49).alias("listed"), (supp(19) != 0).alias("pinned"), "borrowed", stats.wilson_lower(F.col("conforming"), F.col("candidates")).alias("bound"), "conforming", "candidates")


_REASON = "CASE " + " ".join(f"WHEN {p} THEN '{name}'" for name, p, _ in gates.SEVERITY) + " ELSE 'clear' END"
_LEVEL = "CASE " + " ".join(f"WHEN {p} THEN '{s}'" for _, p, s in gates.SEVERITY) + " ELSE CASE WHEN rel % 5 = 0 THEN 'FIX' ELSE 'MUST-FIX' END END"


@query(f"WITH {_FINDINGS_SQL} SELECT {_REASON} AS reason, {_LEVEL} AS severity, count(*) AS n FROM findings GROUP BY ALL")
def severity_case(spark: SparkSession, sf: str) -> DataFrame:
    return gates.severity(_findings(spark, sf), F.col("rel") % 5 == 0).groupBy("reason", "severity").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {SLOTS_SQL} SELECT area, key, CASE WHEN applicability % 7 = 0 THEN 'corpus-truncated' WHEN applicability % 5 = 0 THEN 'degraded-semantic' WHEN applicability % 3 = 0 THEN 'population-change' WHEN applicability % 2 = 0 THEN 'learned-moved' END AS block FROM slots")
def block_precedence(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("applicability")
    why = gates.blocked_by(n % 7 == 0, n % 5 == 0, F.when(n % 3 == 0, F.lit("population-change")), n % 2 == 0)
    return slots.slot_counts(by_file(star.files_counted(spark, sf))).select("area", "key", why.alias("block"))


@query(f"WITH {SLOTS_SQL}, {_DIMS_SQL}, d AS (SELECT area, key, count(*) AS lang_files FROM files, dims WHERE list_contains(langs, lang) AND NOT (stripped AND blind) GROUP BY area, key), s AS (SELECT s.key, applicability / lang_files AS share FROM slots s JOIN d ON s.area = d.area AND s.key = d.key) SELECT key, median(share) AS median_share, min(share) AS least, max(share) AS most, median(share) < 0.25 AS flagged FROM s GROUP BY key")
def applicability_audit(spark: SparkSession, sf: str) -> DataFrame:
    there = slots.slot_counts(by_file(star.files_counted(spark, sf))).join(slots.denominators(star.files(spark, sf), dimensions(spark)), slots.SLOT)
    share = there.groupBy("key", (F.col("applicability") / F.col("lang_files")).alias("share")).agg(F.count(F.lit(1)).alias("n"))  # equal shares once
    return share.groupBy("key").agg(F.percentile("share", F.lit(0.5), F.col("n")).alias("median_share"), F.min("share").alias("least"), F.max("share").alias("most")).withColumn("flagged", F.col("median_share") < 0.25)


@query(f"WITH {JUDGED_SQL} SELECT area, key, 1 - conforming / candidates AS headroom, row_number() OVER (ORDER BY 1 - conforming / candidates DESC, area, key) AS rank FROM judged WHERE states = 'claim' AND candidates >= 20 AND key <> 'tax_cap'")
def headroom_rank(spark: SparkSession, sf: str) -> DataFrame:
    some = judged(spark, sf).where("states = 'claim' AND candidates >= 20 AND key <> 'tax_cap'").select("area", "key", (1 - F.col("conforming") / F.col("candidates")).alias("headroom"))
    return numbered(some, [F.desc("headroom"), "area", "key"])


@query(f"WITH {JUDGED_SQL}, l AS (SELECT area, key, 1 + applicability % 4 AS height, sum(1 + applicability % 4) OVER (PARTITION BY area ORDER BY key) AS used FROM judged) SELECT area, key, height, used::BIGINT AS used, used > 6 AS dropped FROM l")
def budget_packing(spark: SparkSession, sf: str) -> DataFrame:
    lines = judged(spark, sf).select("area", "key", (1 + F.col("applicability") % 4).alias("height"))
    return layout.packed(lines, "area", ["key"], "height", 6)


@query(f"WITH {JUDGED_SQL} SELECT count(*) AS total, count(*) FILTER (WHERE states IS NOT NULL) AS stated, count(*) FILTER (WHERE states = 'counter') AS counter, count(*) FILTER (WHERE borrowed) AS borrowed, count(DISTINCT area) AS areas FROM judged")
def scan_summary(spark: SparkSession, sf: str) -> DataFrame:
    return judged(spark, sf).agg(F.count(F.lit(1)).alias("total"), F.count("states").alias("stated"), F.count_if(F.col("states") == "counter").alias("counter"), F.count_if("borrowed").alias("borrowed"), F.count_distinct("area").alias("areas"))


@query(f"WITH {star.AREAS_SQL} SELECT area, substr(sha256(area), 1, 8) AS area_id, substr(sha256(concat_ws(chr(0), area, 'key', 'kind', 'text')), 1, 16) AS fp FROM areas")
def area_ids(spark: SparkSession, sf: str) -> DataFrame:
    return star.areas(spark, sf).select("area", area_id(F.col("area")).alias("area_id"), fingerprint(F.col("area"), F.lit("key"), F.lit("kind"), F.lit("text")).alias("fp"))


@query("WITH t AS (SELECT quality, toxic, count(*) AS n, sum(count(*)) OVER (PARTITION BY toxic) AS total FROM labels GROUP BY quality, toxic) SELECT toxic, sum(n)::BIGINT AS samples, CASE WHEN sum(n) >= 20 AND max(n) / sum(n) >= 0.8 THEN CASE first(quality ORDER BY n DESC, quality) WHEN 1 THEN 'claim' ELSE 'counter' END ELSE 'none' END AS side FROM t GROUP BY toxic")
def default_side_decision(spark: SparkSession, sf: str) -> DataFrame:
    counts = star.read(spark, sf, "labels").groupBy("toxic", "quality").agg(F.count(F.lit(1)).alias("n"))
    t = counts.groupBy("toxic").agg(F.sum("n").alias("samples"), F.min(F.struct(-F.col("n"), "quality")).alias("first"), F.max("n").alias("most"))
    sure = (F.col("samples") >= 20) & (F.col("most") / F.col("samples") >= 0.8)
    return t.select("toxic", "samples", F.when(sure & (F.col("first.quality") == 1), "claim").when(sure, "counter").otherwise("none").alias("side"))


@query("SELECT source, count(*) AS n, count(*) FILTER (WHERE lang = 'en') AS en, count(*) FILTER (WHERE lang = 'de') AS de, count(*) FILTER (WHERE lang NOT IN ('en', 'de')) AS other FROM documents GROUP BY source")
def merge_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of parts of the documents add up: two halves are counted apart and merged by sums."""
    docs = star.read(spark, sf, "documents").select("doc_id", "source", "lang")
    by_half = docs.groupBy("source", F.col("doc_id") % 2).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("lang") == "en").alias("en"), F.count_if(F.col("lang") == "de").alias("de"), F.count_if(~F.col("lang").isin("en", "de")).alias("other"))
    return by_half.groupBy("source").agg(*[F.sum(c).alias(c) for c in ("n", "en", "de", "other")])


@query("WITH m AS (SELECT p_partkey, (p_partkey * 7) % 20000 AS m, p_size FROM part) SELECT p_partkey, CASE WHEN m % 1250 = 625 THEN (m + 1) / 20000::DOUBLE ELSE printf('%.4f', m / 20000::DOUBLE)::DOUBLE END AS tied, CASE WHEN (p_size * 20000) % (p_partkey + 1) = 0 AND (p_size * 20000) // (p_partkey + 1) % 1250 = 625 THEN ((p_size * 20000) // (p_partkey + 1) + 1) / 20000::DOUBLE ELSE printf('%.4f', p_size / (p_partkey + 1)::DOUBLE)::DOUBLE END AS ratio FROM m")
def rounded_ratios(spark: SparkSession, sf: str) -> DataFrame:
    """Doubles at and about decimal ties to four places, by their exact value."""
    part = star.read(spark, sf, "part")
    return part.select("p_partkey", rounded((F.col("p_partkey") * 7 % 20000) / F.lit(20000.0)).alias("tied"), rounded(F.col("p_size") / (F.col("p_partkey") + 1)).alias("ratio"))
