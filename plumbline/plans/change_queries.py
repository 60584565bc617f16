"""Queries over snapshots, renames, findings and sequences of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import baseline, check, sessions
from plumbline.plans.registry import query
from plumbline.sources import star
from plumbline.streaming import windows

_CUT = "TIMESTAMP '2001-01-01'"
#: Two snapshots of the orders: what was there before a day, and what is there now; a customer is an area.
_SNAPS_SQL = f"pinned AS (SELECT o_custkey % 40 AS area, o_orderkey AS rel FROM orders WHERE o_orderdate < {_CUT}), cur AS (SELECT o_custkey % 40 + (CASE WHEN o_orderkey % 31 = 0 THEN 3 ELSE 0 END) AS area, o_orderkey + (CASE WHEN o_orderkey % 10 = 0 THEN 100000000 ELSE 0 END) AS rel FROM orders WHERE o_orderkey % 7 <> 0 AND o_custkey % 40 <> 5), renames AS (SELECT o_orderkey AS old, o_orderkey + 100000000 AS new FROM orders WHERE o_orderkey % 20 = 0)"


def _snapshots(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    orders = star.read(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    key, area = F.col("o_orderkey"), F.col("o_custkey") % 40
    pinned = orders.where(F.col("o_orderdate") < F.expr(_CUT)).select(area.alias("area"), key.alias("rel"))
    moved = (area + F.when(key % 31 == 0, 3).otherwise(0)).alias("area"), (key + F.when(key % 10 == 0, 100_000_000).otherwise(0)).alias("rel")
    current = orders.where((key % 7 != 0) & (area != 5)).select(*moved)
    renames = orders.where(key % 20 == 0).select(key.alias("old"), (key + 100_000_000).alias("new"))
    return pinned, current, renames


@query(f"WITH {_SNAPS_SQL}, b AS (SELECT coalesce(p.area, c.area) AS area, p.rel AS old, c.rel AS new FROM pinned p FULL JOIN cur c ON p.area = c.area AND p.rel = c.rel), t AS (SELECT area, count(old) AS old_files, count(new) AS new_files, count(*) FILTER (WHERE old IS NULL) AS added, count(*) FILTER (WHERE new IS NULL) AS removed FROM b GROUP BY area) SELECT *, CASE WHEN old_files = 0 THEN 'new' WHEN new_files = 0 THEN 'gone' WHEN added > 0 OR removed > 0 THEN 'changed' ELSE 'same' END AS change FROM t")
def pin_delta(spark: SparkSession, sf: str) -> DataFrame:
    pinned, current, _ = _snapshots(spark, sf)
    return baseline.pin_delta(pinned, current)


@query(f"""WITH {_SNAPS_SQL}, m AS (SELECT c.area, coalesce(r.old, c.rel) AS rel FROM cur c LEFT JOIN renames r ON c.rel = r.new), o AS (SELECT m.area, p.area AS pinned_area, count(*) AS overlap FROM m JOIN pinned p ON m.rel = p.rel GROUP BY ALL),
b AS (SELECT area, first(pinned_area ORDER BY overlap DESC, pinned_area) AS pinned_area, max(overlap) AS overlap FROM o GROUP BY area)
SELECT s.area, b.pinned_area, coalesce(b.overlap, 0) AS overlap, coalesce(p.n - b.overlap, 0) AS missing, s.n - coalesce(b.overlap, 0) AS added
FROM (SELECT area, count(*) AS n FROM cur GROUP BY area) s LEFT JOIN b ON s.area = b.area LEFT JOIN (SELECT area, count(*) AS n FROM pinned GROUP BY area) p ON b.pinned_area = p.area""")
def population_match(spark: SparkSession, sf: str) -> DataFrame:
    return baseline.population_match(*_snapshots(spark, sf))


_RENAMES_SQL = "renames AS (SELECT event_id AS seq, 'f' || user_id || '_' || (event_id // 7 % 5) AS old, 'f' || user_id || '_' || ((event_id // 7 + 1 + event_id % 3) % 5) AS new FROM events WHERE event_type = 'click')"


@query(f"""WITH RECURSIVE {_RENAMES_SQL}, moves AS (SELECT r.seq, r.old, r.new, min(n.seq) AS next_seq FROM renames r LEFT JOIN renames n ON n.old = r.new AND n.seq > r.seq AND n.old <> n.new WHERE r.old <> r.new GROUP BY r.seq, r.old, r.new),
chain AS (SELECT seq, old AS path, new AS name, next_seq, 1 AS hops FROM moves UNION ALL SELECT c.seq, c.path, m.new, m.next_seq, c.hops + 1 FROM chain c JOIN moves m ON c.next_seq = m.seq WHERE c.hops < 64)
SELECT seq, path, max_by(name, hops) AS name, max(hops) AS hops FROM chain GROUP BY seq, path""")
def rename_chains(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("event_id")
    file = lambda k: F.concat(F.lit("f"), F.col("user_id").cast("string"), F.lit("_"), (k % 5).cast("string"))
    events = star.read(spark, sf, "events").where("event_type = 'click'")
    part = F.floor(n / 7)
    return baseline.resolved(events.select(n.alias("seq"), file(part).alias("old"), file(part + 1 + n % 3).alias("new")))


@query("WITH m AS (SELECT o_orderpriority AS area, o_orderkey AS rel FROM orders), c AS (SELECT DISTINCT l_orderkey AS rel FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-06-01'), t AS (SELECT area, count(*) AS mapped, count(c.rel) AS changed FROM m LEFT JOIN c ON m.rel = c.rel GROUP BY area) SELECT area, mapped, changed, changed / mapped AS share, changed / mapped >= 0.25 AS stale FROM t")
def drift_share(spark: SparkSession, sf: str) -> DataFrame:
    mapped = star.read(spark, sf, "orders").select(F.col("o_orderpriority").alias("area"), F.col("o_orderkey").alias("rel"))
    changed = star.read(spark, sf, "lineitem").where("l_shipdate >= TIMESTAMP '2001-06-01'").select(F.col("l_orderkey").alias("rel"))
    return baseline.drift(mapped, changed)


@query("WITH s AS (SELECT n_nationkey AS id, n_nationkey % 6 <> 1 AS has_map, n_nationkey % 5 = 0 AS truncated, CASE n_nationkey % 4 WHEN 0 THEN 'unpinned' WHEN 1 THEN 'unreachable' ELSE 'ok' END AS status, (n_nationkey % 8)::BIGINT AS mapped, (n_nationkey % 3)::BIGINT AS changed FROM nation) SELECT id, CASE WHEN NOT has_map THEN 'no map' WHEN truncated THEN 'truncated' WHEN status = 'unpinned' THEN 'unpinned' WHEN status = 'unreachable' THEN 'unreachable' WHEN mapped = 0 THEN 'empty' WHEN changed / mapped >= 0.25 THEN 'drifted' END AS reason FROM s")
def staleness_reason(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("n_nationkey")
    status = F.when(n % 4 == 0, "unpinned").when(n % 4 == 1, "unreachable").otherwise("ok")
    states = star.read(spark, sf, "nation").select(n.alias("id"), (n % 6 != 1).alias("has_map"), (n % 5 == 0).alias("truncated"), status.alias("status"), (n % 8).cast("long").alias("mapped"), (n % 3).cast("long").alias("changed"))
    return baseline.staleness(states).select("id", "reason")


@query("WITH h AS (SELECT doc_id, md5(text) AS fp, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS nth FROM documents WHERE doc_id % 2 = 0), b AS (SELECT md5(text) AS fp, count(*) AS n FROM documents WHERE doc_id % 2 = 1 GROUP BY 1) SELECT doc_id, h.fp FROM h LEFT JOIN b ON h.fp = b.fp WHERE nth > coalesce(n, 0)")
def new_findings_multiset(spark: SparkSession, sf: str) -> DataFrame:
    found = star.read(spark, sf, "documents").select("doc_id", F.md5("text").alias("fp"))
    return check.introduced(found.where("doc_id % 2 = 0"), found.where("doc_id % 2 = 1"), "fp", ["doc_id"])


@query("WITH r AS (SELECT o_custkey AS path, o_orderkey % 200 AS low, o_orderkey % 200 + o_custkey % 90 AS high FROM orders WHERE o_orderkey % 3 = 0) SELECT o_orderkey AS id, o_custkey AS path, o_orderkey % 300 AS line FROM orders f WHERE EXISTS (SELECT 1 FROM r WHERE r.path = f.o_custkey AND f.o_orderkey % 300 BETWEEN low AND high)")
def added_range_semi(spark: SparkSession, sf: str) -> DataFrame:
    orders = star.read(spark, sf, "orders").select("o_orderkey", "o_custkey")
    key = F.col("o_orderkey")
    ranges = orders.where(key % 3 == 0).select(F.col("o_custkey").alias("path"), (key % 200).alias("low"), (key % 200 + F.col("o_custkey") % 90).alias("high"))
    return check.on_added_lines(orders.select(key.alias("id"), F.col("o_custkey").alias("path"), (key % 300).alias("line")), ranges)


@query("WITH c AS (SELECT o_orderkey AS rel, o_orderstatus AS state FROM orders WHERE o_orderkey % 4 <> 3), p AS (SELECT o_orderkey AS rel, 'pending' AS state, o_orderkey % 12 = 0 AS deleted FROM orders WHERE o_orderkey % 6 = 0) SELECT rel, state FROM c WHERE rel NOT IN (SELECT rel FROM p) UNION ALL SELECT rel, state FROM p WHERE NOT deleted")
def pending_overlay(spark: SparkSession, sf: str) -> DataFrame:
    orders = star.read(spark, sf, "orders")
    committed = orders.where("o_orderkey % 4 <> 3").select(F.col("o_orderkey").alias("rel"), F.col("o_orderstatus").alias("state"))
    pending = orders.where("o_orderkey % 6 = 0").select(F.col("o_orderkey").alias("rel"), F.lit("pending").alias("state"), (F.col("o_orderkey") % 12 == 0).alias("deleted"))
    return check.overlaid(committed, pending, "rel")


_EVENTS_SQL = """e AS (SELECT user_id AS session, event_id AS ord, CASE WHEN event_type = 'error' THEN 'compact' ELSE 'delivery' END AS kind, (value::BIGINT % 10)::VARCHAR AS path FROM events),
c AS (SELECT *, sum((kind = 'compact')::INT) OVER (PARTITION BY session ORDER BY ord)::BIGINT AS compacts FROM e),
d AS (SELECT session, ord, path, compacts, lag(compacts) OVER (PARTITION BY session, path ORDER BY ord) AS before FROM c WHERE kind = 'delivery'),
r AS (SELECT session, ord, path, compacts, before IS NOT NULL AS seen_before, coalesce(compacts > before, false) AS after_compact FROM d)"""


def _deliveries(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "compact").otherwise("delivery")
    return star.read(spark, sf, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("ord"), kind.alias("kind"), (F.bround("value").cast("long") % 10).cast("string").alias("path"))


@query(f"WITH {_EVENTS_SQL} SELECT * FROM r")
def session_repeats(spark: SparkSession, sf: str) -> DataFrame:
    return sessions.repeats(_deliveries(spark, sf))


@query(f"""WITH {_EVENTS_SQL}, s AS (SELECT session, count(*) AS deliveries, count(*) FILTER (WHERE seen_before) AS repeats, count(*) FILTER (WHERE after_compact) AS after, min(compacts) AS first FROM r GROUP BY session), a AS (SELECT session, count(*) FILTER (WHERE kind = 'compact') AS compacts FROM e GROUP BY session)
SELECT count(*) AS sessions, count(deliveries) AS sessions_with_delivery, coalesce(sum(deliveries), 0)::BIGINT AS deliveries, coalesce(sum(repeats), 0)::BIGINT AS repeats, coalesce(sum(after), 0)::BIGINT AS repeats_after_compact, count(*) FILTER (WHERE compacts > first) AS sessions_compacted_after_delivery, count(*) FILTER (WHERE after > 0) AS sessions_reloaded_after_compact FROM a LEFT JOIN s ON a.session = s.session""")
def session_summary(spark: SparkSession, sf: str) -> DataFrame:
    return sessions.summary(_deliveries(spark, sf))


@query("SELECT strftime(time_bucket(INTERVAL '6 hours', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS candidates, count(*) FILTER (WHERE value <= 20) AS conforming FROM events GROUP BY ALL")
def stream_window_slots(spark: SparkSession, sf: str) -> DataFrame:
    """The batch run of the plan that tests/test_streaming.py runs over a stream."""
    counted = windows.windowed_counts(star.read(spark, sf, "events"), "event_type", F.col("value") <= 20, "6 hours")
    return counted.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@query("WITH w AS (SELECT event_type, value, unnest([time_bucket(INTERVAL '2 hours', ts), time_bucket(INTERVAL '2 hours', ts) - INTERVAL '2 hours']) AS s FROM events) SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS candidates, count(*) FILTER (WHERE value <= 20) AS conforming FROM w GROUP BY ALL")
def stream_sliding_slots(spark: SparkSession, sf: str) -> DataFrame:
    counted = windows.windowed_counts(star.read(spark, sf, "events"), "event_type", F.col("value") <= 20, "4 hours", "2 hours")
    return counted.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@query("WITH o AS (SELECT *, coalesce(ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '3 hours', true)::INT AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM o) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS candidates, count(*) FILTER (WHERE value <= 20) AS conforming FROM s GROUP BY user_id, n")
def stream_session_slots(spark: SparkSession, sf: str) -> DataFrame:
    counted = windows.session_counts(star.read(spark, sf, "events"), "user_id", F.col("value") <= 20, "3 hours")
    return counted.select("user_id", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "candidates", "conforming")
