"""The engine: scan a snapshot to slots, pin its population, check a change against what is stated.

    files = Engine(spark).files("/path/to/tree")
    found = Engine(spark).scan(files)
    found.slots.where("states IS NOT NULL").show()
"""

from __future__ import annotations

from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.claims import same_constant
from plumbline.functions.paths import EXTENSIONS, FILENAMES, ancestors, base, directory, language
from plumbline.functions.stats import area_ceiling, wilson_lower
from plumbline.functions.text import area_id, fingerprint, rounded
from plumbline.operators import baseline, check, dimensions, gates, hierarchy, layout, render, slots, verdict
from plumbline.operators.globs import cover
from plumbline.registry import DIMENSIONS, Dimension
from plumbline.sources import files as tree
from plumbline.sources import ledger, lexical, map_sink
from plumbline.tables import stored


#: Lines of an area's text.
LINES = 40


class Base(NamedTuple):
    """The accepted population and what it held: gates read its counts, and today's are printed beside them."""

    slots: DataFrame  # of a scan of the files as they were pinned, in their pinned areas
    population: DataFrame  # area, rel
    renames: DataFrame | None = None  # old, new since the pin
    status: str = "ok"  # or unpinned, unreachable
    changed: DataFrame | None = None  # rel: what the base moved since the pin


class Scan(NamedTuple):
    areas: DataFrame  # area, files, area_id
    owned: DataFrame  # rel, lang, stripped, typed, read, dir, area
    sites: DataFrame  # rel, area, key, line, conforming, class, learned
    slots: DataFrame  # area, key, counts, failed, states, borrowed
    dirs: DataFrame  # dir: the directories of the corpus
    records: DataFrame  # rel, kind: what was read of each file


class Engine:
    def __init__(self, spark: SparkSession, dims: tuple[Dimension, ...] = DIMENSIONS, records: ledger.Ledger | None = None, measure: ledger.Measure | None = None):
        """`records` is a ledger that outlives this engine: files that it holds are not read again. `measure` reads files in
        place of the lexical extractor; its nodes may be those that only a parser gives."""
        self.spark, self.dims, self.ledger = spark, dims, records
        self.measure, self.unseen = measure or ledger.reading(lexical.read), () if measure else lexical.UNSEEN

    def files(self, root: str) -> DataFrame:
        """rel, lang, stripped, bytes, content of the source files below `root`; a file that is too large has no content."""
        kept = tree.scan(self.spark, root).where(F.col("drop_reason").isNull() | (F.col("drop_reason") == "oversize") & F.col("rel").rlike(tree.SOURCE))
        return kept.select("rel", language(F.col("rel")).alias("lang"), F.lit(False).alias("stripped"), F.col("length").alias("bytes"), "content")

    def records(self, files: DataFrame) -> DataFrame:
        """rel, hash, lang, kind, attempts, nodes of each file, read now or before."""
        return (self.ledger or ledger.Ledger(self.spark)).settle(files, self.measure)

    def sites(self, files: DataFrame, nodes: DataFrame | None = None, frameworks: tuple[str, ...] | None = None, records: DataFrame | None = None) -> DataFrame:
        """Sites of all dimensions that apply; `nodes` from a parser, or of `records`, or read from `content`.

        A file that could not be read has none, be it of its name or its companion. Without `frameworks`, those that the
        files' paths show are in use.
        """
        frameworks = tuple(r.framework for r in dimensions.frameworks(files).collect()) if frameworks is None else frameworks
        if nodes is None and records is None:
            records = self.records(files)
        there = stored(ledger.nodes(records), "nodes") if nodes is None else nodes  # several dimensions' plans read them
        read = files if records is None else files.join(records.where("kind = 'ok'").select("rel"), "rel", "left_semi")
        seen = tuple(d for d in self.dims if records is None or d.key not in self.unseen)
        every = dimensions.tree_sites(there, seen).unionByName(dimensions.naming_sites(read)).unionByName(dimensions.pairing_sites(files, self.dims, read))
        return dimensions.placed(dimensions.offered(stored(every, "sites"), files, frameworks, self.dims), there, self.dims)

    def _registry(self) -> DataFrame:
        return self.spark.createDataFrame([(d.key, d.counter, d.learned, bool(d.grouped), list(d.langs), d.blind, d.needs_types, d.precision) for d in self.dims], "key string, has_counter boolean, is_learned boolean, is_grouped boolean, langs array<string>, blind boolean, needs_types boolean, precision string")

    def _settled(self, sites: DataFrame) -> DataFrame:
        """Sites with `conforming` decided: a learned dimension's by its area's class; slots with a tied vote are gone.

        A dimension that splits its files learns from the kind that most of an area's files with sites are, and the other
        kind's sites are gone; so is the site of the very class that an area learned.
        """
        registry = F.broadcast(self._registry().select("key", "is_learned", "is_grouped"))
        most = slots.majority_kind(sites.where("kind IS NOT NULL").select("area", "key", "rel", "kind").distinct(), ["area", "key"], "kind", "module")
        sites = sites.join(most.select("area", "key", F.col("kind").alias("_kind")), slots.SLOT, "left").where("kind IS NULL OR kind = _kind").drop("_kind")
        there = sites.join(registry, "key").withColumn("body", F.when(F.col("is_grouped"), F.concat_ws("#", "rel", F.coalesce("grp", "pre"))))
        votes = slots.learned(there.where("is_learned"), ["area", "key"], group="body").where("learned IS NOT NULL").select("area", "key", "learned")
        plain = there.where("NOT is_learned").withColumn("learned", F.lit(None).cast("string"))
        learned = there.where("is_learned").join(votes, ["area", "key"]).where("self IS NULL OR self <> learned").withColumn("conforming", same_constant(F.col("class"), F.col("learned"), F.col("nesting")))
        single = learned.where("body IS NULL").select(plain.columns)
        bodies = learned.where("body IS NOT NULL").groupBy("area", "key", "rel", "body", "dir", "learned", "kind").agg(F.bool_or("conforming").alias("conforming"), F.min("line").alias("line"), F.min("class").alias("class"))
        keep = ["area", "key", "rel", "dir", "line", "conforming", "class", "learned", "kind"]
        return plain.select(keep).unionByName(single.select(keep)).unionByName(bodies.select(keep))

    def scan(self, files: DataFrame, nodes: DataFrame | None = None, authors: DataFrame | None = None, frameworks: tuple[str, ...] | None = None, min_files: Column | None = None, pinned: DataFrame | None = None, blocked: DataFrame | None = None, base: Base | None = None, truncated: bool = False) -> Scan:
        """`files` has rel, lang, stripped and, without `nodes`, content; `authors` has rel and author.

        With `pinned` (area, rel), only its files are counted, in its areas: gates read the accepted population. Slots of
        areas in `blocked` (area) lend nothing to the pool and state nothing. A file that could not be read belongs to its
        area and counts for no dimension: no slot has it among the files that it divides by.

        With `base`, a slot is judged by the counts that it had there, in the area that its own was, through renames. A slot
        newer than the base, one whose learned class moved, one of an area that changed its population, and every slot of
        a corpus that was read in part (`truncated`) states nothing, lends nothing and fails for that reason.
        """
        types = F.col("rel").rlike(r"[.](cts|mts|ts|tsx)$")
        typed = types if "typed" not in files.columns else types | F.col("typed")
        records = self.records(files) if nodes is None else None
        nodes_ = nodes if records is None else stored(ledger.nodes(records), "nodes")  # several dimensions' plans read them
        outcome = files.select("rel", F.lit("ok").alias("kind")) if records is None else records.select("rel", "kind")
        placed = files.select("rel", "lang", "stripped", typed.alias("typed"), directory(F.col("rel")).alias("dir")).join(outcome, "rel", "left").withColumn("read", F.coalesce(F.col("kind") == "ok", F.lit(False))).drop("kind").join(dimensions.file_kinds(nodes_), "rel", "left").fillna("module", ["kind"])
        if pinned is None:
            areas = stored(hierarchy.discover(placed, min_files), "discovered")
            most = placed.agg(area_ceiling(F.count(F.lit(1)))).first()[0]
            if areas.count() > most:  # a tree of very many: the smallest fold upwards, by one task over a row a directory
                areas = hierarchy.folded(areas.withColumn("tree", F.lit("")), most).where("area IS NOT NULL").select("area", "files")
            owners = hierarchy.deepest(placed.select(F.col("dir").alias("path")), areas).where("owner IS NOT NULL").select(F.col("path").alias("dir"), F.col("owner").alias("area"))
            owned = placed.join(owners, "dir")
        else:
            owned = placed.join(pinned.select("rel", "area"), "rel")
            areas = owned.groupBy("area").agg(F.count(F.lit(1)).alias("files"))
        owned = stored(owned, "owned")
        sites = stored(self._settled(stored(self.sites(files, nodes_, frameworks, records).join(owned.select("rel", "area", "dir"), "rel"), "placed")), "settled")
        registry = self._registry()
        learned = sites.where("learned IS NOT NULL").select("area", "key", "learned", "kind").distinct()
        counted = slots.slot_counts(slots.file_counts(sites)).join(slots.denominators(owned.where("read"), registry.select("key", "langs", "blind", "needs_types"), learned.where("kind IS NOT NULL")), slots.SLOT, "left").fillna(0, ["lang_files"])
        who = sites.select("area", "key", "rel", "dir").distinct()
        who = who.withColumn("author", F.lit(None).cast("string")) if authors is None else who.join(authors.where(~F.col("author").contains("[bot]")).select("rel", "author"), "rel", "left")
        full = counted.join(slots.spread(who, owned), slots.SLOT).join(learned, slots.SLOT, "left").join(F.broadcast(registry.select("key", "has_counter", "precision")), "key")
        repo = (self.spark.range(1).select(F.lit(0).cast("long").alias("repo_authors")) if authors is None else authors.where(~F.col("author").contains("[bot]")).agg(F.count_distinct("author").alias("repo_authors")))
        stop = (blocked if blocked is not None else areas.where("false")).select("area", F.lit(True).alias("_blocked")).distinct()
        open_ = full.crossJoin(F.broadcast(repo)).join(stop, "area", "left").withColumn("blocked", F.coalesce("_blocked", F.lit(False))).drop("_blocked")
        there = self._based(open_, owned, base, truncated)
        judged = gates.judged(slots.pooled(stored(there, "open"), ["key", "learned", "kind"], F.col("blocked")), F.lit(authors is not None))
        judged = judged.withColumns({"states": F.when(~F.col("blocked"), F.col("states")), "failed": F.coalesce("block", "failed"), "counter_failed": F.coalesce("block", "counter_failed")})
        dirs = stored(placed.select("dir").distinct(), "dirs")
        return Scan(stored(areas.withColumn("area_id", area_id(F.col("area"))), "areas"), owned, sites, stored(judged, "slots"), dirs, outcome)

    def _based(self, open_: DataFrame, owned: DataFrame, base: Base | None, truncated: bool) -> DataFrame:
        """Slots with the counts that gates read, block, has_base, now_candidates and now_conforming; `blocked` follows block."""
        if base is None or base.status != "ok":
            same = {"now_candidates": F.col("candidates"), "now_conforming": F.col("conforming"), "has_base": F.lit(base is None), "learned_moved": F.lit(False)}
            gate = F.when(F.lit(base is not None and base.status == "unreachable"), "unreachable")
            there = open_.withColumns(same | {"_gate": gate})
        else:
            renames = self.spark.createDataFrame([], "old string, new string") if base.renames is None else base.renames
            match = stored(baseline.matched(base.population, owned.select("area", "rel"), renames, base.status), "matched")
            then = base.slots.withColumnRenamed("area", "pinned_area").join(match.where("pinned_area IS NOT NULL").select("area", "pinned_area"), "pinned_area")
            there = verdict.read_counts(open_, then).join(match.select("area", "gate"), "area", "left")
            there = there.withColumn("_gate", F.coalesce("gate", F.when(~F.col("has_base"), "postdates-baseline"))).drop("gate")
        block = gates.blocked_by(F.lit(truncated), F.lit(False), F.col("_gate"), F.col("learned_moved"))
        return there.withColumn("block", block).withColumn("blocked", F.col("blocked") | F.col("block").isNotNull()).drop("_gate")

    def stale(self, found: Scan, base: Base) -> bool:
        """Whether the map of a scan is stale: without a pin, or with one that the base has left behind."""
        return baseline.stale_map(found.owned, base.changed, base.status).first()[0] is not None

    def caveats(self, found: Scan, head: DataFrame, base: DataFrame | None) -> DataFrame:
        """code, files, message of what a check of the files `head` against `base` leaves unanswered."""
        before = None if base is None else self.records(base).select("rel", "kind")
        return check.caveats(self.records(head).select("rel", "kind"), before, found.slots.where("states IS NOT NULL"))

    def pin(self, found: Scan, before: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """(the population as area and rel; what changed since `before`). No counts are kept."""
        now = found.owned.select("area", "rel")
        return now, baseline.pin_delta(now.limit(0) if before is None else before, now)

    def globs(self, found: Scan) -> DataFrame:
        """area, dir, deep, negated, exts, names: globs that reach each area's files and no other area's.

        An area's directories are worked through by one task, areas by as many as there are.
        """
        below = found.dirs.select("dir", F.explode(ancestors(F.col("dir"))).alias("area")).join(found.areas.select("area"), "area")
        own = found.owned.groupBy("area", "dir").agg(F.collect_set("lang").alias("langs"), F.collect_set(F.when(base(F.col("rel")).isin(*FILENAMES), base(F.col("rel")))).alias("names"))
        exts = {lang: [e for e, known in EXTENSIONS.items() if known == lang] for lang in set(EXTENSIONS.values())}

        def covered(table: pa.Table) -> pa.Table:
            area, dirs, langs, names = table["area"][0].as_py(), *(table[c].to_pylist() for c in ("dir", "langs", "names"))
            mine = {d for d, x in zip(dirs, langs, strict=True) if x is not None}
            found = cover(mine, set(dirs), area)
            kinds = sorted({e for x in langs if x for lang in x for e in exts.get(lang, [])})
            bare = sorted({n for x in names if x for n in x})
            return pa.table({"area": [area] * len(found), "dir": [g.dir for g in found], "deep": [g.deep for g in found], "negated": [g.negated for g in found], "exts": pa.array([kinds] * len(found), pa.list_(pa.string())), "names": pa.array([bare] * len(found), pa.list_(pa.string()))})

        return below.join(own, ["area", "dir"], "left").groupBy("area").applyInArrow(covered, "area string, dir string, deep boolean, negated boolean, exts array<string>, names array<string>")

    def told(self, found: Scan, budget: int = LINES) -> DataFrame:
        """area, key, from_area and what holds there: states, side, learned, borrowed, precision, the side's conforming of
        candidates, and dropped: whether the area's lines had no room for it.

        A dimension that an area does not hold is answered by the nearest area above that states it.
        """
        sided = gates.sided(found.slots)
        blocks = sided.where("states IS NOT NULL").withColumn("height", F.lit(2) + (F.col("side_conforming") < F.col("candidates")).cast("int"))
        dropped = layout.settled(blocks.select("area", "key", "candidates", "height"), "area", [F.desc("candidates"), "key"], "height", budget).where("NOT kept").select("area", "key", F.lit(True).alias("_dropped"))
        sides = ("states", "side", "learned", F.col("kind").alias("slot_kind"), F.col("has_base").alias("slot_has_base"), "borrowed", "precision", F.col("side_conforming").alias("conforming"), "candidates")
        own = sided.join(dropped, ["area", "key"], "left").select("area", "key", F.col("area").alias("from_area"), F.coalesce("_dropped", F.lit(False)).alias("dropped"), *sides)
        above = hierarchy.nearest_stating(found.slots, found.areas).join(found.slots.select("area", "key"), ["area", "key"], "left_anti")
        return own.unionByName(above.join(sided.withColumnRenamed("area", "from_area"), ["from_area", "key"]).select("area", "key", "from_area", F.lit(False).alias("dropped"), *sides))

    def _broken(self, sites: DataFrame, owners: DataFrame, told: DataFrame) -> DataFrame:
        """Sites against what their area was told; of a body's sites that count as one, the first. Sites outside all areas stay
        where their dimension has a predicate of its own; an omission is one only where the claim is stated."""
        registry = F.broadcast(self._registry().select("key", "is_learned", "is_grouped"))
        there = sites.join(owners, "rel").join(told, ["area", "key"], "left").join(registry, "key")
        fits = F.when(F.col("is_learned"), same_constant(F.col("class"), F.col("learned"), F.col("nesting"))).otherwise(F.col("conforming_here"))
        omitted = F.col("is_learned") & F.col("class").isNull()
        there = there.where("area IS NULL AND NOT is_learned OR from_area IS NOT NULL").where("(kind IS NULL OR kind <=> slot_kind) AND (self IS NULL OR learned IS NULL OR self <> learned)").withColumns({"fits": fits, "omitted": omitted, "body": F.when(F.col("is_grouped"), F.concat_ws("#", "rel", F.coalesce("grp", "pre")))})
        single = there.where("body IS NULL")
        carried = [c for c in there.columns if c not in ("nesting", "self", "kind", "body", "fits", "omitted", "line", "class", "pre", "grp", "conforming_here", "rel", "key")]
        bodies = there.where("body IS NOT NULL").groupBy("rel", "key", "body").agg(F.bool_or("fits").alias("fits"), F.bool_and("omitted").alias("omitted"), F.min("line").alias("line"), F.min("class").alias("class"), *[F.first(c).alias(c) for c in carried])
        keep = ["rel", "key", "line", "class", "fits", "omitted", *carried]
        every = single.select(keep).unionByName(bodies.select(keep))
        return every.where(F.col("fits") == (F.coalesce("side", F.lit("claim")) == "counter")).where("NOT (omitted AND states IS NULL)")

    def check(self, found: Scan, head: DataFrame, base: DataFrame, renames: DataFrame | None = None, added: DataFrame | None = None, pinned: bool = False, stale: bool = False, has_base: bool = True, budget: int = LINES) -> DataFrame:
        """rel, line, area, from_area, key, severity, reason, states: what `head` breaks beyond `base`, of what `found` stated.

        `head` and `base` are sites of changed files as `sites` gives them, before and after; `found` is the scan of the pinned
        population. `renames` has old and new paths; both sides are fingerprinted under the old one, so that a moved file
        forges nothing. With `added` (path, low, high), for want of a base, findings on added lines are the new ones.
        """
        rels = head.select("rel").union(base.select("rel")).distinct().withColumn("dir", directory(F.col("rel")))
        homes = hierarchy.deepest(rels.select(F.col("dir").alias("path")), found.areas)
        owners = stored(rels.join(homes.select(F.col("path").alias("dir"), F.col("owner").alias("area")), "dir", "left").select("rel", "area"), "owners")
        told = stored(self.told(found, budget), "told")
        was = owners.select("rel").withColumn("old", F.col("rel")) if renames is None else owners.select("rel").join(renames.select(F.col("new").alias("rel"), "old"), "rel", "left").withColumn("old", F.coalesce("old", "rel"))
        mark = fingerprint(F.col("old"), F.col("key"), F.coalesce("class", F.lit("")), F.coalesce("learned", F.lit("")))
        side = lambda sites, paths: self._broken(sites.withColumnRenamed("conforming", "conforming_here"), owners, told).join(paths, "rel").withColumn("fp", mark)
        now = side(head, was)
        if added is not None:
            fresh = check.on_added_lines(now.withColumnRenamed("rel", "path"), added).withColumnRenamed("path", "rel")
        else:
            fresh = check.introduced(now, side(base, owners.select("rel").withColumn("old", F.col("rel"))), "fp", ["line"])
        counted = slots.file_counts(found.sites).join(told.select("area", "key", "side"), slots.SLOT)
        bad = counted.withColumn("bad", F.when(F.col("side") == "counter", F.col("conforming")).otherwise(F.col("candidates") - F.col("conforming")))
        exceptions = slots.listed(bad).select("area", "key", F.col("rel").alias("old"), F.lit(True).alias("_listed"))
        delivered = hierarchy.reach(fresh.select(F.col("rel").alias("path")), self.globs(found)).where("reached").select(F.col("path").alias("rel"), "area", F.lit(True).alias("_reached"))
        state = fresh.join(exceptions, ["area", "key", "old"], "left").join(delivered, ["rel", "area"], "left")
        state = state.withColumns({"dimension": F.col("key"), "key": F.when(F.col("area").isNotNull(), F.col("key")), "stale": F.lit(stale), "has_base": F.lit(has_base) & F.coalesce("slot_has_base", F.lit(True)), "listed": F.coalesce("_listed", F.lit(False)), "pinned": F.lit(pinned), "bound": wilson_lower(F.col("conforming"), F.col("candidates"))})
        level = gates.severity(state)
        inherited = F.coalesce(F.col("from_area") != F.col("area"), F.lit(False))
        away = (F.col("severity") == "MUST-FIX") & F.col("_reached").isNull()
        reason = F.when(inherited, "counted-above").when(away, "not-delivered").otherwise(F.col("reason"))
        severity = F.when(inherited | away, "FIX").otherwise(F.col("severity"))
        return level.select("rel", "line", "area", "from_area", F.col("dimension").alias("key"), severity.alias("severity"), reason.alias("reason"), "states", "fp")


def facts(found: Scan) -> DataFrame:
    """area, json: each area with its slots as one JSON record, floats to four places; written as text, one line an area."""
    slot = F.struct("key", "states", "failed", "borrowed", "applicability", "candidates", "conforming", rounded(F.col("conforming") / F.col("candidates")).alias("ratio"))
    by_area = found.slots.groupBy("area").agg(F.array_sort(F.collect_list(slot)).alias("dimensions"))  # a slot a dimension of the registry
    return by_area.join(found.areas, "area").select("area", F.to_json(F.struct("area", "area_id", "files", "dimensions")).alias("json"))


def rendered(found: Scan, budget: int = LINES, defaults: DataFrame | None = None) -> DataFrame:
    """area, text: what each area states and counts, in as many lines as `budget` allows. Claims that `defaults` (key,
    default_side, default_class) has as a model's own are counts."""
    slots = found.slots.withColumn("matches_default", F.lit(False))
    if defaults is not None:
        same = F.when(F.col("learned").isNotNull(), F.col("learned") == F.col("default_class")).otherwise(F.col("states") == F.col("default_side"))
        slots = found.slots.join(F.broadcast(defaults.select("key", "default_side", "default_class")), "key", "left").withColumn("matches_default", F.coalesce(same, F.lit(False)))
    return render.texts(render.area_lines(slots, budget), "area")


def write_map(found: Scan, root: str, budget: int = LINES) -> list[str]:
    """Write each area's text below `root`, a file each, and give the names of the map as it is now.

    Tasks write the texts; only names pass through the driver. Files of areas that are gone are removed if an earlier run
    wrote them. A run that read no file of a language which has some is blind, and writes and removes nothing.
    """
    known = found.records.join(found.owned.select("rel", "lang"), "rel")
    blind = not known.groupBy("lang").agg(F.count_if(F.col("kind") == "ok").alias("read")).where("read = 0").isEmpty()
    texts = rendered(found, budget).join(found.areas.select("area", "area_id"), "area")
    files = texts.select(F.concat("area_id", F.lit(".md")).alias("name"), F.concat(F.lit("# "), "area", F.lit("\n\n"), "text", F.lit("\n")).alias("text"))
    return map_sink.write(found.slots.sparkSession, files, root, blind)
