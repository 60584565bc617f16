"""Personal data by bootstrapped contextual extraction, in DataFrame functions throughout.

1. Base patterns find e-mail addresses, IP addresses, card and phone numbers with their code-point spans.
2. These seed entities induce lexical patterns: the word before, the two words before, and the words on both sides,
   however far away. Of a word of over WORD characters, the WORD nearest to the mention stand for it; two words make a
   pattern only where the nearer one is no longer than that.
3. Patterns and instances (surface forms, seeds and other identifier-shaped strings alike) form a bipartite graph. Each
   round scores a pattern by the mean score of its instances and a form that is no seed by the mean of its patterns.
4. Patterns that keep a high score and were induced by several seeds mark unseen identifiers whose shape fits the kind.

Positions come without any Python: a text split by a pattern gives the gaps between its matches, and running sums of
the lengths of gaps and matches are the spans. A text with mentions is also cut into blocks of BLOCK characters, so that
what stands at a place is read from there and not from the text's start, and folds over a text's mentions run in chunks
(`running`): the work grows with the text's length, but for the root of its number of mentions. The patterns are written so that a run of characters is read once:
a run is entered at its first character only, and quantifiers that nothing needs to give back from are possessive.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import common

KINDS = ("email", "ip", "card", "phone")
_LOCAL = r"A-Za-z0-9._%+-"
#: Same matches as the plain patterns of the contract; see the module on how they are written.
PATTERNS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Identifier-shaped strings: groups of digits, tokens around an at sign, groups of hexadecimal digits.
CANDIDATE = r"(?<![0-9A-Za-z(])\(?[0-9][0-9().\x20-]*[0-9](?![0-9A-Za-z])|(?<![^\x20\x09-\x0D])[^@\x20\x09-\x0D]++@[^\x20\x09-\x0D]++|(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){3,7}(?![0-9A-Za-z:])"
_BLANK = r"\x20\x09-\x0D"
#: The last word of a text, its last two words, and its first word.
_ONE = rf"(?<![^{_BLANK}])([^{_BLANK}]++)[{_BLANK}]*+\z"
_TWO = rf"(?<![^{_BLANK}])([^{_BLANK}]++)[{_BLANK}]++[^{_BLANK}]++[{_BLANK}]*+\z"
_NEXT = rf"^[{_BLANK}]*+([^{_BLANK}]++)"
#: A longer context word stands in a pattern by the hash of the whole of it.
WORD = 256
BLOCK = 256
ROUNDS = 3
MIN_SCORE = 0.6
MIN_SEEDS = 3


def _digits(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^0-9]", ""))


def _luhn(card: Column) -> Column:
    """Whether a string's digits pass the Luhn check."""
    digits = F.split(F.reverse(F.regexp_replace(card, "[^0-9]", "")), "")
    doubled = F.transform(F.filter(digits, lambda d: d != ""), lambda d, i: (lambda v: F.when(i % 2 == 0, v).when(v > 4, 2 * v - 9).otherwise(2 * v))(d.cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def _octet(part: Column) -> Column:
    value = F.ltrim(part, F.lit("0"))
    return (F.length(value) <= 3) & (F.coalesce(F.substring(F.concat(F.lit("0"), value), -4, 4).cast("int"), F.lit(0)) <= 255)


_HOLDS = {
    "email": lambda hit: F.lit(True),
    "ip": lambda hit: F.forall(F.split(hit, r"\."), _octet),
    "card": lambda hit: _digits(hit).between(13, 19) & _luhn(F.when(_digits(hit).between(13, 19), hit).otherwise("1")),
    "phone": lambda hit: _digits(hit).between(9, 15),
}


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)`, the value computed once."""
    return F.transform(F.array(value), use)[0]


def running(items: Column, begin: Column, step: Callable[[Column, Column], Column], out: str) -> Column:
    """What `step` gives for each item in order: step(state, item) is a struct of the next `state` and of `out`.

    The fold goes over chunks as long as the root of the number of items: no array of all of them grows by one at a time.
    """
    none, no_chunks = F.array().cast(f"array<{out}>"), F.array().cast(f"array<array<{out}>>")

    def over(xs: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(xs))).cast("int")

        def item(s: Column, x: Column) -> Column:
            return _let(step(s["state"], x), lambda r: F.struct(r["state"].alias("state"), F.concat(s["out"], F.array(r["out"])).alias("out")))

        def chunk(s: Column, k: Column) -> Column:
            folded = F.aggregate(F.slice(xs, k * width + 1, width), F.struct(s["state"].alias("state"), none.alias("out")), item)
            return _let(folded, lambda r: F.struct(r["state"].alias("state"), F.concat(s["out"], F.array(r["out"])).alias("out")))

        chunks = F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / width).cast("int"))
        return F.flatten(F.aggregate(chunks, F.struct(begin.alias("state"), no_chunks.alias("out")), chunk, lambda s: s["out"]))

    return F.when(F.size(items) > 0, _let(items, over)).otherwise(none)


def _placed(hits: Column, gaps: Column) -> Column:
    """Spans of a pattern's matches: array of (start, end, hit), from the matches and the gaps around them."""

    def step(at: Column, x: Column) -> Column:
        start = at + F.length(x["gap"])
        end = start + F.length(x["hit"])
        return F.struct(end.alias("state"), F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("hit")).alias("out"))

    zipped = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(hits)).alias("gap"), hits.alias("hit"))
    return running(zipped, F.lit(0).cast("long"), step, "struct<start:bigint,end:bigint,hit:string>")


def _apart(found: Column, others: Column) -> Column:
    """Those of `others` that overlap none of `found`, both arrays of (kind, start, end, hit): a pass over all of them in
    order looks back at the furthest end so far, and a pass in reverse looks ahead to the next start."""
    kind = "struct<start:bigint,end:bigint,other:boolean,kind:int,hit:string,over:boolean>"
    item = lambda s, other: F.struct(s["start"].alias("start"), s["end"].alias("end"), other.alias("other"), s["kind"].alias("kind"), s["hit"].alias("hit"), F.lit(False).alias("over"))
    every = F.array_sort(F.concat(F.transform(found, lambda s: item(s, F.lit(False))), F.transform(others, lambda s: item(s, F.lit(True)))))
    marked = lambda x, over: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["other"].alias("other"), x["kind"].alias("kind"), x["hit"].alias("hit"), (x["over"] | over).alias("over"))

    def back(end: Column, x: Column) -> Column:
        return F.struct(F.when(x["other"], end).otherwise(F.greatest(end, x["end"])).alias("state"), marked(x, x["start"] < end).alias("out"))

    def ahead(start: Column, x: Column) -> Column:
        return F.struct(F.when(x["other"], start).otherwise(F.least(start, x["start"])).alias("state"), marked(x, start < x["end"]).alias("out"))

    done = running(F.reverse(running(every, F.lit(0).cast("long"), back, kind)), F.lit(2**62).cast("long"), ahead, kind)
    free = F.transform(F.filter(done, lambda x: x["other"] & ~x["over"]), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["hit"].alias("hit")))
    return F.when((F.size(found) > 0) & (F.size(others) > 0), free).otherwise(others)


def _blocks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def _piece(blocks: Column, start: Column, end: Column) -> Column:
    """The text from `start` up to `end`, which may lie beyond the text's own end."""
    first, last = (F.floor(x / BLOCK).cast("int") for x in (start, end))
    return F.substring(F.array_join(F.slice(blocks, first + 1, last - first + 1), ""), (start - first * BLOCK + 1).cast("int"), (end - start).cast("int"))


def _patterns(blocks: Column, m: Column) -> Column:
    """The lexical patterns around a mention: those that a few characters on either side show, nearly always."""
    left = lambda n: _piece(blocks, F.greatest(m["start"] - n, F.lit(0).cast("long")), m["start"])
    right = lambda n: _piece(blocks, m["end"], m["end"] + n)
    everything = F.array_join(blocks, "")
    two, whole = rf"[{_BLANK}]{_TWO}", rf"{_NEXT}[{_BLANK}]"

    def before(s: Column) -> Column:
        def further(n: int, rest: Column) -> Column:
            return _let(left(n), lambda w: F.when((m["start"] <= n) | w.rlike(two), w).otherwise(rest))

        return F.when((m["start"] <= 60) | s.rlike(two), s).otherwise(further(1000, further(20_000, F.substring(everything, F.lit(1), m["start"].cast("int")))))

    def after(s: Column) -> Column:
        def further(n: int, rest: Column) -> Column:
            return _let(right(n), lambda w: F.when((F.length(w) < n) | w.rlike(whole), w).otherwise(rest))

        return F.when((F.length(s) < 40) | s.rlike(whole), s).otherwise(further(600, further(20_000, F.substring(everything, (m["end"] + 1).cast("int"), F.lit(2**31 - 1)))))

    def words(s: Column) -> Column:
        return F.struct(F.regexp_extract(s["left"], _ONE, 1).alias("one"), F.regexp_extract(s["left"], _TWO, 1).alias("two"), F.regexp_extract(s["right"], _NEXT, 1).alias("next"))

    def named(w: Column) -> Column:
        one, two_, next_ = (F.when(F.length(w[n]) <= WORD, w[n]).otherwise(F.concat(F.lit(" "), F.md5(w[n]))) for n in ("one", "two", "next"))  # no word holds a blank
        pair = F.when(w["two"] != "", F.concat(F.lit("2 "), two_, F.lit(" "), one))
        return F.array_compact(F.array(F.when(w["one"] != "", F.concat(F.lit("1 "), one)), pair, F.when((w["one"] != "") & (w["next"] != ""), F.concat(F.lit("3 "), one, F.lit(" "), next_))))

    return _let(_let(F.struct(_let(left(60), before).alias("left"), _let(right(40), after).alias("right")), lambda s: _let(F.struct(F.lower(s["left"]).alias("left"), F.lower(s["right"]).alias("right")), words)), named)


def scan(docs: DataFrame) -> DataFrame:
    """uid, doc_id, text_key, base: array of (kind, start, end) and mentions: array of (kind, start, end, form, patterns).

    `kind` counts from 0 in the order of KINDS; mentions that no base pattern found have -1. Texts are read once.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    could = {"email": F.col("text").contains("@"), "card": F.lit(True), "ip": F.col("text").contains("."), "phone": F.col("text").contains("+")}
    empty = F.array().cast("array<string>")
    all_of = lambda pattern: F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    rows = rows.withColumns({f"hits_{k}": F.when(could[k], all_of(PATTERNS[k])).otherwise(empty) for k in KINDS} | {"hits_other": all_of(CANDIDATE)})
    for k, pattern in (*PATTERNS.items(), ("other", CANDIDATE)):
        rows = rows.withColumn(f"at_{k}", _placed(F.col(f"hits_{k}"), F.when(F.size(f"hits_{k}") > 0, F.split("text", pattern, -1)).otherwise(empty)))

    def as_kind(at: Column, kind: int) -> Column:
        return F.transform(at, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["hit"].alias("hit")))

    def holding(k: str) -> Column:
        return F.filter(f"at_{k}", lambda s: _HOLDS[k](s["hit"]))

    rows = rows.withColumn("found", F.concat(*[as_kind(holding(k), i) for i, k in enumerate(KINDS)]))
    shaped = F.filter("at_other", lambda s: (_digits(s["hit"]) >= 7) | F.contains(s["hit"], F.lit("@")) | F.contains(s["hit"], F.lit(":")))
    rows = rows.withColumn("others", as_kind(shaped, -1)).withColumn("others", _apart(F.col("found"), F.col("others")))
    rows = rows.withColumn("every", F.concat("found", "others"))
    rows = rows.withColumn("blocks", F.when(F.size("every") > 0, _blocks(F.col("text"))).otherwise(empty))

    def mention(m: Column) -> Column:
        return F.struct(m["kind"].alias("kind"), m["start"].alias("start"), m["end"].alias("end"), F.lower(m["hit"]).alias("form"), _patterns(F.col("blocks"), m).alias("patterns"))

    base = F.transform("found", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return rows.select(F.monotonically_increasing_id().alias("uid"), "doc_id", F.xxhash64("text").alias("text_key"), base.alias("base"), F.transform("every", mention).alias("mentions"))


def _fits(form: Column) -> list[Column]:
    """Whether a form that no base pattern found has the shape of each kind."""
    n = _digits(form)
    return [
        form.rlike(r"^[^@]*[a-z0-9][^@]*@[^@]*[a-z0-9]"),
        form.rlike(r"^[0-9a-f]{1,4}(:[0-9a-f]{0,4}){3,7}$") | form.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"),
        n.between(13, 19) & form.rlike(r"^[0-9 -]+$"),
        n.between(7, 15) & form.rlike(r"^[0-9(). -]+$"),
    ]


def discovered(scanned: DataFrame, rounds: int = ROUNDS, min_score: float = MIN_SCORE, min_seeds: int = MIN_SEEDS) -> DataFrame:
    """uid and the spans that high-confidence patterns add to it: array of (kind, start, end), without repeats."""
    mentions = scanned.select("uid", F.explode("mentions").alias("m")).select("uid", "m.*")
    occurrences = mentions.select("uid", "kind", "start", "end", "form", F.explode("patterns").alias("pattern"))
    seed = lambda k: F.max(F.when(F.col("kind") == k, 1.0).otherwise(0.0))
    edges = common.stored(occurrences.groupBy("pattern", "form").agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("kind") >= 0, 1).otherwise(0)).alias("seed"), *[seed(i).alias(f"seed_{k}") for i, k in enumerate(KINDS)]), "pii-edges")

    def pattern_scores(score: DataFrame | None) -> DataFrame:
        # a form found by a base pattern keeps its score of 1 for that kind
        linked = edges if score is None else edges.join(score, "form", "left")
        value = lambda k: F.col(f"seed_{k}") if score is None else F.when(F.col("seed") == 1, F.col(f"seed_{k}")).otherwise(F.coalesce(f"score_{k}", F.lit(0.0)))
        return linked.groupBy("pattern").agg(*[(F.sum(value(k)) / (F.count(F.lit(1)) + F.lit(0.5))).alias(f"p_{k}") for k in KINDS], *[F.sum(f"seed_{k}").alias(f"seeds_{k}") for k in KINDS])

    patterns = pattern_scores(None)
    for r in range(rounds - 1):
        reached = edges.where("seed = 0").join(patterns, "pattern").groupBy("form").agg(*[F.avg(f"p_{k}").alias(f"score_{k}") for k in KINDS])
        patterns = pattern_scores(common.stored(reached, f"pii-forms-{r}"))
    sure = reduce(lambda a, b: a | b, [(F.col(f"p_{k}") >= min_score) & (F.col(f"seeds_{k}") >= min_seeds) for k in KINDS])
    sure_patterns = common.stored(patterns.where(sure), "pii-patterns")
    unseen = occurrences.where("kind < 0").join(sure_patterns, "pattern")
    fits = dict(zip(KINDS, _fits(F.col("form")), strict=True))
    won = [F.when(fits[k] & (F.col(f"p_{k}") >= min_score) & (F.col(f"seeds_{k}") >= min_seeds), F.struct(F.col(f"p_{k}").alias("p"), F.lit(-i).alias("minus"))) for i, k in enumerate(KINDS)]
    best = unseen.withColumn("won", F.greatest(*won)).where("won IS NOT NULL").groupBy("uid", "start", "end").agg(F.max("won").alias("won"))
    return best.groupBy("uid").agg(F.collect_list(F.struct((-F.col("won.minus")).alias("kind"), "start", "end")).alias("added"))


def find(docs: DataFrame, **options) -> DataFrame:
    """doc_id, text_key (xxhash64 of the text), base and spans: arrays of (kind, start, end) in order, one row a document.

    `base` has what the base patterns find; `spans` also has what the patterns discover. Columns read: doc_id and text;
    a null text is an empty one without spans. Repeated rows and repeated or null ids each keep their own result; very
    long texts are whole; an empty table gives none.
    """
    scanned = common.stored(scan(docs), "pii-scan")
    added = discovered(scanned, **options)
    none = F.array().cast("array<struct<kind:int,start:bigint,end:bigint>>")
    joined = scanned.select("uid", "doc_id", "text_key", "base").join(added, "uid", "left")
    return joined.select("doc_id", "text_key", F.array_sort("base").alias("base"), F.array_sort(F.concat("base", F.coalesce("added", none))).alias("spans"))


def redact(docs: DataFrame, **options) -> DataFrame:
    """`docs` with every span of personal data in its text replaced by its kind in brackets; spans that overlap merge.

    All columns are kept, whatever their names; null and empty texts stay as they are, and each of repeated rows is
    redacted; an empty table gives none.
    """
    found = find(docs, **options).where(F.size("spans") > 0).select("doc_id", "text_key", "spans").dropDuplicates(["doc_id", "text_key"])
    spans = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    names = F.array(*[F.lit(f"[{k}]") for k in KINDS])
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"))
    placed = rows.join(found, F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("key") == F.col("text_key")), "left")
    there = placed.select("row", spans.alias("spans"), F.when(F.col("spans").isNotNull(), _blocks(F.col("row.text"))).alias("blocks"))

    def step(at: Column, x: Column) -> Column:
        out = F.when(x["start"] >= at, F.concat(_piece(F.col("blocks"), at, x["start"]), names[x["kind"]])).otherwise("")
        return F.struct(F.greatest(x["end"], at).alias("state"), out.alias("out"))

    pieces = running(F.col("spans"), F.lit(0).cast("long"), step, "string")
    last = F.array_max(F.transform("spans", lambda s: s["end"]))
    done = F.concat(F.array_join(pieces, ""), _piece(F.col("blocks"), last, last + (F.size("blocks") * BLOCK).cast("long")))
    return there.select(*[(F.when(F.col("spans").isNotNull(), done).otherwise(F.col("row.text")).alias("text") if c == "text" else F.col(f"row.`{c}`")) for c in docs.columns])


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_email ... n_phone and base_sha256 are of the base spans; `spans` has all, with what the patterns add."""
    found = find(common.table(spark, sf_dir, "documents"))
    names = F.array(*[F.lit(k) for k in KINDS])
    told = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")
    count = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long")
    counts = [count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(told("base"), 256).alias("base_sha256"), told("spans").alias("spans"))
