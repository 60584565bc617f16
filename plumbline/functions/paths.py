"""Paths with `/`, and what names say: extensions, stems, languages, cases and words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions by language.
EXTENSIONS = {"cjs": "js", "js": "js", "jsx": "jsx", "mjs": "js", "rake": "ruby", "rb": "ruby", "ts": "js", "tsx": "jsx"}
FILENAMES = {"Gemfile": "ruby", "Rakefile": "ruby"}


def base(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def directory(path: Column, root: str = ".") -> Column:
    """The path before the last slash; `root` where there is none."""
    return F.when(F.instr(path, "/") > 0, F.regexp_extract(path, r"^(.*)/[^/]*$", 1)).otherwise(F.lit(root))


def extension(path: Column) -> Column:
    """What follows the last dot of the file name, `d.ts` and its like as one; empty for dotfiles and names without a dot."""
    name = base(path)
    return F.coalesce(F.nullif(F.regexp_extract(name, r"^.+\.(d\.(?:ts|mts|cts))$", 1), F.lit("")), F.regexp_extract(name, r"^.+\.([^.]*)$", 1))


def without_extension(path: Column) -> Column:
    return F.regexp_replace(path, r"(?<=[^/])(\.d\.(ts|mts|cts)|\.[^./]*)$", "")


def stem(path: Column) -> Column:
    return without_extension(base(path))


def _mapped(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def language(path: Column) -> Column:
    """By extension, else by file name, else `js`."""
    return F.coalesce(F.try_element_at(_mapped(EXTENSIONS), extension(path)), F.try_element_at(_mapped(FILENAMES), base(path)), F.lit("js"))


def ancestors(path: Column, root: str = ".") -> Column:
    """The directories above a directory path, itself last; the root first. `a/b` gives `.`, `a`, `a/b`."""
    parts = F.split(path, "/")
    below = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return F.when(path == root, F.array(F.lit(root))).otherwise(F.concat(F.array(F.lit(root)), below))


def suffixes(path: Column) -> Column:
    """The path's tails at slashes, the whole path first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, n, F.size(parts)), "/"))


#: Naming classes in the order in which they are tried.
NAMING_CLASSES = (
    ("kebab-case", r"^[a-z0-9]+(-[a-z0-9]+)+$"),
    ("snake_case", r"^[a-z0-9]+(_[a-z0-9]+)+$"),
    ("camelCase", r"^[a-z][a-z0-9]*[A-Z][a-zA-Z0-9]*$"),
    ("PascalCase", r"^[A-Z][a-zA-Z0-9]*$"),
)


def classify_word(word: Column) -> Column:
    """The naming class of a word; null for one that fits none, a single lower-case word included."""
    return F.coalesce(*[F.when(word.rlike(p), F.lit(c)) for c, p in NAMING_CLASSES])


def prefix_class(name: Column) -> Column:
    """The capital before a capitalised name (`I` of `IName`), or `none`."""
    return F.coalesce(F.nullif(F.regexp_extract(name, r"^([A-Z])[A-Z][a-z]", 1), F.lit("")), F.lit("none"))


def _named(path: Column) -> Column:
    """A file name up to its first dot, without leading digits and their separator; null without an extension."""
    name = base(path)
    return F.when(name.rlike(r"^[^.]+\."), F.regexp_replace(F.regexp_extract(name, r"^([^.]+)\.", 1), r"^[0-9]+[-_]", ""))


def classify_basename(path: Column) -> Column:
    """The naming class of a file's stem; null for a name of digits or without an extension."""
    return classify_word(_named(path))


def names_a_site(path: Column) -> Column:
    """Whether a file's name can agree or disagree with a naming class: not a single lower-case word."""
    return F.coalesce(~_named(path).rlike("^[a-z0-9]+$"), F.lit(False))


def stem_words(path: Column) -> Column:
    """Lower-case words of a stem, apart at `-`, `_`, `.` and before capitals."""
    cut = F.regexp_replace(stem(path), r"([A-Z])", r"-$1")
    return F.filter(F.split(F.lower(cut), r"[-_.]+"), lambda w: w != "")


def version(text: Column) -> Column:
    """A dotted version as numbers, which compare as arrays; parts that are no numbers are 0."""
    return F.transform(F.split(text, r"\."), lambda p: F.coalesce(F.nullif(F.regexp_extract(p, r"^([0-9]{1,9})", 1), F.lit("")).cast("int"), F.lit(0)))


def imported_path(dir_: Column, specifier: Column) -> Column:
    """The path that a relative specifier names from a directory (`.` or empty for the root), without query or fragment;
    null where it leaves the tree or is not relative."""
    plain = F.regexp_replace(specifier, r"[?#].*$", "")
    from_ = F.filter(F.split(dir_, "/"), lambda p: (p != "") & (p != "."))
    begin = F.struct(from_.alias("at"), F.lit(True).alias("inside"))

    def step(s: Column, part: Column) -> Column:
        up = F.struct(F.slice(s["at"], F.lit(1), F.greatest(F.size(s["at"]) - 1, F.lit(0))).alias("at"), (s["inside"] & (F.size(s["at"]) > 0)).alias("inside"))
        down = F.struct(F.concat(s["at"], F.array(part)).alias("at"), s["inside"].alias("inside"))
        return F.when(part == "..", up).when((part == "") | (part == "."), s).otherwise(down)

    walked = F.aggregate(F.split(plain, "/"), begin, step, lambda s: F.when(s["inside"], F.array_join(s["at"], "/")))
    return F.when(plain.rlike(r"^\.\.?(/|$)"), walked)


def import_candidates(path: Column, extensions: tuple[str, ...]) -> Column:
    """Paths that an import of `path` may mean, in order: itself, with an extension, as a directory's index file."""
    return F.array(path, *[F.concat(path, F.lit(f".{e}")) for e in extensions], *[F.concat(path, F.lit(f"/index.{e}")) for e in extensions])
