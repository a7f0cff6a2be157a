"""Code that is there twice: maximal repeated blocks of lines, with all their places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ...session import checkpointed
from ..findings import cap
from .base import Snapshot, at, found, text

# Sizes, and the patterns by which files and lines are left out.
WINDOW, LEAST_CHARS, MANY, LARGE, SHARE, ONE_LINE = 8, 240, 4, 30, 0.7, 2000
CODE = r"(?i)\.(?:[cm]?[jt]sx?|py|go|rs|rb|php|java|kt|kts|swift|scala|cs|c|cc|cpp|h|hpp|m|mm|dart|ex|exs|vue|svelte)$"
FOLDERS = r"(?i)(^|/)(?:node_modules|vendor|third_party|thirdparty|dist|build|out|target|generated|__generated__|\.next|\.nuxt|coverage|migrations|__snapshots__|__fixtures__|fixtures?|testdata|examples?|templates?(?:[-_.][\w.-]*)?|scaffolds?|starters?|playgrounds?)/"
GENERATED = r"(?i)(?:\.min\.[jt]s|\.bundle\.js|\.g\.dart|_pb2?\.py|\.pb\.go|\.generated\.[a-z]+|\.d\.ts)$"
TESTED = r"(?i)(^|/)(?:tests?|spec|__tests__|e2e)/|\.(?:test|spec)\.[cm]?[jt]sx?$|(^|/)test_[^/]+\.py$|[^/]+_test\.(?:py|go|rb)$|[^/]+Test\.(?:java|kt|cs)$|_spec\.rb$"
NOISE = r"^(?:[{}()\[\];,]+|else\s*\{?|\}?\s*else\s*(?:if.*)?\{?|return;?|break;?|continue;?|pass|end|fi|done|</?\w+\s*/?>)$"
IMPORTS = r"^(?:import\b|from\s+\S+\s+import\b|#include\b|using\s+\w|require\s*\(|use\s+\w|package\b|export\s+\*|export\s+\{)"
COMMENT = r"^(?://|#|\*|/\*|--|;;)"
DECLARATIVE = (r"^(?:export\s+)?(?:declare\s+)?(?:type|interface|enum|abstract\s+class)\b", r"^[\w$]+\??\s*:\s*[^=]+,?$", r"^[A-Z]\w*(?:\s+extends\s+.+?)?(?:\s*=\s*[^=]*?)?,?$", r"^\)?\s*:\s*.+$", r"^[<>(),\s|&]*$")
SVG = r"(?i)^</?(?:svg|g|defs|path|filter|fe[A-Z]\w*|clipPath|mask|stop|linearGradient|radialGradient|circle|rect|ellipse|polygon|polyline|line|use|symbol)\b"
ATTRIBUTE = r"(?i)^[a-z][\w-]*(?::[\w-]+)?=[\"'][^\"']*[\"']\s*/?>?$"

#: Parts of a block's places that are ranked apart before the first ones are taken together.
SALTS = 32
_HERE = ["repo_id", "path"]


def written_code(path: Column) -> Column:
    """Whether a path is source code that people write and maintain, and not a test or a sample."""
    return path.rlike(CODE) & ~path.rlike(FOLDERS) & ~path.rlike(GENERATED) & ~path.rlike(TESTED)


def significant_lines(s: Snapshot, files: DataFrame) -> DataFrame:
    """(repo_id, path, file_ord, line, n, text): lines worth comparing, numbered, white space made even; comments, imports and lines that carry nothing by themselves are left out."""
    ln = s.lines(files).withColumn("t", F.regexp_replace("text", r"(?U)^\s+|\s+$", ""))
    opens, closes = F.col("t").startswith("/*") & ~F.col("t").contains("*/"), F.col("t").contains("*/")
    state = F.last(F.when(opens, 1).when(closes, 0), ignorenulls=True).over(Window.partitionBy(*_HERE).orderBy("line").rowsBetween(Window.unboundedPreceding, -1))
    ln = ln.withColumn("inside", F.coalesce(state, F.lit(0))).filter(F.expr("inside = 0 and t <> ''") & ~F.col("t").rlike(COMMENT)).withColumn("text", F.regexp_replace("t", r"(?U)\s+", " "))
    ln = ln.filter(~F.col("text").rlike(NOISE) & ~F.col("text").rlike(IMPORTS))
    return ln.select(*_HERE, "file_ord", "line", "text", (F.row_number().over(Window.partitionBy(*_HERE).orderBy("line")) - 1).alias("n"))


def windows(lines: DataFrame, size: int) -> DataFrame:
    """(repo_id, path, file_ord, n, key): a 64-bit hash of each line and the size - 1 ones behind it."""
    w = Window.partitionBy(*_HERE).orderBy("n")
    each = lines.withColumn("h", F.xxhash64("text"))
    ahead = [F.lead("h", k).over(w) for k in range(size)]
    return each.select(*_HERE, "file_ord", "n", F.when(ahead[-1].isNotNull(), F.xxhash64(*ahead)).alias("key")).filter("key is not null")


def repeats(lines: DataFrame, size: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Windows that are in several places, with how far all places of a window go on alike.

    Returns (groups, members): groups (repo_id, key, f: its first place as (file_ord, path, n), places, more), members (repo_id, key, path, n). All `more` windows that follow at one place
    follow at each, and the next does not.

    Windows are ranked by doubling: level k tells apart runs of 2**k windows, so `more` is found bit by bit from the highest, each by one join of the places and one aggregate, however long
    the blocks are. Places of a window are never paired with one another.
    """
    win = windows(lines, size)
    groups = checkpointed(win.groupBy("repo_id", "key").agg(F.min(F.struct("file_ord", "path", "n")).alias("f"), F.count("*").alias("places")).filter("places > 1"))
    again = win.join(groups.select("repo_id", "key"), ["repo_id", "key"])
    again = checkpointed(again.withColumn("run", F.col("n") - F.row_number().over(Window.partitionBy(*_HERE).orderBy("n"))).select(*_HERE, "n", "run", "key"))
    longest = again.groupBy(*_HERE, "run").count().agg(F.max("count")).first()[0] or 1
    levels = (int(longest) - 1).bit_length()
    ranked, w = again.withColumn("h0", F.col("key")), Window.partitionBy(*_HERE, "run").orderBy("n")
    for k in range(levels - 1):
        second = F.lead(f"h{k}", 1 << k).over(w)
        ranked = ranked.withColumn(f"h{k + 1}", F.when(second.isNotNull(), F.xxhash64(f"h{k}", second)))
    ranked = checkpointed(ranked.drop("run")) if levels > 1 else ranked.drop("run")
    members = again.select("repo_id", "key", "path", "n")
    known = groups.select("repo_id", "key", "places", F.lit(0).cast("long").alias("more"))
    for k in reversed(range(levels)):
        ahead = members.join(known, ["repo_id", "key"]).select(*_HERE, (F.col("n") + 1 + F.col("more")).alias("n"), "key", "places")
        there = ranked.select(*_HERE, "n", F.col(f"h{k}").alias("h")).filter("h is not null")
        alike = ahead.join(there, [*_HERE, "n"]).groupBy("repo_id", "key", "places").agg(F.count("*").alias("c"), F.min("h").alias("a"), F.max("h").alias("b")).filter("c = places and a = b")
        known = checkpointed(known.join(alike.select("repo_id", "key", F.lit(1 << k).alias("step")), ["repo_id", "key"], "left").select("repo_id", "key", "places", (F.col("more") + F.coalesce("step", F.lit(0))).alias("more")))
    return groups.join(known.select("repo_id", "key", "more"), ["repo_id", "key"]), members


def opened(candidates: DataFrame) -> DataFrame:
    """Of candidates (repo_id, path, n, more, ...), those that open a block: in the order of a file's lines, each that no block opened before it covers.

    An earlier block that covers a place of a later one's window covers the window's first place too: the first place of the covered window lies between the block's own start and end. So
    only blocks of one file decide on one another, a block keeps all its places, and a fold over a file's candidates settles it.
    """
    order = F.array_sort(F.collect_list(F.struct("n", (F.col("n") + F.col("more")).alias("end"))))
    start = F.struct(F.lit(-1).cast("long").alias("end"), F.array().cast("array<long>").alias("n"))
    folded = F.aggregate(order, start, lambda a, x: F.when(x["n"] > a["end"], F.struct(x["end"].cast("long").alias("end"), F.concat(a["n"], F.array(x["n"].cast("long"))).alias("n"))).otherwise(a))
    starts = candidates.groupBy(*_HERE).agg(folded["n"].alias("starts")).select(*_HERE, F.explode("starts").alias("n"))
    return candidates.join(starts, [*_HERE, "n"])


def blocks(lines: DataFrame, size: int = WINDOW, least_chars: int = LEAST_CHARS, code: bool = True) -> tuple[DataFrame, DataFrame]:
    """Maximal repeated blocks of lines (repo_id, path, file_ord, n, text) and their places.

    Returns (blocks, places): blocks (repo_id, key, path, file_ord, n, more, lines, places, chars), a block lying at its first place; places (repo_id, key, path, n). A block begins at the first
    place of a repeated window that no earlier block covers, and goes on as long as all its places do. Blocks of fewer than `least_chars` characters do not count and cover nothing; with
    `code`, nor do those that are mostly declarations or a pasted drawing. Lines are equal by 64-bit hashes. Files that are equal many times give one row a place.
    """
    groups, members = repeats(lines, size)
    t = F.col("text")
    drawn = t.rlike(SVG)
    marks = {"chars": F.length("text") + 1}
    if code:
        declares = t.rlike(DECLARATIVE[0])
        for p in DECLARATIVE[1:]:
            declares |= t.rlike(p)
        marks |= {"shape": declares.cast("int"), "markup": (drawn | t.rlike(ATTRIBUTE) | t.rlike(r"^</?\w")).cast("int"), "svg": drawn.cast("int")}
    w = Window.partitionBy(*_HERE).orderBy("n")
    sums = lines.select(*_HERE, "n", *(F.sum(x).over(w).alias(c) for c, x in marks.items()), *(x.alias(f"own_{c}") for c, x in marks.items()))
    head = sums.select("repo_id", "path", "n", *((F.col(c) - F.col(f"own_{c}")).alias(f"before_{c}") for c in marks))
    tail = sums.select("repo_id", "path", F.col("n").alias("last"), *marks)
    first = groups.select("repo_id", "key", F.col("f.path").alias("path"), F.col("f.file_ord").alias("file_ord"), F.col("f.n").alias("n"), "more", (F.col("more") + size).alias("lines"), "places")
    ends = first.withColumn("last", F.col("n") + F.col("lines") - 1).join(head, [*_HERE, "n"]).join(tail, [*_HERE, "last"])
    inside = lambda c: F.col(c) - F.col(f"before_{c}")
    good = inside("chars") - 1 >= least_chars
    if code:
        good &= (inside("shape") / F.col("lines") < SHARE) & ~((inside("svg") > 0) & (inside("markup") / F.col("lines") >= SHARE))
    kept = checkpointed(opened(ends.filter(good).select(*first.columns, (inside("chars") - 1).alias("chars"))))
    return kept, members.join(kept.select("repo_id", "key"), ["repo_id", "key"])


def duplicate_code(s: Snapshot, most_files: int | None = None) -> DataFrame:
    """Pasted blocks of code, at their first place, largest first, with how many places they have and where the next four are.

    All files are read, but for those of a single line of over 2000 characters and of repositories with one file; most_files keeps only the first ones of each repository.
    """
    files = s.matching(".").filter(written_code(F.col("path")))
    if most_files is not None:
        files = files.withColumn("k", F.row_number().over(Window.partitionBy("repo_id").orderBy("file_ord"))).filter(F.col("k") <= most_files).drop("k")
    several = files.groupBy("repo_id").agg(F.count("*").alias("k")).filter("k > 1").select("repo_id")
    files = files.join(several, "repo_id", "left_semi").filter((F.length("content") <= ONE_LINE) | F.col("content").contains("\n"))
    sig = checkpointed(significant_lines(s, files))
    kept, places = blocks(sig)
    rest = places.join(kept.select("repo_id", "key", F.col("path").alias("_p"), F.col("n").alias("_n")), ["repo_id", "key"]).filter((F.col("path") != F.col("_p")) | (F.col("n") != F.col("_n")))
    rest = rest.join(sig.select(*_HERE, "n", "file_ord", "line"), [*_HERE, "n"]).withColumn("salt", F.pmod(F.xxhash64("path", "n"), F.lit(SALTS)))
    for by in (("repo_id", "key", "salt"), ("repo_id", "key")):
        rest = rest.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("file_ord", "path", "n"))).filter("r <= 4")
    where = rest.groupBy("repo_id", "key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", at()))), lambda x: x["col2"]), ", ").alias("others"))
    place = kept.join(sig.select(*_HERE, "n", "line", "text"), [*_HERE, "n"]).join(where, ["repo_id", "key"])
    sev = F.when((F.col("lines") >= LARGE) | (F.col("places") >= MANY), "warning").otherwise("info")
    more = F.when(F.col("places") > 5, F.concat(F.lit(" and "), (F.col("places") - 5).cast("string"), F.lit(" more"))).otherwise("")
    rank = F.row_number().over(Window.partitionBy("repo_id").orderBy(F.desc("lines"), F.desc("places"), "file_ord", "path", "n"))
    place = s.aged(place.withColumn("rank", rank))
    out = found(
        place, "duplicate-code", "hygiene", id=F.concat(F.lit("duplicate-"), at()), severity=sev, title=text("{lines} lines are in {places} places"), location=at(),
        detail=F.concat(F.lit("The block is also at "), F.col("others"), more, F.lit(".")), evidence=F.substring("text", 1, 160), ord=F.col("rank"),
    )
    return cap(out, s.most("duplicate-code"))
