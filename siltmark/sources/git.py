"""Readers of source trees and of git logs."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scoring import CATEGORIES, WEIGHTS
from ..functions.text import glob_regex

# What is never part of a source tree.
EXCLUDED = ("**/node_modules/**", "**/.git/**", "**/dist/**", "**/build/**", "**/coverage/**", "**/.next/**", "**/*.log")
COMMIT = "repo_id string, sha string, commit_ts timestamp, parents array<string>, subject string, tagged boolean"


def read_trees(spark: SparkSession, root: str, ignore: list[str] | None = None) -> DataFrame:
    """(repo_id, path, file_ord, size, content) of the repositories in a folder, one for each of its subfolders; content is null where it is not UTF-8 text."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rest = F.regexp_extract("path", r"^.*?" + _escaped(root.rstrip("/")) + r"/(.*)$", 1)
    files = raw.select(F.split(rest, "/")[0].alias("repo_id"), F.regexp_replace(rest, r"^[^/]+/", "").alias("path"), F.col("length").alias("size"), F.col("content").alias("_raw")).filter("path <> repo_id")
    skip = "|".join(f"(?:{glob_regex(g)})" for g in (*EXCLUDED, *(ignore or [])))
    files = files.filter(~F.col("path").rlike(skip)).withColumn("content", F.when(F.is_valid_utf8(F.col("_raw").cast("string")), F.decode("_raw", "UTF-8"))).drop("_raw")
    # only paths are numbered, so that contents do not go through the window
    order = F.row_number().over(Window.partitionBy("repo_id").orderBy("path")).cast("long")
    return files.join(files.select("repo_id", "path", order.alias("file_ord")), ["repo_id", "path"])


def _escaped(text: str) -> str:
    import re

    return re.escape(text.removeprefix("file:").removeprefix("//"))


def parse_commits(lines: DataFrame) -> DataFrame:
    """Commits from (repo_id, line): hash, seconds, parents, decorations and subject, split by U+001F; lines of another shape are dropped."""
    p = F.split("line", "\x1f", -1)
    ok = lines.filter((F.size(p) >= 5) & p[0].rlike("^[0-9a-f]{7,40}$") & p[1].rlike(r"^\d+$"))
    return ok.select(
        "repo_id", p[0].alias("sha"), F.timestamp_seconds(p[1].cast("long")).alias("commit_ts"), F.filter(F.split(p[2], " "), lambda x: x != "").alias("parents"),
        F.array_join(F.slice(p, 5, F.size(p)), "\x1f").alias("subject"), F.coalesce(p[3].contains("tag:"), F.lit(False)).alias("tagged"),
    )


def parse_commit_files(records: DataFrame, most: int = 20) -> DataFrame:
    """(repo_id, sha, files array<struct<path,status>>, files_changed, truncated) from records split at U+001E: a commit line, then name-status lines. Renames and copies count by where they go."""
    ln = F.filter(F.split("record", "\n"), lambda x: F.trim(x) != "")
    rows = F.transform(F.filter(F.slice(ln, 2, F.greatest(F.size(ln) - 1, F.lit(0))), lambda x: F.size(F.split(x, "\t")) >= 2), lambda x: F.struct(F.when(x.rlike("^[RC]"), F.get(F.split(x, "\t"), F.lit(2))).otherwise(F.split(x, "\t")[1]).alias("path"), F.substring(x, 1, 1).alias("status")))
    out = records.filter(F.size(ln) > 0).select("repo_id", F.split(ln[0], "\x1f")[0].alias("sha"), rows.alias("all"))
    return out.select("repo_id", "sha", F.slice("all", 1, most).alias("files"), F.size("all").alias("files_changed"), (F.size("all") > most).alias("truncated"))


def parse_blame(records: DataFrame, as_of: str) -> DataFrame:
    """(repo_id, path, line, age_days) from (repo_id, path, porcelain): whole days since each line's committer time, none below 0."""
    time = r"(?m)^[0-9a-f]{40} \d+ (\d+)(?: \d+)?\n(?:(?!\t).*\n)*?committer-time (\d+)"
    lines, seconds = F.regexp_extract_all("porcelain", F.lit(time), 1), F.regexp_extract_all("porcelain", F.lit(time), 2)
    each = records.select("repo_id", "path", F.explode(F.arrays_zip(lines.alias("line"), seconds.alias("seconds"))).alias("x"))
    age = F.floor((F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.col("x.seconds").cast("long")) / 86400)
    return each.select("repo_id", "path", F.col("x.line").cast("int").alias("line"), F.greatest(F.lit(0), age).cast("int").alias("age_days"))


def ownership(changes: DataFrame, as_of: str) -> DataFrame:
    """(repo_id, path, authors, age_days) from changes (repo_id, path, author, commit_ts)."""
    return changes.groupBy("repo_id", "path").agg(F.countDistinct("author").cast("int").alias("authors"), F.greatest(F.lit(0), F.datediff(F.lit(as_of), F.max("commit_ts"))).alias("age_days"))


def history_additions(patches: DataFrame, most_lines: int | None = 100_000, most_chars: int | None = 4000) -> DataFrame:
    """Added lines (repo_id, commit, commit_ts, path, text) of patches (repo_id, commit, commit_ts, patch), newest commits first up to a number of lines; None: all of them, of any length."""
    files = patches.select("repo_id", "commit", "commit_ts", F.posexplode(F.split("patch", r"(?m)^diff --git ")).alias("k", "part"))
    ln = files.select("repo_id", "commit", "commit_ts", "k", F.regexp_extract("part", r"(?m)^\+\+\+ b/(.*)$", 1).alias("path"), F.posexplode(F.split("part", "\n")).alias("n", "raw"))
    added = ln.filter(F.col("raw").startswith("+") & ~F.col("raw").startswith("+++") & (F.col("path") != ""))
    if most_chars is not None:
        added = added.filter(F.length("raw") <= most_chars + 1)
    if most_lines is not None:
        order = F.row_number().over(Window.partitionBy("repo_id").orderBy(F.desc("commit_ts"), "commit", "k", "n"))
        added = added.withColumn("_r", order).filter(F.col("_r") <= most_lines)
    return added.select("repo_id", "commit", "commit_ts", "path", F.expr("substring(raw, 2)").alias("text"))


def find_repositories(spark: SparkSession, root: str, only: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """(folder, origin, branch, head) of the repositories right below a folder: those with a .git folder that has a HEAD; of those named in `only` (all if it is empty), the first `limit` by name.

    branch is main where HEAD names none; head is the commit that HEAD or its branch names, loose or packed, or null; origin is the address to push to or else to fetch from, or null.
    """
    def read(glob: str, column: str) -> DataFrame:
        try:
            raw = spark.read.text(f"{root.rstrip('/')}/*/.git/{glob}", wholetext=True, recursiveFileLookup=True)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], f"folder string, ref string, {column} string")
        path = F.col("_metadata.file_path")
        return raw.select(F.url_decode(F.regexp_extract(path, r"/([^/]+)/\.git/", 1)).alias("folder"), F.url_decode(F.regexp_extract(path, r"/\.git/(.*)$", 1)).alias("ref"), F.col("value").alias(column))

    heads = read("HEAD", "text").select("folder", F.trim(F.regexp_replace("text", r"\s+$", "")).alias("_head"))
    names = [n for n in (x.strip() for x in only or []) if n]
    heads = heads.filter(F.col("folder").isin(*names)) if names else heads
    heads = heads if limit is None or limit <= 0 else heads.orderBy("folder").limit(limit)
    ref = F.nullif(F.regexp_extract("_head", r"^ref:\s*(\S+)$", 1), F.lit(""))
    config = read("config", "text").select("folder", F.regexp_extract("text", r'(?ms)^\[remote "origin"\]\s*$(.*?)(?=^\[|\Z)', 1).alias("_c"))
    address = lambda key: F.nullif(F.regexp_extract("_c", rf"(?m)^\s*{key}\s*=\s*(\S+)", 1), F.lit(""))
    origins = config.select("folder", F.coalesce(address("pushurl"), address("url")).alias("origin"))
    loose = read("refs/heads", "sha").select("folder", F.col("ref").alias("_ref"), F.trim(F.regexp_replace("sha", r"\s+$", "")).alias("_loose"))
    packed = read("packed-refs", "text").select("folder", F.explode(F.split("text", "\n")).alias("l")).select("folder", F.regexp_extract("l", r"^[0-9a-f]{40} (\S+)$", 1).alias("_ref"), F.regexp_extract("l", r"^([0-9a-f]{40}) ", 1).alias("_packed")).filter("_ref <> ''")
    out = heads.withColumn("_ref", ref).join(origins, "folder", "left").join(loose, ["folder", "_ref"], "left").join(packed, ["folder", "_ref"], "left")
    direct = F.when(F.col("_head").rlike("^[0-9a-f]{40}$"), F.col("_head"))
    branch = F.coalesce(F.nullif(F.regexp_extract(F.coalesce("_ref", F.lit("")), r"^refs/heads/(.+)$", 1), F.lit("")), F.lit("main"))
    return out.select("folder", "origin", branch.alias("branch"), F.coalesce("_loose", "_packed", direct).alias("head"))


def repo_names(remotes: DataFrame) -> DataFrame:
    """(repo_id, owner, name) from (repo_id, origin, folder): of the address, else local/<folder>."""
    at = r"[:/]([^/:]+)/([^/]+?)(?:\.git)?/?$"
    has = F.coalesce(F.col("origin").rlike(at), F.lit(False))
    return remotes.select("repo_id", F.when(has, F.regexp_extract("origin", at, 1)).otherwise("local").alias("owner"), F.when(has, F.regexp_extract("origin", at, 2)).otherwise(F.col("folder")).alias("name"))


def parse_config(text: str | None) -> dict:
    """A repository's configuration; the whole of it is the default if it is not JSON or has another shape, as a mute rule without id, category and path, or with an unknown category. Unknown keys are left out."""
    default = {"ignore": [], "mute": [], "weights": dict(WEIGHTS)}
    try:
        raw = json.loads(text or "")
        strings = lambda x: isinstance(x, list) and all(isinstance(v, str) for v in x)
        ignore, mute, weights = raw.get("ignore", []), raw.get("mute", []), raw.get("weights", {})
        good = strings(ignore) and isinstance(mute, list) and isinstance(weights, dict)
        good = good and all(isinstance(m, dict) and all(isinstance(m[k], str) for k in ("id", "category", "path", "reason") if k in m) for m in mute)
        good = good and all({"id", "category", "path"} & set(m) and m.get("category", CATEGORIES[0]) in CATEGORIES for m in mute)
        good = good and all(isinstance(weights[k], (int, float)) and not isinstance(weights[k], bool) and weights[k] >= 0 for k in WEIGHTS if k in weights)
        if not good:
            return default
        return {"ignore": ignore, "mute": [{k: m[k] for k in ("id", "category", "path", "reason") if k in m} for m in mute], "weights": {**WEIGHTS, **{k: float(weights[k]) for k in WEIGHTS if k in weights}}}
    except (ValueError, AttributeError, TypeError):
        return default
