"""Configurations of many repositories as frames: which files are scanned, which findings are muted, and what findings weigh."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..sources.git import parse_config
from . import metrics

#: The file at a repository's root, unless another name is given.
CONFIG_FILE = ".siltmark.json"
_SHAPE = "struct<ignore:array<string>,mute:array<struct<id:string,category:string,path:string,reason:string>>,weights:struct<critical:double,warning:double,info:double>>"


def _parsed(text: str | None) -> dict:
    c = parse_config(text)
    return {"ignore": c["ignore"], "mute": [{k: m.get(k) for k in ("id", "category", "path", "reason")} for m in c["mute"]], "weights": c["weights"]}


def read_configs(files: DataFrame, name: str = CONFIG_FILE) -> DataFrame:
    """(repo_id, ignore, mute, weights) of every repository that has a configuration; one that is malformed, or of another shape in any part, is the default as a whole."""
    own = files.filter((F.col("path") == name) & (F.length("content") > 0)).groupBy("repo_id").agg(F.min("content").alias("content"))
    parsed = F.udf(_parsed, _SHAPE, useArrow=True)
    return own.select("repo_id", parsed("content").alias("c")).select("repo_id", "c.*")


def pattern(glob: Column, whole_folders: bool = False) -> Column:
    """An anchored regular expression of a glob column: ** crosses folders and takes a slash behind it, * and ? stay in one. whole_folders: **/ stands for folders, not for any beginning of a name."""
    plain = F.regexp_replace(F.replace(glob, F.lit("\\"), F.lit("/")) if whole_folders else glob, r"([.+^${}()|\[\]\\])", r"\\$1")
    deep = F.regexp_replace(F.regexp_replace(plain, r"\*\*/", "\x01"), r"\*\*", "\x02")
    one = F.regexp_replace(F.regexp_replace(deep, r"\*", "[^/]*"), r"\?", "[^/]")
    return F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(one, "\x01", "(?:.*/)?" if whole_folders else ".*"), "\x02", ".*"), F.lit("$"))


def fixed_folder(glob: Column) -> Column:
    """The folders that a glob begins with, with a slash at the end; empty if it can begin anywhere."""
    return F.regexp_extract(glob, r"^((?:[^*?/]+/)*)", 1)


def folders(path: Column) -> Column:
    """A path's folders from the root ('') down, each with a slash at the end."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.when(n == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(parts, 1, n), "/"), F.lit("/"))))


def kept_files(files: DataFrame, configs: DataFrame) -> DataFrame:
    """Files (repo_id, path, ...) that no ignore pattern of their repository fits. A file meets only patterns whose fixed folders it lies in."""
    globs = configs.select("repo_id", F.explode("ignore").alias("glob")).distinct()
    globs = globs.select("repo_id", fixed_folder(F.replace("glob", F.lit("\\"), F.lit("/"))).alias("folder"), pattern(F.col("glob"), whole_folders=True).alias("pattern"))
    paths = files.select("repo_id", "path").join(configs.select("repo_id"), "repo_id", "left_semi").distinct().select("repo_id", "path", F.explode(folders(F.col("path"))).alias("folder"))
    gone = paths.join(globs, ["repo_id", "folder"]).filter(F.regexp_like("path", F.col("pattern"))).select("repo_id", "path").distinct()
    return files.join(gone, ["repo_id", "path"], "left_anti")


def unmuted(findings: DataFrame, configs: DataFrame) -> DataFrame:
    """Findings that no mute rule of their repository fits in every field that the rule has. Findings meet rules by repository, once; patterns are tried only on paths that begin with their fixed folders."""
    rules = configs.select("repo_id", F.explode("mute").alias("m")).select("repo_id", "m.id", "m.category", "m.path").distinct()
    rules = rules.filter("id is not null or category is not null or path is not null").select(
        F.col("repo_id").alias("_repo"), F.col("id").alias("_id"), F.col("category").alias("_category"), F.coalesce(fixed_folder(F.col("path")), F.lit("")).alias("_folder"), pattern(F.col("path")).alias("_pattern")
    )
    where = F.regexp_replace(F.replace(F.regexp_replace(F.trim(F.coalesce("location", F.lit(""))), r"^(.+):(\d+)$", "$1"), F.lit("\\"), F.lit("/")), r"^\./", "")
    same = (F.col("_id").isNull() | F.col("_id").eqNullSafe(F.col("id"))) & (F.col("_category").isNull() | F.col("_category").eqNullSafe(F.col("category")))
    fits = same & F.startswith(F.col("_path"), F.col("_folder")) & (F.col("_pattern").isNull() | F.regexp_like("_path", F.col("_pattern")))
    return findings.withColumn("_path", where).join(rules, (F.col("repo_id") == F.col("_repo")) & F.coalesce(fits, F.lit(False)), "left_anti").drop("_path")


def configured_scores(findings: DataFrame, configs: DataFrame, repos: DataFrame | None = None) -> DataFrame:
    """Score and grade of each repository by its own weights; with `repos`, one without findings has 100 points."""
    counts = metrics.severity_counts(findings)
    if repos is not None:
        counts = repos.select("repo_id").distinct().join(counts, "repo_id", "left").fillna(0, [*S.SEVERITIES, "findings"])
    own = counts.join(configs.select("repo_id", "weights"), "repo_id", "left")
    lost = sum((S.tier_penalty(F.col(s), s, F.coalesce(F.col(f"weights.{s}"), F.lit(float(S.WEIGHTS[s])))) for s in S.SEVERITIES), F.lit(0.0))
    out = own.withColumn("score", F.greatest(F.lit(0), S.half_up(100 - lost)).cast("int")).drop("weights")
    return out.withColumn("grade", S.grade(F.col("score")))

