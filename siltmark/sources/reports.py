"""Reports of scans as JSON texts: those that fit the schema, and the others with what is wrong."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring as S

ISSUE = "struct<id:string,category:string,severity:string,title:string,location:string,ageDays:double,detail:string,evidence:string,aiNote:string,scanner:string>"
REPORT = (
    f"schemaVersion double, repo struct<owner:string,name:string,defaultBranch:string,commit:string>, generatedAt string, score double, grade string, issues array<{ISSUE}>, "
    "config struct<weights:struct<critical:double,warning:double,info:double>>, metrics struct<linesOfCode:double>, profile struct<totalFiles:double,languages:array<struct<language:string,files:double,loc:double>>,tools:array<string>>"
)
VERSION = 1


def _whole(x: Column) -> Column:
    """Whether a number is there, whole and not negative."""
    return F.coalesce((x >= 0) & (x == F.floor(x)), F.lit(False))


def parse_reports(texts: DataFrame, text: str = "value") -> tuple[DataFrame, DataFrame]:
    """(reports, rejected) of one JSON text a row.

    A report has the schema's columns and repo_id (owner/name); the old category secret is security. A rejected row has all its other columns, the text and the first reason. A null
    or empty text is no JSON; equal texts are each kept; unknown fields are left out.
    """
    r = F.from_json(F.col(text), REPORT, {"mode": "PERMISSIVE"})
    each = texts.withColumn("_r", r)
    x = F.col("_r")
    strings = ("id", "title", "location", "detail")
    issue = lambda i: (
        reduce(Column.__and__, (i[c].isNotNull() for c in strings)) & i["severity"].isin(*S.SEVERITIES) & i["category"].isin("secret", *S.CATEGORIES) & _whole(i["ageDays"])
    )
    reason = (
        F.when(F.try_parse_json(F.col(text)).isNull() | x.isNull(), "not JSON")
        .when(~F.coalesce(x["schemaVersion"] == VERSION, F.lit(False)), "schemaVersion")
        .when(reduce(Column.__or__, (x["repo"][c].isNull() for c in ("owner", "name", "defaultBranch"))), "repo")
        .when(x["generatedAt"].isNull(), "generatedAt")
        .when(~(_whole(x["score"]) & (x["score"] <= 100)), "score")
        .when(~F.coalesce(x["grade"].isin(*S.GRADES), F.lit(False)), "grade")
        .when(x["issues"].isNull() | ~F.forall("_r.issues", lambda i: F.coalesce(issue(i), F.lit(False))), "issues")
        .when(x["metrics"].isNotNull() & ~_whole(x["metrics"]["linesOfCode"]), "metrics")
    )
    judged = each.withColumn("reason", reason)
    issues = F.transform("_r.issues", lambda i: i.withField("category", F.when(i["category"] == "secret", "security").otherwise(i["category"])).withField("ageDays", i["ageDays"].cast("int")))
    good = judged.filter("reason is null").select(
        F.concat_ws("/", "_r.repo.owner", "_r.repo.name").alias("repo_id"), x["schemaVersion"].cast("int").alias("schemaVersion"), x["repo"].alias("repo"), x["generatedAt"].alias("generatedAt"),
        x["score"].cast("int").alias("score"), x["grade"].alias("grade"), issues.alias("issues"), *(x[c].alias(c) for c in ("config", "metrics", "profile")),
    )
    return good, judged.filter("reason is not null").drop("_r")


def read_reports(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(reports, rejected) of a folder of JSON files, one report in each."""
    return parse_reports(spark.read.text(path, wholetext=True))


def issues_of(reports: DataFrame) -> DataFrame:
    """The reports' issues in the shape of findings."""
    i = reports.select("repo_id", F.posexplode("issues").alias("ord", "i")).select("repo_id", F.col("ord").cast("long").alias("ord"), "i.*")
    return i.select("repo_id", "id", "category", "severity", "title", "location", F.col("ageDays").alias("age_days"), "detail", "evidence", "scanner", "ord")
