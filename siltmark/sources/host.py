"""Projections of a code host's JSON answers: what is shown of a repository, a person and their repositories, and nothing else."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most topics of a repository that are shown.
TOPICS = 8


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _text(v: Column, path: str) -> Column:
    """A string that is not empty, or null; numbers and others are none."""
    x = F.try_variant_get(v, path, "variant")
    return F.when(_kind(x) == "STRING", F.nullif(F.try_variant_get(v, path, "string"), F.lit("")))


def _number(v: Column, path: str) -> Column:
    """A number, or null."""
    x = F.try_variant_get(v, path, "variant")
    return F.when(_kind(x).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(v, path, "double"))


def _true(v: Column, path: str) -> Column:
    x = F.try_variant_get(v, path, "variant")
    return F.coalesce((_kind(x) == "BOOLEAN") & F.try_variant_get(v, path, "boolean"), F.lit(False))


def _strings(v: Column, path: str) -> Column:
    items = F.filter(F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>")), lambda x: F.coalesce(_kind(x) == "STRING", F.lit(False)))
    return F.transform(items, lambda x: F.try_variant_get(x, "$", "string"))


def repositories(answers: DataFrame, payload: str = "payload") -> DataFrame:
    """What is shown of repositories, with the other columns of the answers; an answer that is not a repository (no full name, owner or name) or no JSON gives no row.

    Counts that are no number are 0, flags that are not true are false, texts that are none are null. A licence that the host could not tell is none.
    """
    rest = [c for c in answers.columns if c != payload]
    v = F.col("_v")
    # a generated column is worked out once a row: a plain one would be parsed again for every field
    whole = answers.select(*rest, F.explode(F.array(F.try_parse_json(payload))).alias("_v"))
    count = lambda path: F.coalesce(_number(v, path), F.lit(0.0))
    out = whole.select(
        *rest, _text(v, "$.owner.login").alias("owner"), _text(v, "$.name").alias("name"), _text(v, "$.full_name").alias("full_name"), _text(v, "$.description").alias("description"), _text(v, "$.html_url").alias("html_url"),
        _text(v, "$.clone_url").alias("clone_url"), F.coalesce(_text(v, "$.default_branch"), F.lit("main")).alias("default_branch"), count("$.stargazers_count").alias("stars"), count("$.forks_count").alias("forks"),
        count("$.open_issues_count").alias("open_issues"), _text(v, "$.language").alias("language"), F.nullif(_text(v, "$.license.spdx_id"), F.lit("NOASSERTION")).alias("license"), F.slice(_strings(v, "$.topics"), 1, TOPICS).alias("topics"),
        _text(v, "$.pushed_at").alias("pushed_at"), _text(v, "$.created_at").alias("created_at"), _true(v, "$.archived").alias("archived"), _true(v, "$.fork").alias("fork"), _true(v, "$.private").alias("private"), count("$.size").alias("size_kb"),
    )
    url = lambda c, end: F.coalesce(F.col(c), F.concat(F.lit("https://github.com/"), F.col("full_name"), F.lit(end)))
    return out.filter("full_name is not null and owner is not null and name is not null").withColumns({"html_url": url("html_url", ""), "clone_url": url("clone_url", ".git")})


def _count(v: Column, path: str) -> Column:
    """A whole number from 0, rounded down, or null."""
    n = _number(v, path)
    return F.when(n >= 0, F.floor(n).cast("long"))


def people(answers: DataFrame, payload: str = "payload") -> DataFrame:
    """What is shown of people; an answer without a login gives no row. Counts that are no number from 0 are null, as is the year of a time that cannot be read."""
    rest = [c for c in answers.columns if c != payload]
    v = F.col("_v")
    whole = answers.withColumn("_v", F.try_parse_json(payload))
    out = whole.select(
        *rest, _text(v, "$.login").alias("login"), _text(v, "$.name").alias("name"), _text(v, "$.bio").alias("bio"), _text(v, "$.location").alias("location"), _text(v, "$.company").alias("company"),
        F.year(F.try_to_timestamp(_text(v, "$.created_at"))).alias("joined_year"), _count(v, "$.public_repos").alias("public_repos"), _count(v, "$.followers").alias("followers"),
    )
    return out.filter("login is not null")


def repository_stats(answers: DataFrame, payload: str = "payload") -> DataFrame:
    """(top_language, stars_received, stars_approximate, best_known) of a search for a person's repositories, most starred first; nulls and false where it found none.

    The language is that of most of them (of ties the one that comes first); stars are approximate where the search had more than it listed. An answer lists at most a page.
    """
    rest = [c for c in answers.columns if c != payload]
    whole = answers.withColumn("_v", F.try_parse_json(payload))
    items = F.coalesce(F.try_variant_get("_v", "$.items", "array<variant>"), F.array().cast("array<variant>"))
    each = F.transform(items, lambda x: F.struct(F.coalesce(_count(x, "$.stargazers_count"), F.lit(0)).alias("stars"), _text(x, "$.language").alias("language"), _text(x, "$.name").alias("name")))
    out = whole.select(*rest, "_v", each.alias("_i"))
    languages = F.filter(F.transform("_i", lambda x: x["language"]), lambda x: x.isNotNull())
    counted = F.transform(F.array_distinct(languages), lambda x: F.struct((-F.size(F.filter(languages, lambda y: y == x))).alias("n"), F.array_position(languages, x).alias("at"), x.alias("language")))
    some = F.size("_i") > 0
    total = F.coalesce(_count(F.col("_v"), "$.total_count"), F.size("_i").cast("long"))
    return out.select(
        *rest, F.when(some, F.get(F.array_sort(counted), 0)["language"]).alias("top_language"), F.when(some, F.aggregate("_i", F.lit(0).cast("long"), lambda a, x: a + x["stars"])).alias("stars_received"),
        (some & (total > F.size("_i"))).alias("stars_approximate"), F.get("_i", 0)["name"].alias("best_known"),
    )
