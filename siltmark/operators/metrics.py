"""Aggregations over findings: (repo_id, id, category, severity, title, location, age_days, detail, scanner, ord)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..session import checkpointed


def severity_counts(findings: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Findings of each severity, and all of them."""
    return findings.groupBy(*(by or ["repo_id"])).agg(*(F.count_if(F.col("severity") == s).alias(s) for s in S.SEVERITIES), F.count("*").alias("findings"))


def repo_scores(findings: DataFrame, weights: dict[str, float] | None = None, repos: DataFrame | None = None) -> DataFrame:
    """Score and grade of each repository. With `repos`, one without findings has 100 points."""
    counts = severity_counts(findings)
    if repos is not None:
        counts = repos.select("repo_id").distinct().join(counts, "repo_id", "left").fillna(0, [*S.SEVERITIES, "findings"])
    out = counts.withColumn("score", S.score(*(F.col(s) for s in S.SEVERITIES), weights))
    return out.withColumn("grade", S.grade(F.col("score")))


def grade_distribution(scores: DataFrame) -> DataFrame:
    return scores.groupBy("grade").agg(F.count("*").alias("repos"))


def penalty_breakdown(findings: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """For each repository and severity: findings, penalty, and whether some are charged less than in full."""
    w = {**S.WEIGHTS, **(weights or {})}
    counts = severity_counts(findings)
    rows = F.array(*(F.struct(F.lit(s).alias("severity"), F.col(s).alias("findings"), S.tier_penalty(F.col(s), s, w[s]).alias("penalty"), (F.col(s) > S.FULL[s]).alias("discounted")) for s in S.SEVERITIES))
    return counts.select("repo_id", F.inline(rows))


def issue_costs(findings: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Each finding with its share of its severity's penalty. Counts come from a map-side combined aggregate, so a huge repository is no hot group."""
    tiers = penalty_breakdown(findings, weights).filter("findings > 0").select("repo_id", "severity", (F.col("penalty") / F.col("findings")).alias("cost"))
    return findings.join(tiers, ["repo_id", "severity"], "left").withColumn("cost", F.coalesce("cost", F.lit(0.0)))


def category_costs(findings: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Points and findings of each category; a severity's penalty is shared equally by its findings."""
    by = findings.groupBy("repo_id", "category", "severity").agg(F.count("*").alias("n"))
    tiers = penalty_breakdown(findings, weights).filter("findings > 0").select("repo_id", "severity", (F.col("penalty") / F.col("findings")).alias("cost"))
    return by.join(tiers, ["repo_id", "severity"]).groupBy("repo_id", "category").agg(F.sum(F.col("cost") * F.col("n")).alias("cost"), F.sum("n").alias("findings"))


def category_scores(findings: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Each category scored as if it were alone."""
    out = severity_counts(findings, ["repo_id", "category"]).withColumn("score", S.score(*(F.col(s) for s in S.SEVERITIES), weights))
    return out.withColumn("grade", S.grade(F.col("score"))).select("repo_id", "category", "score", "grade", "findings")


def age_histogram(findings: DataFrame) -> DataFrame:
    """Findings of each severity in each fixed age bucket; empty buckets are there too."""
    names = findings.sparkSession.createDataFrame([(n, k) for k, (n, _) in enumerate(S.AGE_BUCKETS)], "bucket string, bucket_order int")
    age = F.greatest(F.lit(0), F.coalesce("age_days", F.lit(0)))
    counts = severity_counts(findings.withColumn("bucket", S.bucket(age, S.AGE_BUCKETS)), ["bucket"]).withColumnRenamed("findings", "total")
    return F.broadcast(names).join(counts, "bucket", "left").fillna(0, [*S.SEVERITIES, "total"])


def median_age(findings: DataFrame, by: list[str]) -> DataFrame:
    """Whole median age; of an even number the mean of the middle two, halves upwards."""
    return findings.groupBy(*by).agg(S.half_up(F.median(F.greatest(F.lit(0), F.coalesce("age_days", F.lit(0))))).alias("median_age_days"))


def hotspot_files(findings: DataFrame, limit: int = 6, weights: dict[str, float] | None = None) -> DataFrame:
    """The files of each repository that cost most; files with one finding only where no file has more."""
    w = {**S.WEIGHTS, **(weights or {})}
    files = findings.withColumn("path", S.location_path(F.col("location"))).filter("path is not null")
    spots = files.groupBy("repo_id", "path").agg(F.sum(S.severity_value(F.col("severity"), w)).alias("weight"), F.count("*").alias("findings"), *(F.count_if(F.col("severity") == s).alias(s) for s in S.SEVERITIES))
    # files with several findings come first, so whether a repository has any shows in the ranked ones: the findings are read once, and tasks keep `limit` files of each repository before any meet
    order = Window.partitionBy("repo_id").orderBy(F.desc(F.col("findings") > 1), F.desc("weight"), F.desc("findings"), "path")
    ranked = spots.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    most = F.max("findings").over(Window.partitionBy("repo_id"))
    return ranked.withColumn("most", most).filter((F.col("findings") > 1) | (F.col("most") == 1)).drop("most")


def top_findings(findings: DataFrame, limit: int, by: list[str] | None = None) -> DataFrame:
    """Worst severity first, then the oldest, then in order; at most `limit` (none if negative) of each group, or of all."""
    order = [S.severity_rank(F.col("severity")), F.desc("age_days"), F.col("ord"), F.col("id")]
    if by:
        return findings.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= max(limit, 0))
    return findings.orderBy(*order).limit(max(limit, 0))


def quick_wins(findings: DataFrame, limit: int = 8) -> DataFrame:
    return top_findings(findings, limit, ["repo_id"]).withColumn("hours", S.severity_value(F.col("severity"), S.HOURS))


def debt_hours(findings: DataFrame, by: list[str]) -> DataFrame:
    out = findings.groupBy(*by).agg(F.sum(S.severity_value(F.col("severity"), S.HOURS)).alias("hours"))
    return out.withColumn("effort", S.effort_text(F.col("hours")))


def issue_density(counts: DataFrame, lines: str = "lines_of_code") -> DataFrame:
    """Findings for a thousand lines; null where no line is known."""
    return counts.withColumn("density", F.when(F.col(lines) > 0, F.col("findings") / (F.col(lines) / 1000.0)))


def scanner_groups(findings: DataFrame) -> DataFrame:
    """Scanners with their worst severity and size, in the order to show them."""
    out = findings.groupBy("repo_id", "scanner").agg(F.count("*").alias("findings"), F.min(S.severity_rank(F.col("severity"))).alias("worst_rank"))
    rank = F.row_number().over(Window.partitionBy("repo_id").orderBy("worst_rank", F.desc("findings"), "scanner"))
    return out.withColumn("position", rank).withColumn("worst", F.element_at(F.array(*map(F.lit, S.SEVERITIES)), F.col("worst_rank") + 1)).drop("worst_rank")


def lines_of_code(lines: DataFrame, *by: str) -> DataFrame:
    """(by, files, loc) of lines (path, text, ...): files, and lines that are not blank."""
    return lines.groupBy(*by).agg(F.countDistinct("path").alias("files"), F.count_if(F.trim("text") != "").alias("loc"))


def tree_nodes(findings: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Counts, weight, worst severity and depth of the root, every folder and every file: each finding counts once for each of its prefixes.

    Findings without a file gather in one bucket below the root.
    """
    w = {**S.WEIGHTS, **(weights or {})}
    path = F.nullif(S.location_path(F.col("location")), F.lit("."))
    each = findings.select("repo_id", "severity", path.alias("path"))
    sums = [*(F.count_if(F.col("severity") == s).alias(s) for s in S.SEVERITIES), F.count("*").alias("findings"), F.sum(S.severity_value(F.col("severity"), w)).alias("weight")]
    # a file's row is its own; what lies above files is summed in the tasks that read findings, so only folders meet there, however many files they hold
    parts = F.split("path", "/")
    files = each.filter("path is not null").groupBy("repo_id", "path").agg(*sums).select("repo_id", F.col("path").alias("node"), F.lit("file").alias("kind"), F.size(parts).alias("depth"), *S.SEVERITIES, "findings", "weight")
    prefixes = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    nodes = F.when(F.col("path").isNull(), F.array(F.lit(""), F.lit("(other)"))).otherwise(prefixes)
    above = each.select("repo_id", "severity", "path", F.posexplode(nodes).alias("depth", "node"))
    kind = F.when(F.col("node") == "", "root").when(F.col("path").isNull(), "bucket").otherwise("dir")
    out = files.unionByName(above.withColumn("kind", kind).groupBy("repo_id", "node", "kind", "depth").agg(*sums))
    return out.withColumn("worst", F.when(F.col("critical") > 0, "critical").when(F.col("warning") > 0, "warning").when(F.col("info") > 0, "info"))


def compressed_tree(nodes: DataFrame) -> DataFrame:
    """Folders with one child, a folder too, are joined with it: each remaining folder's label spans what it swallowed. Files meet only what their folder knows, one row a folder."""
    folders = nodes.filter("kind in ('dir', 'file')").withColumn("parent", F.regexp_replace(F.regexp_extract("node", r"^(.*/)?[^/]*$", 1), "/$", ""))
    merged = (F.count("*") == 1) & (F.max("kind") == "dir") & (F.min("kind") == "dir") & (F.col("parent") != "")
    holders = checkpointed(folders.groupBy("repo_id", "parent").agg(merged.alias("merged")))
    # the label starts after the nearest ancestor that stays
    parts = F.split("parent", "/")
    up = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    stays = holders.filter("not merged").select("repo_id", F.col("parent").alias("up"), F.length("parent").alias("at"))
    nearest = holders.select("repo_id", "parent", F.explode(up).alias("up")).join(stays, ["repo_id", "up"], "left").groupBy("repo_id", "parent").agg(F.coalesce(F.max("at"), F.lit(0)).alias("at"))
    dirs = folders.filter("kind = 'dir'").join(holders.filter("merged").select("repo_id", F.col("parent").alias("node")), ["repo_id", "node"], "left_anti")
    kept = folders.filter("kind = 'file'").unionByName(dirs).join(nearest, ["repo_id", "parent"])
    return kept.withColumn("label", F.expr("substring(node, if(at = 0, 1, at + 2))")).drop("at", "parent")


def shared_findings(findings: DataFrame) -> DataFrame:
    """Findings (category, title) that at least two repositories have, at their worst severity."""
    out = findings.groupBy("category", "title").agg(F.countDistinct("repo_id").alias("repos"), F.min(S.severity_rank(F.col("severity"))).alias("rank")).filter("repos >= 2")
    return out.withColumn("severity", F.element_at(F.array(*map(F.lit, S.SEVERITIES)), F.col("rank") + 1)).drop("rank")


def batch_summary(scores: DataFrame, findings: DataFrame) -> DataFrame:
    """Repositories worst first, with the category that has most findings. A repository that failed has a null score and comes last."""
    top = findings.groupBy("repo_id", "category").agg(F.count("*").alias("n")).groupBy("repo_id").agg(F.max_by("category", F.struct("n", "category")).alias("top_category"))
    out = scores.join(top, "repo_id", "left")
    return out.orderBy(F.asc_nulls_last("score"), F.desc("critical"), "repo_id")


def portfolio(scores: DataFrame, findings: DataFrame) -> DataFrame:
    """One row: repositories, mean score (halves upwards) over those that have one, critical findings and hours."""
    a = scores.agg(F.count("*").alias("repos"), S.half_up(F.avg("score")).alias("avg_score"), F.coalesce(F.sum("critical"), F.lit(0)).alias("critical"))
    return a.crossJoin(F.broadcast(findings.agg(F.coalesce(F.sum(S.severity_value(F.col("severity"), S.HOURS)), F.lit(0.0)).alias("hours"))))


def language_shares(profile: DataFrame, top: int = 6) -> DataFrame:
    """(repo_id, language, files, loc, share) of each repository's largest languages, the rest as Other; shares by files where no line is known."""
    total = profile.groupBy("repo_id").agg(F.sum("loc").alias("all_loc"), F.sum("files").alias("all_files"))
    by = F.when(F.col("all_loc") > 0, F.col("loc")).otherwise(F.col("files"))
    ranked = profile.join(total, "repo_id").withColumn("metric", by).withColumn("rank", F.row_number().over(Window.partitionBy("repo_id").orderBy(F.desc("metric"), "language")))
    name = F.when(F.col("rank") <= top, F.col("language")).otherwise("Other")
    out = ranked.groupBy("repo_id", name.alias("language"), (F.col("rank") > top).alias("rest")).agg(F.sum("files").alias("files"), F.sum("loc").alias("loc"), F.sum("metric").alias("m"), F.first("all_loc").alias("l"), F.first("all_files").alias("f"))
    whole = F.when(F.col("l") > 0, F.col("l")).otherwise(F.greatest(F.col("f"), F.lit(1)))
    return out.select("repo_id", "language", "files", "loc", (F.col("m") / whole * 100).alias("share"))


def percentile_shares(scan_stats: DataFrame, targets: DataFrame, least: int = 30) -> DataFrame:
    """For each target (target_id, language, size, score): shares of scans strictly below and above it in the narrowest cut with enough scans.

    Cuts, narrowest first: language and size, language, size, all. Scores are first counted by value in one grouping-sets pass, so what targets join is small.
    """
    cubes = scan_stats.select("language", "size", "score").groupingSets([["language", "size", "score"], ["language", "score"], ["size", "score"], ["score"]], "language", "size", "score")
    levels = cubes.agg(F.grouping_id().alias("g"), F.count("*").alias("n"))
    basis = F.when(F.col("g") == 0, "language-size").when(F.col("g") == 2, "language").when(F.col("g") == 4, "size").otherwise("all")
    levels = levels.withColumn("basis", basis).filter("(basis not like 'language%' or language is not null)").drop("g")
    wanted = targets.select("target_id", "score", F.explode(F.array(*(F.struct(F.lit(b).alias("basis"), F.lit(k).alias("priority"), (F.col("language") if "language" in b else F.lit(None).cast("string")).alias("language"), (F.col("size") if "size" in b else F.lit(None).cast("string")).alias("size")) for k, b in enumerate(("language-size", "language", "size", "all"))))).alias("c")).select("target_id", F.col("score").alias("target"), "c.*")
    lv = levels.withColumnsRenamed({"language": "l", "size": "s", "basis": "b"})
    met = wanted.join(lv, (F.col("basis") == F.col("b")) & F.col("language").eqNullSafe(F.col("l")) & F.col("size").eqNullSafe(F.col("s")))
    cut = met.groupBy("target_id", "basis", "priority", "target").agg(F.sum("n").alias("sample"), F.sum(F.when(F.col("score") < F.col("target"), F.col("n")).otherwise(0)).alias("below"), F.sum(F.when(F.col("score") > F.col("target"), F.col("n")).otherwise(0)).alias("above"))
    best = cut.filter(F.col("sample") >= least).groupBy("target_id").agg(F.min_by(F.struct("basis", "sample", "below", "above"), "priority").alias("x")).select("target_id", "x.*")
    percent = lambda c: S.half_up(F.col(c) / F.col("sample") * 100)
    return best.select("target_id", "basis", "sample", percent("below").alias("better_than"), percent("above").alias("worse_than"))


def scan_summary(scan_stats: DataFrame, least: int = 30) -> DataFrame:
    """One row with count, whole median and grades; no row for fewer scans than `least`."""
    g = S.grade(F.col("score"))
    out = scan_stats.agg(F.count("*").alias("scans"), S.half_up(F.median("score")).alias("median_score"), *(F.count_if(g == x).alias(f"grade_{x.lower()}") for x in S.GRADES))
    return out.filter(F.col("scans") >= least)


def scan_stat(reports: DataFrame) -> DataFrame:
    """Anonymous facts of reports (generated_at, score, grade, languages array<struct<language,files,loc>>, tools array<string>, critical, warning, info).

    The language is that with most lines, the first of equals; no name, path or address is kept. Rows without a valid score and grade go.
    """
    ok = reports.filter(F.col("score").isNotNull() & ~F.isnan(F.col("score").cast("double")) & F.col("grade").rlike("^[A-F]$"))
    langs = F.coalesce("languages", F.array().cast("array<struct<language:string,files:int,loc:int>>"))
    best = F.aggregate(langs, F.struct(F.lit(None).cast("string").alias("language"), F.lit(-1).alias("loc")), lambda a, x: F.when(x["loc"] > a["loc"], F.struct(x["language"].alias("language"), x["loc"].cast("int").alias("loc"))).otherwise(a))
    loc = F.aggregate(langs, F.lit(0), lambda a, x: a + F.coalesce(x["loc"].cast("int"), F.lit(0)))
    has = lambda *names: reduce(Column.__or__, (F.array_contains(F.coalesce("tools", F.array().cast("array<string>")), n) for n in names))
    return ok.select(
        F.to_date("generated_at").alias("day"), F.greatest(F.lit(0), F.least(F.lit(100), S.half_up(F.col("score").cast("double")))).cast("int").alias("score"), "grade", best["language"].alias("language"),
        S.bucket(loc, S.SIZE_BUCKETS).alias("size"), "critical", "warning", "info", has("GitHub Actions", "GitLab CI", "CircleCI", "Travis CI").alias("ci"), has("Vitest", "Jest", "Mocha", "Playwright", "Cypress", "pytest").alias("tests"),
    )


# Tools in the order to show them, each with the names of files that show it (lower case; * within a name) or, with a slash, where they lie.
TOOLS = [
    ("Node.js", "package.json"), ("pnpm", "pnpm-lock.yaml"), ("Yarn", "yarn.lock"), ("npm", "package-lock.json"), ("TypeScript", "tsconfig*.json"), ("Next.js", "next.config.@"), ("Vite", "vite.config.@"), ("Tailwind CSS", "tailwind.config.@"),
    ("Docker", "dockerfile *.dockerfile"), ("Docker Compose", "compose.yml compose.yaml docker-compose.yml docker-compose.yaml"), ("GitHub Actions", ".github/workflows/*.yml .github/workflows/*.yaml"), ("Go modules", "go.mod"), ("pip", "requirements*.txt"),
    ("Poetry", "pyproject.toml"), ("Cargo", "cargo.toml"), ("Bundler", "gemfile"), ("Composer", "composer.json"), ("Maven", "pom.xml"), ("Gradle", "build.gradle build.gradle.kts"), ("Make", "makefile"), ("Vitest", "vitest.config.@"), ("Jest", "jest.config.@"), ("ESLint", ".eslintrc* eslint.config.@"),
]


def tools(files: DataFrame) -> DataFrame:
    """(repo_id, tools): the tools that a repository's files (repo_id, path) show, in a fixed order; case and kind of slash do not matter. A repository with none has an empty array."""
    import re

    def pattern(names: str) -> str:
        one = (re.escape(n).replace(r"\*", "[^/]*").replace("@", r"[mc]?[jt]s") for n in names.split())
        return rf"(^|/)({'|'.join(one)})$"

    path = F.lower(F.regexp_replace("path", r"\\", "/"))
    flags = files.groupBy("repo_id").agg(*(F.coalesce(F.bool_or(path.rlike(pattern(names))), F.lit(False)).alias(f"_{k}") for k, (_, names) in enumerate(TOOLS)))
    return flags.select("repo_id", F.array_compact(F.array(*(F.when(F.col(f"_{k}"), name) for k, (name, _) in enumerate(TOOLS)))).alias("tools"))


FORBIDDEN = {"repo", "repo_id", "owner", "name", "url", "host", "path", "visitor", "location"}


def assert_anonymous(df: DataFrame, forbidden: set[str] = FORBIDDEN) -> DataFrame:
    """The frame itself, after checking that no field at any depth has a forbidden name."""

    def names(kind):
        for f in getattr(kind, "fields", []):
            yield f.name
            yield from names(f.dataType)
        for inner in ("elementType", "keyType", "valueType"):
            if hasattr(kind, inner):
                yield from names(getattr(kind, inner))

    if bad := forbidden & set(names(df.schema)):
        raise ValueError(f"forbidden fields: {sorted(bad)}")
    return df
