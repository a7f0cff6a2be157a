"""Filters, suppression, search and caps over findings."""

from __future__ import annotations

import itertools
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions.text import glob_regex
from ..session import checkpointed

SCANNERS = (
    "env-lifecycle", "stale-branch", "todo-debt", "secrets", "dependency-funeral", "vulnerable-deps", "outdated-deps", "lockfile-drift", "dead-code", "project-hygiene",
    "leftover-debug", "broken-doc-links", "bus-factor", "repo-bloat", "dockerfile", "skipped-tests", "commented-code", "insecure-code", "dead-links", "workflow-security",
    "eol-runtime", "docs-drift", "config-conflict", "license-risk", "ci-health", "duplicate-code", "supply-chain",
)
# How ids of findings without a scanner begin; the longest prefix that fits decides.
ID_PREFIXES = {
    "insecure-": "insecure-code", "secret-": "secrets", "vuln-": "vulnerable-deps", "deadlink-": "dead-links", "doclink-": "broken-doc-links", "workflow-": "workflow-security",
    "dockerfile-": "dockerfile", "license-": "license-risk", "ci-health-": "ci-health", "docs-drift-": "docs-drift", "config-conflict-": "config-conflict", "duplicate-": "duplicate-code",
    "commented-": "commented-code", "skipped-": "skipped-tests", "debug-": "leftover-debug", "bloat-": "repo-bloat", "bus-": "bus-factor", "hygiene-": "project-hygiene", "dead-": "dead-code",
    "todo-": "todo-debt", "branch-": "stale-branch", "env-": "env-lifecycle", "dep-": "dependency-funeral", "outdated-": "outdated-deps", "lockfile-": "lockfile-drift", "eol-": "eol-runtime",
}
# Scanners and id prefixes of the two lenses.
MODES = {
    "security": (("insecure-code", "secrets", "vulnerable-deps", "workflow-security", "supply-chain"), ("insecure-", "secret-", "vuln-", "supply-")),
    "links": (("dead-links", "broken-doc-links"), ("deadlink-", "doclink-")),
}
# Words that stand for a category in a search.
SYNONYMS = {
    "security": "security secret secrets key keys credential credentials token tokens password passwords apikey leak leaked exposed aws stripe vulnerability vulnerable vuln cve ghsa advisory exploit",
    "env": "env environment config configuration variable variables dotenv undocumented missing",
    "dependency": "dependency dependencies package packages module modules npm library libraries outdated deprecated unused bloat",
    "branch": "branch branches stale merged abandoned prune behind",
    "todo": "todo todos fixme debt tech",
    "dead-code": "dead deadcode unused unreferenced orphan export",
    "hygiene": "hygiene readme license test tests testing ci pipeline workflow console log debug debugger docs documentation link links broken bus factor owner maintainer",
}


def select_scanners(only: list[str] | None = None) -> tuple[list[str], list[str]]:
    """(scanners in registry order, names that are unknown); all of them if none is asked for."""
    wanted = [x.strip() for x in only or [] if x.strip()]
    return [s for s in SCANNERS if not wanted or s in wanted], [x for x in wanted if x not in SCANNERS]


def resolve_scanner(scanner: Column, id_: Column) -> Column:
    """The finding's scanner, or the one its id suggests, or null."""
    out = F.lit(None).cast("string")
    for prefix, name in sorted(ID_PREFIXES.items(), key=lambda x: len(x[0])):
        out = F.when(id_.startswith(prefix), name).otherwise(out)
    return F.coalesce(F.nullif(scanner, F.lit("")), out)


def in_mode(findings: DataFrame, mode: str) -> DataFrame:
    """Findings of a lens: by scanner, or by id where no scanner is stamped."""
    scanners, prefixes = MODES[mode]
    stamped = F.coalesce(F.col("scanner"), F.lit("")) != ""
    return findings.filter(F.when(stamped, F.col("scanner").isin(*scanners)).otherwise(reduce(Column.__or__, (F.col("id").startswith(p) for p in prefixes))))


def filter_findings(findings: DataFrame, severity: str = "all", category: str = "all", scanner: str = "all", new_ids: DataFrame | None = None) -> DataFrame:
    """The conjunction of filters; severity may be all, actionable (not info) or one; new_ids keeps findings with those (repo_id, id)."""
    out = findings
    if severity == "actionable":
        out = out.filter(F.col("severity") != "info")
    elif severity != "all":
        out = out.filter(F.col("severity") == severity)
    if category != "all":
        out = out.filter(F.col("category") == category)
    if scanner != "all":
        out = out.filter(resolve_scanner(F.col("scanner"), F.col("id")) == scanner)
    return out if new_ids is None else out.join(new_ids.select("repo_id", "id").distinct(), ["repo_id", "id"], "left_semi")


def apply_mutes(findings: DataFrame, rules: list[dict]) -> DataFrame:
    """Findings that no rule mutes. A rule's id, category and path pattern must all fit; a rule with none of them mutes nothing."""
    path = F.coalesce(S.location_path(F.col("location")), F.col("location"))
    muted = F.lit(False)
    for r in rules:
        fits = [F.col(k) == r[k] for k in ("id", "category") if r.get(k)]
        if r.get("path"):
            fits.append(path.rlike(glob_regex(r["path"])))
        if fits:
            muted = muted | reduce(Column.__and__, fits)
    return findings.filter(~F.coalesce(muted, F.lit(False)))


IGNORE_LINE, IGNORE_NEXT = "rot-ignore", "rot-ignore-next-line"


def drop_ignored(findings: DataFrame, lines: DataFrame, same: str = IGNORE_LINE, following: str = IGNORE_NEXT) -> DataFrame:
    """Findings whose line has no ignore marker and whose line above has no next-line marker. lines: (repo_id, path, line, text)."""
    marks = lines.filter(F.col("text").contains(same)).select(
        "repo_id", F.col("path").alias("_path"), F.explode(F.when(F.col("text").contains(following), F.array(F.col("line") + 1)).otherwise(F.array(F.col("line")))).alias("_line")
    ).distinct()
    own = findings.withColumn("_path", S.location_path(F.col("location"))).withColumn("_line", S.location_line(F.col("location")))
    return own.join(marks, ["repo_id", "_path", "_line"], "left_anti").select(findings.columns)


def cap(findings: DataFrame, total: int | None, per_file: int | None = None) -> DataFrame:
    """The first findings of each file, then of each repository, in the order of ord."""
    out = findings
    if per_file is not None:
        w = Window.partitionBy("repo_id", S.location_path(F.col("location"))).orderBy("ord", "id")
        out = out.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= per_file).drop("_r")
    if total is not None:
        w = Window.partitionBy("repo_id").orderBy("ord", "id")
        out = out.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= total).drop("_r")
    return out


def live_and_snoozed(findings: DataFrame, snoozed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(findings that are not snoozed, those that are). snoozed: (repo_id, id)."""
    keys = snoozed.select("repo_id", "id").distinct()
    return findings.join(keys, ["repo_id", "id"], "left_anti"), findings.join(keys, ["repo_id", "id"], "left_semi")


def verdict_batches(findings: DataFrame, cached: DataFrame, categories: list[str], most: int = 40, size: int = 5) -> DataFrame:
    """Findings to send for a verdict: of enabled categories, not cached, at most so many of a repository, with a batch number within their category."""
    miss = findings.filter(F.col("category").isin(*categories)).join(cached.select("id").distinct(), "id", "left_anti")
    miss = cap(miss, most)
    nth = F.row_number().over(Window.partitionBy("repo_id", "category").orderBy("ord", "id"))
    return miss.withColumn("batch", F.floor((nth - 1) / size).cast("int"))


def search_terms(query: str) -> list[str]:
    return [t for t in re.split(r"[^a-z0-9_]+", query.strip().lower()) if t]


def search(findings: DataFrame, query: str) -> DataFrame:
    """Findings in which every term is found, with a relevance; all of them, with 0, for a query without terms.

    A term gives 3 if it is in the text, 2 if a word begins with it or it with a word, or it stands for the category, 1 for a word one edit away or a synonym in the text.
    """
    terms = search_terms(query)
    if not terms:
        return findings.withColumn("relevance", F.lit(0))
    text = F.lower(F.concat_ws(" ", *(F.coalesce(F.col(c), F.lit("")) for c in ("title", "detail", "location", "category", "severity", "scanner"))))
    words = F.filter(F.split(F.col("_text"), "[^a-z0-9_]+"), lambda w: w != "")

    def points(term: str) -> Column:
        cats = [c for c, s in SYNONYMS.items() if any(x.startswith(term) or term.startswith(x) for x in s.split())]
        near = F.exists(F.col("_words"), lambda w: w.startswith(term) | F.lit(term).startswith(w))
        typo = F.exists(F.col("_words"), lambda w: F.levenshtein(w, F.lit(term), 1) >= 0) if len(term) >= 4 else F.lit(False)
        other = reduce(Column.__or__, (F.col("_text").contains(s) for c in cats for s in SYNONYMS[c].split()), F.lit(False))
        return F.when(F.col("_text").contains(term), 3).when(near | F.col("category").isin(*cats), 2).when(typo | other, 1).otherwise(0)

    scored = findings.withColumn("_text", text).withColumn("_words", words).withColumn("_p", F.array(*(points(t) for t in terms)))
    return scored.filter(F.forall("_p", lambda p: p > 0)).withColumn("relevance", F.aggregate("_p", F.lit(0), lambda a, p: a + p)).drop("_text", "_words", "_p")


def search_tree(nodes: DataFrame, query: str) -> DataFrame:
    """Tree nodes whose path contains the query, and the folders above them to open; first marks the first match in each repository's order."""
    hit = nodes.filter(F.lower("node").contains(query.strip().lower()) & (F.col("node") != "")).select("repo_id", "node", F.lit("match").alias("why"))
    up = F.transform(F.sequence(F.lit(0), F.size(F.split("node", "/")) - 1), lambda n: F.array_join(F.slice(F.split("node", "/"), 1, n), "/"))
    above = hit.select("repo_id", F.explode(up).alias("node"), F.lit("open").alias("why")).distinct()
    first = hit.groupBy("repo_id").agg(F.min("node").alias("node")).withColumn("first", F.lit(True))
    return hit.unionByName(above).join(first, ["repo_id", "node"], "left").withColumn("first", F.coalesce("first", F.lit(False)) & (F.col("why") == "match"))


def reachable(seeds: DataFrame, edges: DataFrame, by: tuple[str, ...] = ("repo_id",), most_rounds: int | None = None) -> DataFrame:
    """Names that seeds lead to over edges (src, dst), seeds included; cycles end by themselves. Each round writes its new names, and only those, and only they go on.

    It goes on until a round finds no new name. With most_rounds, new names after so many rounds are an error, never a shorter result.
    """
    key = [*by, "name"]
    frontier = checkpointed(seeds.select(*key).distinct())
    step = checkpointed(edges.select(*by, F.col("src").alias("name"), "dst"))
    found = [frontier]
    for done in itertools.count():
        frontier = frontier.join(step, key).select(*by, F.col("dst").alias("name")).distinct()
        frontier = checkpointed(frontier.join(reduce(DataFrame.unionByName, found), key, "left_anti"))
        if frontier.isEmpty():
            return reduce(DataFrame.unionByName, found)
        if done == most_rounds:
            raise RuntimeError(f"names are still being found after {most_rounds} rounds")
        found.append(frontier)


def table_order(findings: DataFrame, searching: bool = False) -> DataFrame:
    """Findings in the order of a table: by relevance while searching, else the oldest first; ties by ord and id."""
    return findings.orderBy(*([F.desc("relevance")] if searching else [F.desc("age_days")]), "ord", "id")
