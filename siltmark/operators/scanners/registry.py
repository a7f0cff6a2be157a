"""All rules, and the scan that runs them, suppresses and scores."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...session import checkpointed
from .. import metrics
from ..config import CONFIG_FILE, configured_scores, kept_files, read_configs, unmuted
from ..findings import SCANNERS, apply_mutes, drop_ignored, select_scanners
from . import clones, code, dead, deps, docs, files, workflows
from .base import FINDINGS, Snapshot

Rule = Callable[[Snapshot], DataFrame | None]
RULES: dict[str, Rule] = {
    "env-lifecycle": code.env_lifecycle, "stale-branch": files.stale_branches, "todo-debt": code.todo_debt, "secrets": code.secrets, "dependency-funeral": deps.dependency_funeral,
    "vulnerable-deps": deps.vulnerable_deps, "outdated-deps": deps.outdated_deps, "lockfile-drift": files.lockfile_drift, "dead-code": dead.dead_code, "project-hygiene": files.project_hygiene,
    "leftover-debug": code.leftover_debug, "broken-doc-links": docs.broken_doc_links, "bus-factor": files.bus_factor, "repo-bloat": files.repo_bloat, "dockerfile": docs.dockerfile,
    "skipped-tests": code.skipped_tests, "commented-code": code.commented_code, "insecure-code": code.insecure_code, "dead-links": docs.dead_links, "workflow-security": workflows.workflow_security,
    "eol-runtime": docs.eol_runtime, "docs-drift": docs.docs_drift, "config-conflict": files.config_conflicts, "license-risk": deps.license_risk, "ci-health": workflows.ci_health,
    "duplicate-code": clones.duplicate_code, "supply-chain": deps.supply_chain,
}


def scan(s: Snapshot, only: list[str] | None = None, mutes: list[dict] | None = None, rules: dict[str, Rule] | None = None) -> tuple[DataFrame, dict[str, str]]:
    """(findings of all rules after inline and configured suppression, errors of rules whose plan could not be made).

    A rule whose adapter is absent gives nothing; one that fails while it is planned is left out and named, and the others go on.
    """
    spark = s.files.sparkSession
    every = {**RULES, **(rules or {})}
    names = [n for n in (*select_scanners(only)[0], *(rules or {}))] if rules else select_scanners(only)[0]
    parts, errors = [], {}
    for k, name in enumerate(n for n in names if n in every):
        try:
            out = every[name](s)
            if out is not None:
                parts.append(out.withColumn("scanner_ord", F.lit(SCANNERS.index(name) if name in SCANNERS else 100 + k)))
        except Exception as e:  # noqa: BLE001  a rule must not stop the others
            errors[name] = f"{type(e).__name__}: {e}"[:500]
    if not parts:
        return spark.createDataFrame([], FINDINGS), errors
    all_ = reduce(DataFrame.unionByName, parts)
    lines = s.lines(s.matching(".", "rot-ignore"))
    return apply_mutes(drop_ignored(all_, lines), mutes or []), errors


def scan_configured(s: Snapshot, only: list[str] | None = None, rules: dict[str, Rule] | None = None, config_file: str = CONFIG_FILE) -> tuple[DataFrame, DataFrame, dict[str, str]]:
    """(findings, scores, errors) of a scan in which each repository's own configuration file says what is left out, what is muted and what findings weigh; all repositories in one job."""
    configs = checkpointed(read_configs(s.files, config_file).withColumn("repo_id", F.col("repo_id").cast("string")))
    files = s.files.withColumn("repo_id", F.col("repo_id").cast("string"))
    findings, errors = scan(replace(s, files=kept_files(files, configs)), only, None, rules)
    left = unmuted(findings, configs)
    return left, configured_scores(left, configs, files.select("repo_id")), errors


def truncated(s: Snapshot, only: list[str] | None = None) -> DataFrame:
    """(repo_id, scanner, found, left_out): how many findings each rule has without any limit, and how many of them its limits leave out, where they do."""
    count = lambda findings, name: findings.groupBy("repo_id", "scanner").agg(F.count("*").alias(name))
    every = count(scan(replace(s, limits=None), only)[0], "found")
    shown = count(scan(s, only)[0], "shown")
    out = every.join(shown, ["repo_id", "scanner"], "left").withColumn("left_out", F.col("found") - F.coalesce("shown", F.lit(0)))
    return out.filter("left_out > 0").select("repo_id", "scanner", "found", "left_out")


def report(s: Snapshot, findings: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Score, grade and lines of code of every repository in the snapshot, those without findings too."""
    repos = s.files.select(F.col("repo_id").cast("string").alias("repo_id")).distinct()
    loc = metrics.lines_of_code(s.lines(s.matching(r"\.\w+$")).withColumn("repo_id", F.col("repo_id").cast("string")), "repo_id").select("repo_id", F.col("loc").alias("lines_of_code"))
    return metrics.repo_scores(findings, weights, repos).join(loc, "repo_id", "left").fillna(0, ["lines_of_code"])
