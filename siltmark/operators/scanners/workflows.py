"""Rules about workflow files, read from the nodes of their YAML."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..findings import cap
from .base import TESTS, WORKFLOW, Snapshot, at, found
from .files import CI, OTHER_CI

# What an outsider controls in an event, whose actions are the host's own, how bad each finding is, and what runs tests, rewrites them or changes the repository.
INJECTABLE = "github.event.issue.title github.event.issue.body github.event.pull_request.title github.event.pull_request.body github.event.comment.body github.event.review.body github.event.review_comment.body github.event.head_commit.message github.event.commits github.event.pull_request.head.ref github.event.pull_request.head.label github.head_ref".split()
FIRST_PARTY = r"^(?i:actions|github|docker)/"
SEVERITY = {"pr-target-checkout": "critical", "script-injection": "critical", "action-unpinned": "warning", "action-tag": "warning", "action-tag-first-party": "info", "no-permissions": "warning", "self-hosted-runner": "warning"}
TEST_INVOCATION = r"(?i)\b(?:npm|pnpm|yarn|bun)\s+(?:run\s+)?test\b|\b(?:vitest|jest|mocha|ava|playwright|cypress|karma|tap\b)|\bpytest\b|\bpython\s+-m\s+(?:pytest|unittest)\b|\btox\b|\bnose2?\b|\bgo\s+test\b|\bcargo\s+test\b|\bmvn\s+(?:.*\s)?test\b|\bgradle(?:w)?\s+.*\btest\b|\bmake\s+.*test\b|\brake\s+(?:test|spec)\b|\brspec\b|\bphpunit\b|\bdotnet\s+test\b|\bbazel\s+test\b|\bnx\s+.*\btest\b|\bturbo\s+run\s+.*test\b|\bct_run\b|\bmix\s+test\b|\bswift\s+test\b"
TEST_ACTION = r"(?i)uses:\s*\S*(?:test|coverage|codecov|coveralls|sonar)"
REGENERATES = r"(?:^|\s)(?:-u|--update|--update-snapshots?|--write|--fix)(?:\s|$)"
MUTATES = r"\bgit\s+(?:commit|push|add)\b"
DISCARDS = r"(?:\|\|\s*(?:true|:)|;\s*exit\s+0)\s*$"

TITLES = {
    "pr-target-checkout": "Code of a pull request runs with this repository's rights", "script-injection": "A shell command holds text that an outsider writes", "action-unpinned": "Action without a version", "action-tag": "Action of others by a tag that can move",
    "action-tag-first-party": "Action by a tag that can move", "no-permissions": "The workflow's token has all default rights", "self-hosted-runner": "Runs on an own machine",
    "silenced-failure": "A failing check passes because of continue-on-error", "disabled": "A step that is listed but never runs", "swallowed": "The outcome of the tests is thrown away",
}
ACTION_FILE = r"(?i)(^|/)action\.ya?ml$"
FILES = f"{WORKFLOW}|{ACTION_FILE}"
#: Columns that a node of a file brings along.
_FILE = ["repo_id", "path", "file_ord"]


def _last() -> Column:
    return F.element_at("keys", -1)


def run_lines(nodes: DataFrame) -> DataFrame:
    """(file, step, line, text, shown): lines of the scripts of `run` keys, without comments; step is the path of the map that holds the key, shown the line as the file has it."""
    runs = nodes.filter((_last() == "run") & F.col("value").isNotNull()).withColumn("step", F.array_join(F.slice("keys", 1, F.size("keys") - 1), "\n"))
    block = F.col("kind") == "block"
    each = runs.select(*_FILE, "step", "line", "source", block.alias("block"), F.posexplode(F.when(block, F.split("value", "\n", -1)).otherwise(F.array("value"))).alias("k", "raw"))
    text = F.trim(F.regexp_replace("raw", r"(^|\s+)#.*$", ""))
    at_line = F.col("line") + F.when(F.col("block"), F.col("k") + 1).otherwise(0)
    return each.select(*_FILE, "step", at_line.alias("line"), text.alias("text"), F.when(F.col("block"), text).otherwise(F.col("source")).alias("shown")).filter("text <> ''")


def triggers(nodes: DataFrame) -> DataFrame:
    """(repo_id, path, trigger) of workflows: what `on` says, as one name, a list in either form, or the keys of a map."""
    on = nodes.filter((F.get("keys", 0) == "on") & (F.size("keys") <= 2))
    name = F.when(F.col("value").isNotNull() & ((F.size("keys") == 1) | F.get("keys", 1).rlike(r"^\d+$")), F.col("value")).when(F.size("keys") == 2, F.get("keys", 1))
    return on.select("repo_id", "path", F.trim(name).alias("trigger")).filter("trigger <> ''").distinct()


def _titled(rule: str = "rule") -> Column:
    return F.create_map(*(F.lit(x) for kv in TITLES.items() for x in kv))[F.col(rule)]


def workflow_security(s: Snapshot) -> DataFrame:
    """Actions and runners that others control, outsiders' text in scripts, foreign code with own rights, and tokens with all rights."""
    files = s.workflow_files.filter(F.col("path").rlike(WORKFLOW))
    hit = lambda line, bare, rule, action=F.lit(None).cast("string"): F.struct(line.cast("int").alias("line"), bare.alias("bare"), rule.alias("rule"), action.alias("action"))
    last = lambda x: F.element_at(x["keys"], -1)
    ref = lambda x: F.regexp_extract(x["value"], r"^\s*(\S+)", 1)
    version, name = (lambda x: F.regexp_extract(ref(x), r"@([^@]*)$", 1)), (lambda x: F.regexp_replace(ref(x), r"@[^@]*$", ""))
    kind = lambda x: F.when(version(x) == "", "action-unpinned").when(name(x).rlike(FIRST_PARTY), "action-tag-first-party").otherwise("action-tag")
    loose = lambda x: (last(x) == "uses") & (ref(x) != "") & ~ref(x).startswith("./") & ~ref(x).startswith("docker://") & ~version(x).rlike(r"(?i)^[0-9a-f]{40}$")
    uses = F.transform(F.filter("nodes", loose), lambda x: hit(x["line"], x["source"], kind(x), name(x)))
    own = F.filter("nodes", lambda x: F.array_contains(x["keys"], "runs-on") & x["value"].contains("self-hosted"))
    machine = F.array_distinct(F.transform(own, lambda x: hit(x["line"], x["source"], F.lit("self-hosted-runner"))))
    # what a file says as a whole is worked out where it lies
    target = F.exists("nodes", lambda x: x["source"].rlike(r"\bpull_request_target\b") | F.coalesce(x["value"].rlike(r"\bpull_request_target\b"), F.lit(False)))
    foreign = F.filter("nodes", lambda x: (last(x) == "ref") & F.coalesce(x["value"].rlike(r"github\.event\.pull_request\.head|github\.head_ref"), F.lit(False)))
    head = F.array_max(F.transform(foreign, lambda x: hit(x["line"], x["source"], F.lit("pr-target-checkout"))))
    top = lambda key: F.exists("nodes", lambda x: (F.size(x["keys"]) == 1) & (F.get(x["keys"], 0) == key))
    a = F.when(head.isNotNull() & target, F.array(head))
    b = F.when(top("jobs") & ~top("permissions"), F.array(hit(F.lit(1), F.lit(""), F.lit("no-permissions"))))
    none = F.array().cast("array<struct<line:int,bare:string,rule:string,action:string>>")
    whole = files.select(*_FILE, F.inline(F.concat(uses, machine, F.coalesce(a, none), F.coalesce(b, none))))
    scripts = files.select(*_FILE, F.inline(F.filter("nodes", lambda x: x["value"].contains("${{"))))
    lines = run_lines(scripts).filter(F.col("text").contains("${{") & reduce(lambda a, b: a | b, (F.col("text").contains(x) for x in INJECTABLE)))
    hits = whole.unionByName(lines.select(*_FILE, F.col("line").cast("int").alias("line"), F.col("shown").alias("bare"), F.lit("script-injection").alias("rule"), F.lit(None).cast("string").alias("action")))
    severity = F.create_map(*(F.lit(x) for kv in SEVERITY.items() for x in kv))[F.col("rule")]
    title = F.concat_ws(": ", _titled(), "action")
    order = F.when(F.col("rule").isin("pr-target-checkout", "no-permissions"), 9_000_000).otherwise(F.col("line") * 10)
    out = found(s.aged(hits), "workflow-security", "security", id=F.concat_ws("-", "rule", "path", F.col("line").cast("string")), severity=severity, title=title, location=at(), detail=_titled(), evidence=F.nullif(F.substring("bare", 1, 200), F.lit("")), ord=F.col("file_ord") * 10_000_000 + order)
    return cap(out, s.most("workflow-security"))


def ci_health(s: Snapshot) -> DataFrame:
    """Checks that cannot fail: silenced, switched off or swallowed steps; tests that no workflow runs; workflows that no pull request starts."""
    nodes = s.workflow_nodes
    flow = F.col("path").rlike(WORKFLOW)
    trig = triggers(nodes.filter(flow))
    live = trig.filter("trigger in ('push', 'pull_request', 'merge_group')").select("repo_id", "path").distinct()
    ours = nodes.filter(~flow).unionByName(nodes.filter(flow).join(live, ["repo_id", "path"], "left_semi").select(nodes.columns))
    lines = run_lines(ours)
    step = F.array_join(F.slice("keys", 1, F.size("keys") - 1), "\n")
    works = lines.groupBy("repo_id", "path", "step").agg(F.bool_or(F.col("text").rlike(REGENERATES) | F.col("text").rlike(MUTATES)).alias("works"))
    told = ours.filter((F.size("keys") > 1) & (F.element_at("keys", -1) == "continue-on-error") & (F.lower("value") == "true") & F.element_at("keys", -2).rlike(r"^\d+$")).withColumn("step", step)
    silenced = told.join(works.filter("not works"), ["repo_id", "path", "step"], "left_semi")
    off = ours.filter((_last() == "if") & (F.lower("value") == "false"))
    text = F.col("text")
    lost = lines.filter(text.rlike(TEST_INVOCATION) & ~text.rlike(REGENERATES) & text.rlike(DISCARDS))
    pick = lambda df, bare, rule: df.select(*_FILE, "line", F.col(bare).alias("bare"), F.lit(rule).alias("rule"))
    hits = s.aged(pick(silenced, "source", "silenced-failure").unionByName(pick(off, "source", "disabled")).unionByName(pick(lost, "shown", "swallowed")))
    a = found(hits, "ci-health", "hygiene", id=F.concat_ws("-", F.lit("ci"), "rule", "path", F.col("line").cast("string")), severity="warning", title=_titled(), location=at(), detail=_titled(), evidence=F.substring("bare", 1, 200))
    flows = s.matching(WORKFLOW).groupBy("repo_id").agg(F.min_by("path", "file_ord").alias("path"), F.count("*").alias("n"))
    other = (F.col("path").rlike(CI) & ~flow) | F.col("path").isin(*OTHER_CI)
    tests = F.col("path").rlike(TESTS) | F.col("path").rlike(r"(^|/)e2e/|Test\.(java|kt|cs)$|_spec\.rb$")
    runs = F.col("path").rlike(FILES) & F.coalesce(F.col("content").rlike(TEST_INVOCATION) | F.col("content").rlike(TEST_ACTION), F.lit(False))
    facts = s.tree.groupBy("repo_id").agg(F.bool_or(tests).alias("tests"), F.bool_or(other).alias("other"), F.bool_or(runs).alias("runs"))
    never = flows.join(facts.filter("tests and not other and not runs"), "repo_id")
    b = found(never, "ci-health", "hygiene", id=F.lit("ci-tests-not-run"), severity="warning", title=F.lit("There are tests that no workflow runs"), location=F.col("path"), detail="No workflow calls a test runner.", ord=F.lit(10**15))
    gates = trig.groupBy("repo_id").agg(F.bool_or(F.col("trigger") == "push").alias("push"), F.bool_or(F.col("trigger").isin("pull_request", "merge_group")).alias("gated"), F.array_join(F.sort_array(F.collect_set("trigger")), ", ").alias("all"))
    c = found(flows.join(gates.filter("push and not gated"), "repo_id"), "ci-health", "hygiene", id=F.lit("ci-no-pr-trigger"), severity="info", title=F.lit("Pull requests start no workflow"), location=F.col("path"), detail="Changes are checked only after they have landed.", evidence=F.concat(F.lit("triggers: "), F.col("all")), ord=F.lit(10**15 + 1))
    return cap(a.unionByName(b).unionByName(c), s.most("ci-health"))
