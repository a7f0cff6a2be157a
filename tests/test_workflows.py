"""Workflow rules on files in every form that YAML allows."""

import pytest

from siltmark.operators.scanners import RULES, Snapshot
from siltmark.operators.scanners import workflows as W

PLAIN = """\
name: ci
on:
  push:
    branches: [main]
  pull_request_target:
jobs:
  test:
    runs-on: [self-hosted, linux]
    steps:
      - uses: actions/checkout@v4  # tag
        with:
          ref: ${{ github.event.pull_request.head.sha }}
      - uses: owner/act
      - uses: ./local
      - uses: other/act@0123456789012345678901234567890123456789
      - name: t
        run: |
          echo ${{ github.event.issue.title }}
          # echo ${{ github.event.issue.body }}
          npm test || true
        env:
          TITLE: ${{ github.event.issue.title }}
      - run: pytest
        continue-on-error: true
        env:
          SAFE: ${{ github.event.comment.body }}
      - run: jest -u
        continue-on-error: true
      - uses: actions/cache@v4
        continue-on-error: true
      - name: off
        if: false
        run: make lint
"""
FORMS = """\
"on": [push, 'merge_group']
'permissions': {contents: read}
x-step: &step
  "uses": "owner/act@main"
  continue-on-error: true
jobs:
  a:
    "runs-on": ubuntu-latest
    strategy: {fail-fast: false, matrix: {os: [a, b]}}
    steps:
      - *step
      - {name: flow, run: "go test ./... || true", if: false}
      - <<: *step
        name: merged
      - name: folded
        run: >-
          git commit -am x
          && pytest
        "continue-on-error": true
  b:
    uses: owner/repo/.github/workflows/x.yml@v1
    permissions: write-all
"""
FILES = "repo_id string, path string, file_ord long, size long, content string"


def ids(spark, rule, **files):
    rows = [("r", p, k, len(c), c) for k, (p, c) in enumerate(files.items())]
    return {(r.id, r.severity) for r in RULES[rule](Snapshot(files=spark.createDataFrame(rows, FILES))).collect()}


CI = ".github/workflows/ci.yml"


def test_plain_workflow(spark):
    at = lambda rule, line, sev: (f"{rule}-{CI}-{line}", sev)
    assert ids(spark, "workflow-security", **{CI: PLAIN}) == {
        at("self-hosted-runner", 8, "warning"), at("action-tag-first-party", 10, "info"), at("pr-target-checkout", 12, "critical"), at("action-unpinned", 13, "warning"), at("script-injection", 18, "critical"),
        at("action-tag-first-party", 29, "info"), at("no-permissions", 1, "warning"),
    }
    got = ids(spark, "ci-health", **{CI: PLAIN, "tests/a.py": "x"})
    assert got == {(f"ci-swallowed-{CI}-20", "warning"), (f"ci-silenced-failure-{CI}-24", "warning"), (f"ci-disabled-{CI}-32", "warning"), ("ci-no-pr-trigger", "info")}


def test_quoted_flow_and_anchored_forms(spark):
    got = ids(spark, "workflow-security", **{CI: FORMS})
    assert {i for i, _ in got} == {f"action-tag-{CI}-4", f"action-tag-{CI}-11", f"action-tag-{CI}-13", f"action-tag-{CI}-21"}
    got = ids(spark, "ci-health", **{CI: FORMS, "tests/a.py": "x"})
    assert {i for i, _ in got} == {f"ci-swallowed-{CI}-12", f"ci-disabled-{CI}-12"}


@pytest.mark.parametrize("on, want", [("on: push", {"push"}), ("on: [push, pull_request]", {"push", "pull_request"}), ("on:\n- push\n- schedule", {"push", "schedule"}), ("'on':\n  push:\n    branches: [a]\n  pull_request: {types: [x]}", {"push", "pull_request"}), ("on: {push: , release: {types: [published]}}", {"push", "release"}), ("jobs:\n  on: push", set()), ("", set())])
def test_triggers(spark, on, want):
    files = spark.createDataFrame([("r", CI, 0, 1, on + "\n")], FILES)
    assert {r.trigger for r in W.triggers(Snapshot(files=files).workflow_nodes).collect()} == want


def test_scheduled_workflows_are_no_checks(spark):
    text = "on: schedule\njobs:\n  a:\n    steps:\n      - run: pytest || true\n"
    assert ids(spark, "ci-health", **{CI: text}) == set()
    assert ids(spark, "ci-health", **{CI: text, "tool/action.yml": "runs:\n  steps:\n    - run: pytest || true\n"}) == {("ci-swallowed-tool/action.yml-3", "warning")}


def test_no_workflows(spark):
    assert ids(spark, "ci-health", **{"a.py": "x"}) == ids(spark, "workflow-security", **{"a.py": "x", CI: ""}) == set()
