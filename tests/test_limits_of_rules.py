"""Limits of rules: their defaults, others, and none."""

import pytest

from siltmark.operators.scanners import RULES, Snapshot
from siltmark.operators.scanners.base import LIMITS
from siltmark.operators.scanners.registry import truncated

FILES = "repo_id string, path string, file_ord long, size long, content string"


@pytest.fixture(scope="module")
def files(spark):
    py = "".join(f"eval(x{k})\n" for k in range(20))
    rows = [("r", f"src/m{k}.py", k, len(py), py) for k in range(15)] + [("r", f"docs/d{k}.md", 100 + k, 1, f"[a](gone{k}.md)\nhttps://h{k}.site.io/x\n") for k in range(80)]
    rows += [("big", "a.py", 0, 500_000, "eval(x)\n"), ("big", "b.js", 1, 600_000, "eval(user);\n" + "// pad\n" * 90_000), ("small", "a.py", 0, 9, "eval(x)\n")]
    return spark.createDataFrame(rows, FILES)


def count(s, rule):
    out = {}
    for r in RULES[rule](s).collect():
        out[r.repo_id] = out.get(r.repo_id, 0) + 1
    return out


def test_limits_are_defaults_others_or_none(spark, files):
    assert count(Snapshot(files), "insecure-code") == {"r": 60, "small": 1}
    assert count(Snapshot(files, limits={"insecure-code": {"per_file": 2, "bytes": None}}), "insecure-code") == {"r": 30, "small": 1, "big": 1}
    assert count(Snapshot(files, limits=None), "insecure-code") == {"r": 300, "small": 1, "big": 2}
    assert count(Snapshot(files), "broken-doc-links") == {"r": 50} and count(Snapshot(files, limits={"broken-doc-links": {"findings": None}}), "broken-doc-links") == {"r": 80}
    dead = spark.createDataFrame([(f"https://h{k}.site.io/x", 404) for k in range(80)], "url string, status int")
    assert count(Snapshot(files, url_status=dead), "dead-links") == {"r": 40}
    assert count(Snapshot(files, url_status=dead, limits={"dead-links": {"findings": None}}), "dead-links") == {"r": 60} and count(Snapshot(files, url_status=dead, limits=None), "dead-links") == {"r": 80}


def test_what_limits_leave_out_is_counted(files):
    got = {(r.repo_id, r.scanner): (r.found, r.left_out) for r in truncated(Snapshot(files), ["insecure-code", "broken-doc-links"]).collect()}
    assert got == {("r", "insecure-code"): (300, 240), ("big", "insecure-code"): (2, 2), ("r", "broken-doc-links"): (80, 30)}


def test_limits_are_of_known_rules():
    assert set(LIMITS) <= set(RULES) | {"javascript"}
