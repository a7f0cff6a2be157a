"""Documents as files: whole and valid, all or none."""

import csv
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from siltmark import documents as D
from siltmark.operators import metrics as M
from siltmark.operators import timeline as TL

FIND = "repo_id string, id string, category string, severity string, title string, location string, age_days int, detail string, evidence string, scanner string, ord long"
ROWS = [
    ("o/a", "1", "todo", "info", 'x|y, "q"\n', "src/a.ts:4", 3, "d", None, None, 0), ("o/a", "2", "security", "critical", "é", "origin/x", 0, "", "e", "s", 1), ("o/a", "3", "branch", "warning", "t", ".", 0, "d", None, None, 2),
    ("b", "1", "odd", "info", "t", "./b.py", 1, "d", None, None, 0), *(("many", f"{k}", "hygiene", "warning", f"t{k}", f"f{k}.py:1", k, "d", None, None, k) for k in range(500)),
]


@pytest.fixture(scope="module")
def findings(spark):
    return spark.createDataFrame(ROWS, FIND).repartition(6)


@pytest.fixture(scope="module")
def scores(spark, findings):
    return M.repo_scores(findings, None, spark.createDataFrame([(r,) for r in ("o/a", "b", "many", "none")], "repo_id string"))


def files(folder):
    return {p.name: p.read_bytes().decode() for p in Path(folder).iterdir()}


def test_sarif_documents_are_whole(scores, findings, tmp_path):
    D.write_documents(D.sarif_documents(scores, findings), str(tmp_path / "out"))
    got = {k: json.loads(v) for k, v in files(tmp_path / "out").items()}
    assert set(got) == {"o-a.sarif", "b.sarif", "many.sarif", "none.sarif"}
    for doc in got.values():
        run = doc["runs"][0]
        rules = [r["id"] for r in run["tool"]["driver"]["rules"]]
        assert doc["version"] == "2.1.0" and len(set(rules)) == len(rules)
        for r in run["results"]:
            assert rules[r["ruleIndex"]] == r["ruleId"] and r["level"] in ("error", "warning", "note") and r["message"]["text"] and r["partialFingerprints"]["findingId"]
    a = got["o-a.sarif"]["runs"][0]
    assert [(r["ruleId"], r["level"], "locations" in r) for r in a["results"]] == [("security", "error", False), ("branch", "warning", False), ("todo", "note", True)]
    assert a["results"][2]["locations"][0]["physicalLocation"] == {"artifactLocation": {"uri": "src/a.ts"}, "region": {"startLine": 4}}
    assert len(got["many.sarif"]["runs"][0]["results"]) == 500 and got["none.sarif"]["runs"][0]["results"] == []


def test_json_markdown_csv_and_summary(spark, scores, findings, tmp_path):
    out = str(tmp_path / "out")
    for parts in (D.json_documents(scores, findings), D.markdown_documents(scores, findings), D.csv_documents(findings), D.summary(scores, spark.createDataFrame([("bad", "no clone")], "repo_id string, error string"))):
        D.write_documents(parts, out)
    got = files(out)
    assert set(got) == {f"{r}.{e}" for r in ("o-a", "b", "many", "none") for e in ("json", "md", "csv")} - {"none.csv"} | {"summary.json"}
    whole = {k: json.loads(v) for k, v in got.items() if k.endswith("json")}
    assert len(whole["many.json"]["issues"]) == 500 and whole["none.json"]["issues"] == [] and whole["o-a.json"]["repo"] == "o/a" and whole["none.json"]["score"] == 100
    assert [r["title"] for r in whole["o-a.json"]["issues"]] == ["é", "t", 'x|y, "q"\n']
    assert [(r["name"], r["grade"], r["issues"], r["error"]) for r in whole["summary.json"]] == [("b", "A", 1, None), ("bad", "-", 0, "no clone"), ("many", "F", 500, None), ("none", "A", 0, None), ("o/a", "B", 3, None)]
    assert [r[2] for r in csv.reader(got["o-a.csv"].lstrip("﻿").splitlines(keepends=True))][0] == "title" and len(list(csv.reader(got["many.csv"].splitlines()))) == 501
    assert got["none.md"].startswith("# none\n\nGrade A, 100 of 100") and got["o-a.md"].count("\n- **") == 3


def test_a_failed_task_leaves_no_document(spark, tmp_path):
    out = str(tmp_path / "out")
    D.write_documents(spark.createDataFrame([("kept.txt", 1, "old")], "name string, position int, text string"), out)
    bad = spark.range(200).select(F.concat(F.lit("n"), (F.col("id") % 40).cast("string")).alias("name"), F.col("id").alias("position"), F.when(F.col("id") == 150, F.raise_error(F.lit("broken"))).otherwise("x").alias("text"))
    with pytest.raises(Exception, match="broken"):
        D.write_documents(bad, out)
    assert files(out) == {"kept.txt": "old"}
    for name in ("a/b", "..", ""):
        with pytest.raises(Exception, match="not the name"):
            D.write_documents(spark.createDataFrame([(name, 1, "x")], "name string, position int, text string"), out)
    assert files(out) == {"kept.txt": "old"}


def test_parts_are_joined_in_order_and_replace_the_file(spark, tmp_path):
    out = str(tmp_path / "out")
    rows = [(f"f{k % 7}.txt", k, f"{k},") for k in range(300)] + [("f0.txt", 999, None)]
    for _ in range(2):
        D.write_documents(spark.createDataFrame(rows, "name string, position long, text string").repartition(9), out)
    assert files(out) == {f"f{m}.txt": "".join(f"{k}," for k in range(300) if k % 7 == m) for m in range(7)}
    D.write_documents(spark.createDataFrame([], "name string, position long, text string"), out)
    assert len(files(out)) == 7


def test_comments_and_outputs(spark, scores, findings):
    old = findings.filter("repo_id <> 'many' or ord < 498").unionByName(spark.createDataFrame([("b", "gone", "todo", "critical", "t", "x", 0, "d", None, None, 5)], FIND))
    story = TL.regression_story(old, findings, M.repo_scores(old).select("repo_id", F.col("score").alias("previous_score")).join(scores.select("repo_id", "score"), "repo_id"))
    body = {r.repo_id: r.body for r in D.comments(scores, findings, story, base_url="http://x/").collect()}
    assert all(b.startswith(D.MARK) for b in body.values()) and "No findings." in body["none"] and "since" not in body["none"]
    assert "and 490 more" in body["many"] and body["many"].count("\n| warning") == 10 and "**2** new" in body["many"] and body["many"].count("\n- **warning**") == 2
    assert "score **+" in body["b"] and "**1** fixed" in body["b"] and "Nothing has changed" in body["o/a"] and "**1** finding: 0 critical" in body["b"]
    assert "x\\|y" in body["o/a"] and body["o/a"].endswith("[Report](http://x/o/a)")
    got = {r.repo_id: (r.lines, r.failed) for r in D.ci_outputs(scores, "c").collect()}
    assert got["many"][1] and not got["none"][1] and got["none"][0] == "score=100\ngrade=A\nissues=0\n"
    assert not any(r.failed for r in D.ci_outputs(scores, "never").collect())
    row = D.batch_average(scores, spark.createDataFrame([("bad", "x")], "repo_id string, error string")).first()
    points = [r.score for r in scores.collect()]
    assert (row.scanned, row.failed, row.average) == (4, 1, int(sum(points) / 4 + 0.5))
    assert D.batch_average(scores.limit(0)).first().average is None
