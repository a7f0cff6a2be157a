"""SARIF documents of many findings: dealt once as rows, written in pieces by many tasks, packed, and read line by line."""

import gzip
import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from siltmark import documents as D
from siltmark import sinks
from siltmark.plans import repos

FIND = "repo_id string, id string, category string, severity string, title string, location string, age_days int, detail string, evidence string, scanner string, ord long"


@pytest.fixture(scope="module")
def findings(spark):
    r = random.Random(4)
    rows = [("few", str(k), "todo", "info", "t", "a.py:1", 1, "d", None, None, 0) for k in range(3)]
    for k in range(9000):
        where = r.choice([".", f"src/f{k % 50}.ts:{k}", f"src/ü{k % 7}.ts", None, "origin/x"])
        rows.append((r.choice(["many", "more"]), f"{k // 2}", f"c{r.randrange(9)}", r.choice(["critical", "warning", "info", "odd"]), 'x,\n"]}]}', where, r.choice([None, 0, 5, 9]), "d", None, None, r.randrange(3)))
    return spark.createDataFrame(rows, FIND).repartition(5)


@pytest.fixture(scope="module")
def scores(spark):
    return spark.createDataFrame([(x,) for x in ("few", "many", "more", "none")], "repo_id string")


def wanted(findings):
    out = {}
    for r in sinks.sarif_results(findings).orderBy("repo_id", "position").collect():
        out.setdefault(r.repo_id, []).append(json.loads(r.result))
    return out


@pytest.mark.parametrize("few", [D.FEW, 0])
def test_pieces_of_many_tasks_are_whole_documents_packed_or_not(spark, scores, findings, tmp_path, monkeypatch, few):
    monkeypatch.setattr(D, "FEW", few)
    want = wanted(findings)
    parts = D.sarif_documents(scores, findings)
    assert parts.tasks > 2
    for packed in (False, True):
        out = tmp_path / str(packed)
        D.write_documents(parts, str(out), packed)
        got = {p.name: json.loads(gzip.decompress(p.read_bytes()) if packed else p.read_bytes())["runs"][0] for p in out.iterdir()}
        assert {k.removesuffix(".gz").removesuffix(".sarif"): v["results"] for k, v in got.items()} == {**want, "none": []}
        for name, run in got.items():
            rules = [r["id"] for r in run["tool"]["driver"]["rules"]]
            assert name.endswith(".sarif.gz" if packed else ".sarif") and all(rules[x["ruleIndex"]] == x["ruleId"] for x in run["results"])
            assert rules == list(dict.fromkeys(x["ruleId"] for x in run["results"]))
        rules, results = D.read_sarif(spark, str(out), "struct<ruleId:string,ruleIndex:bigint>")
        assert {r["name"]: len(r.rules) for r in rules.collect()} == {f"{k}.sarif": len({x["ruleId"] for x in v}) for k, v in {**want, "none": []}.items()}
        assert sorted((r["name"], r.nth, *r.result) for r in results.collect()) == sorted((f"{k}.sarif", n, x["ruleId"], x["ruleIndex"]) for k, v in want.items() for n, x in enumerate(v))


def test_findings_are_dealt_once_and_become_text_afterwards(scores, findings):
    parts = D.sarif_documents(scores, findings)
    plan = parts.rows._jdf.queryExecution().optimizedPlan().toString()
    assert "findingId" not in plan and "_path" not in plan and "Window" not in plan
    assert "SortMergeJoin" not in parts.rows._jdf.queryExecution().executedPlan().toString()


def test_the_query_leaves_packed_documents_and_one_exchange_of_findings(spark, monkeypatch):
    seen = []
    write = D.write_documents
    monkeypatch.setattr(repos.documents, "write_documents", lambda parts, folder, **more: (seen.append(folder), write(parts, folder, **more)))
    assert repos.report_documents(spark, "/root/testdata/sf0.001").count() > 5000
    files = sorted(p.name for p in Path(seen[0]).iterdir())
    assert len(files) == 25 and all(f.endswith(".sarif.gz") for f in files)
    assert all(json.loads(gzip.decompress((Path(seen[0]) / f).read_bytes()))["runs"][0]["results"] for f in files)


@pytest.mark.parametrize("block", [1, 3, 1 << 20])
@pytest.mark.parametrize("first", [False, True])
def test_lines_are_whole_however_blocks_are_cut(tmp_path, monkeypatch, block, first):
    monkeypatch.setattr(D, "BLOCK", block)
    texts = {"a": "one\n\nthrée\nlast", "b": "x\n", "c": "", "d": "\n", "e": "no end"}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
        (tmp_path / f"{name}z.gz").write_bytes(gzip.compress(text[:2].encode()) + gzip.compress(text[2:].encode()))
    (tmp_path / "_hidden").write_text("no")
    reader = D._Reader(str(tmp_path), first, 2)
    got = {}
    for part in reader.partitions():
        for batch in reader.read(part):
            for row in batch.to_pylist():
                got.setdefault(row["name"], []).append((row["position"], row["text"]))
    lines = {k: list(enumerate(t.removesuffix("\n").split("\n") if t else []))[: 1 if first else None] for k, t in texts.items()}
    assert got == {k: v for name, v in lines.items() if v for k in (name, f"{name}z")}


def test_parts_of_any_shape_are_packed_and_joined(spark, tmp_path):
    rows = spark.createDataFrame([("f", k, k % 5 > 0, f"{k}") for k in range(100)] + [("g", 0, True, None), ("g", 1, True, "x")], "name string, at int, inner boolean, text string")
    for tasks in (1, 7):
        D.write_documents(D.Parts(rows, [F.col("at")], F.col("text"), F.col("inner"), "é|", tasks), str(tmp_path / f"{tasks}"), packed=True)
        got = {p.name: gzip.decompress(p.read_bytes()).decode() for p in (tmp_path / f"{tasks}").iterdir()}
        assert got == {"f.gz": "".join(("é|" if k % 5 > 1 else "") + f"{k}" for k in range(100)), "g.gz": "é|x"}
