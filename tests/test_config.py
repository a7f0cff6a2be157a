"""Configurations as frames against plain matching of globs and rules."""

import json
import random
import re

from pyspark.sql import functions as F

from siltmark.functions import scoring as S
from siltmark.operators import config as C
from siltmark.operators import metrics
from siltmark.operators.scanners import Snapshot, scan_configured
from siltmark.sources.git import parse_config

FIND = "repo_id string, id string, category string, severity string, title string, location string, age_days int, detail string, evidence string, scanner string, ord long"
FILES = "repo_id string, path string, file_ord long, size long, content string"
PARTS = ["src", "lib", "a.b", "x", "deep+dir", "(odd)", "test"]


def mute_regex(glob):
    out, i = "", 0
    while i < len(glob):
        if glob[i] == "*":
            if glob[i + 1 : i + 2] == "*":
                out += ".*"
                i += 1
                if glob[i + 1 : i + 2] == "/":
                    i += 1
            else:
                out += "[^/]*"
        else:
            out += "[^/]" if glob[i] == "?" else re.escape(glob[i])
        i += 1
    return f"^{out}$"


def paths(rng, n):
    return ["/".join([rng.choice(PARTS) for _ in range(rng.randrange(0, 4))] + [rng.choice(["f", "g.ts", "h.test.js", "x[1].py"])]) for _ in range(n)]


def globs(rng, n):
    bits = [*PARTS, "*", "**", "?", "s*", "*.ts", "f", "g.ts", "x[1].py", "*.*"]
    return ["/".join(rng.choice(bits) for _ in range(rng.randrange(1, 5))) for _ in range(n)]


def test_patterns_and_fixed_folders(spark):
    rng = random.Random(3)
    pairs = [(g, p) for g in globs(rng, 150) for p in paths(rng, 12)]
    df = spark.createDataFrame(pairs, "g string, p string")
    got = df.select("g", "p", F.regexp_like("p", C.pattern(F.col("g"))).alias("fits"), F.array_contains(C.folders(F.col("p")), C.fixed_folder(F.col("g"))).alias("near")).collect()
    assert [(r.g, r.p, r.fits) for r in got] == [(g, p, bool(re.search(mute_regex(g), p))) for g, p in pairs]
    assert all(r.near for r in got if r.fits)


def test_mutes_match_a_plain_search(spark):
    rng = random.Random(8)
    rows, configs = [], {}
    for k in range(12):
        ps = paths(rng, 25)
        rows += [(f"r{k}", f"id{rng.randrange(6)}", rng.choice(S.CATEGORIES), "info", "t", rng.choice(["", "./"]) + p + rng.choice(["", ":3"]), 0, "", None, None, i) for i, p in enumerate(ps)]
        rows.append((f"r{k}", "branch", "branch", "info", "t", "origin/x", 0, "", None, None, 99))
        if k % 4:
            rules = [{f: v for f, v in (("id", f"id{rng.randrange(6)}"), ("category", rng.choice(S.CATEGORIES)), ("path", g)) if rng.random() < 0.5} for g in globs(rng, 4)]
            configs[f"r{k}"] = [r for r in rules if r] + [{"reason": "", "path": "origin/*"}] * (k % 2)
    files = spark.createDataFrame([(r, C.CONFIG_FILE, 0, 1, json.dumps({"mute": m})) for r, m in configs.items()], FILES)

    def hidden(r):
        path = re.sub(r"^(.+):\d+$", r"\1", r[5]).removeprefix("./")
        return any(all((f != "id" or r[1] == v) and (f != "category" or r[2] == v) and (f != "path" or re.search(mute_regex(v), path)) for f, v in m.items() if f != "reason") for m in configs.get(r[0], []))

    left = C.unmuted(spark.createDataFrame(rows, FIND), C.read_configs(files))
    assert sorted(tuple(r) for r in left.select("repo_id", "ord").collect()) == sorted((r[0], r[10]) for r in rows if not hidden(r))
    assert any(map(hidden, rows))


def test_bad_configurations_are_the_default(spark):
    bad = ["", "{", "[]", "null", '{"ignore": null}', '{"ignore": [1]}', '{"mute": [{"reason": "x"}]}', '{"mute": [{"category": "nope"}]}', '{"weights": {"info": -1}}', '{"weights": {"critical": "1"}}', '{"mute": {"id": "a"}}']
    assert all(parse_config(t) == parse_config(None) for t in bad)
    files = spark.createDataFrame([(f"r{k}", C.CONFIG_FILE, 0, 1, t) for k, t in enumerate(bad)] + [("sub", "x/" + C.CONFIG_FILE, 0, 1, '{"ignore": ["a"]}')], FILES)
    got = C.read_configs(files).collect()
    assert len(got) == len(bad) - 1 and all(r.ignore == [] and r.mute == [] and tuple(r.weights) == (10.0, 3.0, 0.25) for r in got)


def test_scan_of_repositories_with_different_configurations(spark):
    code = "// TODO: one\nconsole.log(1);\n"
    configs = {"plain": None, "ignores": {"ignore": ["src/**", "**/*.gen.js"]}, "mutes": {"mute": [{"category": "todo"}, {"path": "lib/*", "id": "none"}]}, "weighs": {"weights": {"info": 5, "warning": 0}}, "bad": {"ignore": [3]}}
    rows = [(r, p, k, len(code), code) for r in configs for k, p in enumerate(["src/a.js", "lib/b.js", "lib/c.gen.js", "README.md", "LICENSE"])]
    rows += [(r, C.CONFIG_FILE, 9, 1, json.dumps(c)) for r, c in configs.items() if c is not None]
    findings, scores, errors = scan_configured(Snapshot(files=spark.createDataFrame(rows, FILES)), ["todo-debt", "leftover-debug", "project-hygiene"])
    assert errors == {}
    at = {}
    for r in findings.collect():
        at.setdefault(r.repo_id, set()).add((r.category, r.location))
    seen = lambda repo: {x for c, x in at[repo] if c == "todo"}
    assert seen("ignores") == {"lib/b.js:1"} and seen("mutes") == set() and seen("plain") == seen("weighs") == seen("bad") == {"src/a.js:1", "lib/b.js:1", "lib/c.gen.js:1"}
    assert at["plain"] == at["bad"] == at["weighs"]
    got = {r.repo_id: r.score for r in scores.collect()}
    standard = {r.repo_id: r.score for r in metrics.repo_scores(findings).collect()}
    own = {r.repo_id: r.score for r in metrics.repo_scores(findings, {"info": 5, "warning": 0}).collect()}
    assert got == standard | {"weighs": own["weighs"]} and got["weighs"] != standard["weighs"] and got["mutes"] > got["plain"]


def test_no_configuration_at_all(spark):
    files = spark.createDataFrame([("r", "a.js", 0, 1, "x")], FILES)
    none = C.read_configs(files)
    assert none.collect() == [] and C.kept_files(files, none).count() == 1 and C.unmuted(spark.createDataFrame([("r", "i", "todo", "info", "t", None, 0, "", None, None, 1)], FIND), none).count() == 1
