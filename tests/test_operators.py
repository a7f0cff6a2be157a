"""Operators on small frames: golden points, boundaries, merges, searches, sinks and streams."""

import datetime as dt
import json
import math

import pytest
from pyspark.sql import functions as F

from siltmark import sinks
from siltmark.functions import lexer
from siltmark.functions import scoring as S
from siltmark.functions import text as T
from siltmark.operators import findings as FI
from siltmark.operators import metrics as M
from siltmark.operators import timeline as TL
from siltmark.operators import usage as U
from siltmark.sources import git
from siltmark.sources import manifests as MA
from siltmark.streaming import usage as ST

FIND = "repo_id string, id string, category string, severity string, title string, location string, age_days int, detail string, evidence string, scanner string, ord long"


def finding(repo="r", id="x", category="todo", severity="info", title="t", location="a.ts:1", age=0, scanner=None, ord=0):
    return (repo, id, category, severity, title, location, age, "d", None, scanner, ord)


def one(spark, expression, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return row.select(expression.alias("v")).first().v


@pytest.mark.parametrize("counts, weights, want", [((0, 0, 0), None, 100), ((1, 1, 1), None, 87), ((200, 0, 0), None, 0), ((0, 0, 200), None, 93), ((0, 100, 0), None, 47), ((0, 0, 1), {"info": 10}, 90), ((0, 0, 2), {"info": 10}, 80), ((0, 1, 1), None, 97), ((7, 17, 25), None, 11), ((6, 62, 37), None, 2)])
def test_golden_scores(spark, counts, weights, want):
    assert one(spark, S.score(*map(F.lit, counts), weights)) == want


def test_penalty_is_tapered_and_grows(spark):
    rows = spark.range(0, 300).select("id", S.tier_penalty(F.col("id"), "warning").alias("p")).orderBy("id").collect()
    steps = [b.p - a.p for a, b in zip(rows, rows[1:], strict=False)]
    assert all(x > 0 for x in steps) and all(math.isclose(x, 3) for x in steps[:8]) and all(b <= a + 1e-9 for a, b in zip(steps, steps[1:], strict=False))


def test_grade_edges(spark):
    got = [one(spark, S.grade(F.lit(x))) for x in (90, 89, 75, 74, 60, 59, 40, 39)]
    assert "".join(got) == "ABBCCDDF"


def test_locations(spark):
    cases = {"a/b.ts:12": ("a/b.ts", 12, "line"), "a/b.ts:12:3": ("a/b.ts", 12, "line"), "package.json": ("package.json", None, "file"), "origin/x": (None, None, "branch"), "src/**": (None, None, "pattern"), "a.ts @ abc123": ("a.ts", None, "history"), ".": (".", None, "repository"), "package.json#scripts.x": ("package.json#scripts.x", None, "pointer")}
    for loc, want in cases.items():
        row = spark.range(1).select(S.location_path(F.lit(loc)).alias("p"), S.location_line(F.lit(loc)).alias("l"), S.location_kind(F.lit(loc)).alias("k")).first()
        assert (row.p, row.l, row.k) == want


def test_scalars(spark):
    assert one(spark, S.half_up(F.lit(-0.5))) == 0 and one(spark, S.half_up(F.lit(2.5))) == 3
    assert [one(spark, S.effort_text(F.lit(float(h)))) for h in (0, 0.25, 0.75, 3, 9.96, 12.4, 20)] == ["0h", "15m", "45m", "3h", "10h", "12h", "2.5d"]
    assert one(spark, T.fnv1a(F.lit("abc"))) == 0x1A47E90B and one(spark, T.fnv1a(F.lit(""))) == 2166136261
    assert one(spark, T.resolve(F.lit("a/b"), F.lit("../c/./d"))) == "a/c/d"
    assert [one(spark, T.compact_count(F.lit(n))) for n in (999, 1234, 25_000, 2_500_000)] == ["999", "1.2k", "25k", "2.5M"]
    assert math.isclose(one(spark, T.entropy(F.lit("aabb"))), 1.0)
    assert [one(spark, T.range_kind(F.lit(v))) for v in ("^1.0.0", "~1.2", "1.2.3", ">=1", "*")] == ["caret", "tilde", "exact", "other", "other"]
    for licence, want in {"MIT OR GPL-3.0": "permissive", "MIT AND GPL-3.0": "strong-copyleft", "LGPL-2.1": "weak-copyleft", "AGPL-3.0": "network-copyleft", "": "unknown", "CC-BY-NC-4.0": "permissive", "UNLICENSED": "proprietary"}.items():
        assert one(spark, T.licence_class(F.lit(licence))) == want
    assert [one(spark, T.private_host(F.lit(u))) for u in ("http://localhost/x", "https://a.example.com", "http://192.168.1.1/", "https://real.site.io/a")] == [True, True, True, False]
    assert one(spark, S.size_verdict(F.lit(500 * 1024), 500)) == "over" and one(spark, S.size_verdict(F.lit(250 * 1024), 500)) == "large"


def test_globs():
    import re

    for glob, yes, no in [("**/*.ts", ["a.ts", "x/y/a.ts"], ["a.tsx"]), ("src/*", ["src/a"], ["src/a/b"]), ("a?.md", ["ab.md"], ["a/.md", "a.md"]), ("x/**", ["x/y/z"], ["y/x"])]:
        assert all(re.search(T.glob_regex(glob), p) for p in yes) and not any(re.search(T.glob_regex(glob), p) for p in no)


def test_lexer():
    code = "const a = /x\\/[/]/g; // hi\nfoo.bar(`t ${x}`, 'a//b'); x = a / b / c; debugger\n/* two\nlines */ it.only('x')"
    got = lexer.with_calls(lexer.split_code(code))
    assert ("regex", "/x\\/[/]/g", 1) in got and ("comment", "// hi", 1) in got and ("string", "'a//b'", 2) in got
    assert {t for k, t, _ in got if k == "call"} == {"foo.bar", "debugger", "it.only"} and ("call", "it.only", 4) in got
    assert sum(k == "regex" for k, _, _ in got) == 1
    assert lexer.looks_generated("a.min.js", "x") and lexer.looks_generated("a.js", "x" * 300) and not lexer.looks_generated("a.js", "x\n" * 300)


def test_filters_and_mutes(spark):
    rows = [finding(id="vuln-1", severity="critical", category="security"), finding(id="doclink-2", severity="warning", location="docs/x.md:3"), finding(id="todo-3"), finding(id="x", scanner="secrets", category="security")]
    df = spark.createDataFrame(rows, FIND)
    names = lambda d: sorted(r.id for r in d.collect())
    assert names(FI.in_mode(df, "security")) == ["vuln-1", "x"] and names(FI.in_mode(df, "links")) == ["doclink-2"]
    assert names(FI.filter_findings(df, "actionable")) == ["doclink-2", "vuln-1"] and names(FI.filter_findings(df, scanner="todo-debt")) == ["todo-3"]
    assert names(FI.apply_mutes(df, [{"path": "docs/**"}, {"id": "x", "category": "todo"}])) == ["todo-3", "vuln-1", "x"]
    live, muted = FI.live_and_snoozed(df, spark.createDataFrame([("r", "x")], "repo_id string, id string"))
    assert names(muted) == ["x"] and len(names(live)) == 3
    lines = spark.createDataFrame([("r", "docs/x.md", 2, "rot-ignore-next-line"), ("r", "a.ts", 9, "rot-ignore")], "repo_id string, path string, line int, text string")
    assert names(FI.drop_ignored(df, lines)) == ["todo-3", "vuln-1", "x"]
    assert FI.select_scanners(["supply-chain", "env-lifecycle", "nope"]) == (["env-lifecycle", "supply-chain"], ["nope"])
    batches = FI.verdict_batches(spark.createDataFrame([finding(id=f"i{k}", ord=k) for k in range(12)], FIND), spark.createDataFrame([("i0",)], "id string"), ["todo"], most=9, size=5).collect()
    assert sorted(r.batch for r in batches) == [0] * 5 + [1] * 4


def test_search(spark):
    df = spark.createDataFrame([finding(id="a", title="lodash is outdated", category="dependency"), finding(id="b", title="TODO: rewrite", category="todo"), finding(id="c", title="Committed credential", category="security")], FIND)
    rank = lambda q: {r.id: r.relevance for r in FI.search(df, q).collect()}
    assert rank("lodsh") == {"a": 1} and rank("password") == {"c": 2} and rank("todo rewrite") == {"b": 6} and rank("nothing here") == {} and len(rank(" ")) == 3
    nodes = M.tree_nodes(spark.createDataFrame([finding(location="src/lib/x.ts:1"), finding(location="src/lib/y.ts"), finding(location="origin/z", severity="critical"), finding(location="."), finding(location="deep/one/two.ts")], FIND))
    by = {r.node: r for r in nodes.collect()}
    assert by[""].findings == 5 and by["src"].findings == 2 and by["(other)"].worst == "critical" and by["src/lib/x.ts"].kind == "file"
    labels = {r.node: r.label for r in M.compressed_tree(nodes).collect()}
    assert labels["src/lib"] == "src/lib" and "src" not in labels and labels["deep/one"] == "deep/one" and labels["src/lib/x.ts"] == "x.ts"
    assert {(r.node, r.why) for r in FI.search_tree(nodes, "x.ts").collect()} == {("src/lib/x.ts", "match"), ("", "open"), ("src", "open"), ("src/lib", "open")}


def test_reachability_in_a_cycle(spark):
    edges = spark.createDataFrame([("r", "a", "b"), ("r", "b", "c"), ("r", "c", "a"), ("r", "x", "y")], "repo_id string, src string, dst string")
    assert {r.name for r in FI.reachable(spark.createDataFrame([("r", "a")], "repo_id string, name string"), edges).collect()} == {"a", "b", "c"}


def test_reachability_never_ends_short(spark):
    edges = spark.createDataFrame([("r", k, k + 1) for k in range(4)], "repo_id string, src long, dst long")
    seeds = spark.createDataFrame([("r", 0)], "repo_id string, name long")
    assert FI.reachable(seeds, edges, most_rounds=4).count() == FI.reachable(seeds, edges).count() == 5
    with pytest.raises(RuntimeError, match="3 rounds"):
        FI.reachable(seeds, edges, most_rounds=3)


def points(spark, rows):
    return spark.createDataFrame([(r, dt.datetime(2026, 1, d), s, 0, 0, 0) for r, d, s in rows], "repo_id string, scan_ts timestamp, score int, critical int, warning int, info int")


def test_rot_trend(spark):
    rows = [("fall", 1, 80), ("fall", 3, 75), ("fall", 5, 75), ("fall", 7, 70), ("top", 1, 99), ("top", 2, 95), ("up", 1, 50), ("up", 4, 60), ("flat", 1, 50), ("flat", 2, 50), ("new", 1, 10), ("turn", 1, 50), ("turn", 2, 40), ("turn", 3, 60), ("turn", 4, 60)]
    got = {r.repo_id: (r.kind, r.days) for r in TL.rot_trend(points(spark, rows), "2026-01-11").collect()}
    assert got == {"fall": ("rotting", 8), "up": ("improved", 7), "flat": ("unchanged", 10), "turn": ("improved", 8)}


def test_merging_points(spark):
    stored, new = points(spark, [("r", 1, 50), ("r", 3, 60)]), points(spark, [("r", 2, 55), ("r", 3, 60), ("r", 1, 40)])
    got = sorted((r.scan_ts.day, r.score) for r in TL.merge_points(stored, new).collect())
    assert got == [(1, 40), (2, 55), (3, 60)]
    assert sorted((r.scan_ts.day, r.score) for r in TL.merge_points(TL.merge_points(stored, new), new).collect()) == got
    assert sorted((r.scan_ts.day, r.score) for r in TL.union_history(stored, new).collect()) == [(1, 50), (2, 55), (3, 60)]
    assert len(TL.merge_points(stored, new, keep=2).collect()) == 2


def test_drops_and_watches(spark):
    got = {(r.scan_ts.day, r.reason) for r in TL.score_drops(points(spark, [("r", 1, 91), ("r", 2, 89), ("r", 3, 87), ("r", 4, 80)])).collect()}
    assert got == {(2, "grade"), (4, "score")}
    w = spark.createDataFrame([("a", None), ("b", "2026-01-01 00:00:00"), ("c", "2026-01-09 23:00:00")], "id string, last_checked_ts string").withColumn("last_checked_ts", F.to_timestamp("last_checked_ts"))
    assert [r.id for r in TL.due_watches(w, "2026-01-10 00:00:00", 5).collect()] == ["a", "b"]


def test_regression_story(spark):
    old = spark.createDataFrame([finding(id="a"), finding(id="a"), finding(id="b")], FIND)
    new = spark.createDataFrame([finding(id="b"), finding(id="c", severity="critical"), finding(id="d", title="a")], FIND)
    scores = spark.createDataFrame([("r", 80, 70)], "repo_id string, previous_score int, score int")
    row = TL.regression_story(old, new, scores).first()
    assert (row.added, row.fixed, [x.id for x in row.new_findings]) == (2, 1, ["c", "d"]) and row.headline == "B 80 → C 70 (-10) · 2 new · 1 fixed"
    same = TL.regression_story(old, old, spark.createDataFrame([("r", 80, 80)], "repo_id string, previous_score int, score int")).first()
    assert same.headline == "B 80 → B 80 · no change"


def test_contributor_points(spark):
    rows = spark.createDataFrame([(0, 0, 0), (1, 0, 0), (9, 99, 99), (2, 12, 6)], "confirmed_false_positives int, clean_streak_weeks int, areas_touched int")
    got = [(r.points, r.tier_name, r.to_next) for r in U.contributor_points(rows).orderBy("points").collect()]
    assert got == [(0.0, "Passing through", 3.0), (4.0, "Reporter", 4.0), (29.0, "Steward", 2.0), (37.0, "Warden", None)]


def test_scan_stat_is_anonymous(spark):
    df = spark.createDataFrame([("2026-01-02T03:04:05Z", 71.5, "C", [("TypeScript", 2, 900), ("Python", 1, 900)], ["pytest", "CircleCI"], 1, 2, 3), ("2026-01-02", 50.0, "Z", [], [], 0, 0, 0)], "generated_at string, score double, grade string, languages array<struct<language:string,files:int,loc:int>>, tools array<string>, critical int, warning int, info int")
    rows = M.assert_anonymous(M.scan_stat(df)).collect()
    assert [(str(r.day), r.score, r.language, r.size, r.ci, r.tests) for r in rows] == [("2026-01-02", 72, "TypeScript", "s", True, True)]
    with pytest.raises(ValueError):
        M.assert_anonymous(df.withColumn("x", F.struct(F.lit(1).alias("owner"))))


def test_summary_needs_enough_scans(spark):
    few, many = (spark.range(n).select(F.lit(50).alias("score")) for n in (29, 30))
    assert M.scan_summary(few).count() == 0 and M.scan_summary(many).first().median_score == 50


def test_git_readers(spark, tmp_path):
    lines = spark.createDataFrame([("r", "\x1f".join(["a" * 40, "1767225600", "b" * 40 + " " + "c" * 40, "tag: v1", "subject"])), ("r", "broken")], "repo_id string, line string")
    c = git.parse_commits(lines).collect()
    assert len(c) == 1 and len(c[0].parents) == 2 and c[0].tagged and c[0].subject == "subject"
    rec = "a" * 40 + "\x1f1\n" + "\n".join([f"M\tf{k}" for k in range(21)] + ["R100\told\tnew"])
    f = git.parse_commit_files(spark.createDataFrame([("r", rec)], "repo_id string, record string")).first()
    assert f.files_changed == 22 and f.truncated and len(f.files) == 20
    patch = "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -0,0 +1 @@\n+hello\n-gone\n"
    assert [(r.path, r.text) for r in git.history_additions(spark.createDataFrame([("r", "c", "2026-01-01", patch)], "repo_id string, commit string, commit_ts string, patch string")).collect()] == [("x", "hello")]
    blame = "a" * 40 + " 1 1 1\nauthor x\ncommitter-time 1767225600\n\tcode\n" + "b" * 40 + " 2 2\ncommitter-time 1767312000\n\tmore\n"
    assert {(r.line, r.age_days) for r in git.parse_blame(spark.createDataFrame([("r", "x", blame)], "repo_id string, path string, porcelain string"), "2026-01-11").collect()} == {(1, 10), (2, 9)}
    names = git.repo_names(spark.createDataFrame([("1", "git@host.io:own/name.git", "f"), ("2", None, "f")], "repo_id string, origin string, folder string")).collect()
    assert {(r.owner, r.name) for r in names} == {("own", "name"), ("local", "f")}
    for p, t in {"one/src/a.py": b"x = 1\n", "one/node_modules/b.js": b"", "one/bin.dat": b"\xff\xfe\x00", "two/README.md": b"hi"}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(t)
    got = {(r.repo_id, r.path): r.content for r in git.read_trees(spark, str(tmp_path)).collect()}
    assert got == {("one", "bin.dat"): None, ("one", "src/a.py"): "x = 1\n", ("two", "README.md"): "hi"}


def test_config():
    good = git.parse_config('{"ignore": ["x/**"], "mute": [{"id": "a", "other": 1}], "weights": {"info": 1}, "more": 2}')
    assert good == {"ignore": ["x/**"], "mute": [{"id": "a"}], "weights": {"critical": 10.0, "warning": 3.0, "info": 1.0}}
    assert all(git.parse_config(t)["ignore"] == [] for t in (None, "no", '{"ignore": 3}', '{"ignore": ["x"], "mute": [3]}', "[]"))


def test_manifests(spark):
    files = {"requirements.txt": "Flask[x]>=1.2\nrequests==2.0 # c\n", "go.mod": "require (\n  github.com/a/b v1.2.0\n  github.com/c/d v0.1.0 // indirect\n)\n", "Cargo.toml": '[package]\nname = "x"\n[dependencies]\nserde = { version = "1.0" }\nrand = "0.8"\n', "Cargo.lock": '[[package]]\nname = "serde"\nversion = "1.0.9"\n', "composer.json": '{"require": {"php": "8", "a/b": "^1.0"}}', "Gemfile": "gem 'rails', '~> 7.0'\n"}
    tree = spark.createDataFrame([("r", k, v) for k, v in files.items()], "repo_id string, path string, content string")
    got = {(r.ecosystem, r.name): r.version for r in MA.manifest_deps(tree).collect()}
    assert got == {("PyPI", "flask"): "1.2", ("PyPI", "requests"): "2.0", ("Go", "github.com/a/b"): "1.2.0", ("Go", "github.com/c/d"): "0.1.0", ("crates.io", "serde"): "1.0.9", ("crates.io", "rand"): "0.8", ("Packagist", "a/b"): "1.0", ("RubyGems", "rails"): "7.0"}
    assert got["Go", "github.com/c/d"] == "0.1.0" and {r.name for r in MA.manifest_deps(tree, direct=True).filter("ecosystem = 'Go'").collect()} == {"github.com/a/b"}
    assert {r.version for r in MA.manifest_deps(tree, direct=True).filter("name = 'serde'").collect()} == {"1.0"}
    lock = {"packages": {"": {"dependencies": {"a": "1"}, "devDependencies": {"d": "1"}}, "node_modules/a": {"version": "1.0.0", "dependencies": {"b": "1"}}, "node_modules/b": {"version": "2.0.0", "dev": True}, "node_modules/a/node_modules/b": {"version": "2.0.0"}, "node_modules/d": {"version": "3.0.0", "dev": True}}}
    tree = spark.createDataFrame([("r", "package-lock.json", json.dumps(lock))], "repo_id string, path string, content string")
    assert {(r.name, r.version) for r in MA.npm_installed(tree).collect()} == {("a", "1.0.0"), ("b", "2.0.0"), ("d", "3.0.0")}
    old = {"lockfileVersion": 1, "dependencies": {"a": {"version": "1.0.0", "dependencies": {"b": {"version": "2.0.0", "dev": True, "dependencies": {"c": {"version": "3.0.0"}}}}}, "d": {"version": "4.0.0", "dev": True}}}
    deep = spark.createDataFrame([("r", "package-lock.json", json.dumps(old))], "repo_id string, path string, content string")
    assert {(r.name, r.version, r.dev) for r in MA.npm_installed(deep).collect()} == {("a", "1.0.0", None), ("b", "2.0.0", True), ("c", "3.0.0", None), ("d", "4.0.0", True)}
    assert {r.name for r in FI.reachable(*MA.npm_graph(tree)).collect()} == {"a", "b"}


def test_sinks(spark):
    df = spark.createDataFrame([finding(id="a", severity="info", title='x|y, "q"', location="."), finding(id="b", severity="critical", category="security", location="s.ts:4", age=3)], FIND)
    scores = M.repo_scores(df)
    report = json.loads(sinks.json_reports(scores, df).first().report)
    assert [i["id"] for i in report["issues"]] == ["b", "a"] and report["score"] == 90
    md = {r.position: r.line for r in sinks.markdown_rows(df).collect()}
    assert md[2].startswith("| info | x\\|y")
    csv = {r.position: r.line for r in sinks.csv_rows(df).collect()}
    assert csv[0].startswith("\ufeffseverity,") and '"x|y, ""q"""' in csv[2] and csv[1].endswith("\r\n")
    sarif = {r.position: json.loads(r.result) for r in sinks.sarif_results(df).collect()}
    assert sarif[1]["level"] == "error" and sarif[1]["ruleIndex"] == 0 and sarif[1]["locations"][0]["physicalLocation"]["region"]["startLine"] == 4 and "locations" not in sarif[2]
    assert sinks.format_of("md") == "markdown" and sinks.format_of("zzz") == "terminal"
    assert sinks.shared_report(scores, df).first().top[0].title == "t" and sinks.failed(scores, "A").count() == 1
    assert [r.line for r in sinks.terminal_rows(df, False).orderBy("position").collect()][0].startswith("CRITICAL")


def run_stream(query, spark, name, mode):
    q = query.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_streams_match_batches(spark, tmp_path):
    rows = [(k, dt.datetime(2026, 1, 1 + k // 40, k % 24), f"v{k % 7}" if k % 5 else "anonymous", "scan" if k % 2 else "view", k % 3, f"v{k % 3}") for k in range(120)]
    schema = "event_id long, event_ts timestamp, visitor string, event string, amount int, client string"
    batch = spark.createDataFrame(rows, schema)
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    got = {(r.day, r.event): (r.events, r.amount) for r in run_stream(ST.daily_usage(stream(), "30 days"), spark, "daily", "complete")}
    want = {(r.day, r.event): (r.events, r.amount) for r in batch.groupBy(F.to_date("event_ts").alias("day"), "event").agg(F.count("*").alias("events"), F.sum("amount").alias("amount")).collect()}
    assert got == want
    got = {r.day.date(): r.visitors for r in run_stream(ST.daily_visitors(stream(), "30 days"), spark, "visitors", "complete")}
    assert got == {r.day: r.n for r in batch.filter("visitor <> 'anonymous'").groupBy(F.to_date("event_ts").alias("day")).agg(F.countDistinct("visitor").alias("n")).collect()}
    assert sum(r.events for r in run_stream(ST.hourly_sessions(stream(), "30 minutes", "30 days"), spark, "sessions", "complete")) == 120
    assert sum(r.events for r in run_stream(ST.sliding_counts(stream(), "1 hour", "1 hour", "30 days"), spark, "sliding", "complete")) == 120


def test_stateful_streams(spark, tmp_path):
    points(spark, [("r", 1, 91), ("r", 2, 89), ("r", 3, 88), ("r", 4, 80)]).coalesce(1).write.parquet(str(tmp_path / "s"))
    s = spark.readStream.schema(points(spark, [("r", 1, 1)]).schema).parquet(str(tmp_path / "s"))
    assert {(r.previous_score, r.score, r.reason) for r in run_stream(ST.drop_alerts(s), spark, "drops", "append")} == {(91, 89, "grade"), (88, 80, "score")}


def test_reports_are_judged_by_the_schema(spark):
    from siltmark.sources import reports as RE

    issue = {"id": "a", "category": "secret", "severity": "info", "title": "t", "location": "x:1", "ageDays": 3, "detail": "d"}
    good = {"schemaVersion": 1, "repo": {"owner": "o", "name": "n", "defaultBranch": "main"}, "generatedAt": "2026-01-01T00:00:00Z", "score": 90, "grade": "A", "issues": [issue]}
    bad = {
        "not JSON": ["{", "", None], "schemaVersion": [json.dumps(good | {"schemaVersion": 2})], "repo": [json.dumps(good | {"repo": {"owner": "o", "name": "n"}})], "score": [json.dumps(good | {"score": 101}), json.dumps(good | {"score": 1.5})],
        "grade": [json.dumps(good | {"grade": "E"})], "issues": [json.dumps(good | {"issues": [issue | {"severity": "bad"}]}), json.dumps(good | {"issues": [{"id": "a"}]}), json.dumps({k: v for k, v in good.items() if k != "issues"})],
    }
    rows = [(json.dumps(good), 0)] + [(t, 1) for texts in bad.values() for t in texts]
    ok, rejected = RE.parse_reports(spark.createDataFrame(rows, "value string, n int"))
    assert [(r.repo_id, r.score, r.issues[0].category, r.issues[0].ageDays) for r in ok.collect()] == [("o/n", 90, "security", 3)]
    assert sorted((r.reason, r.value or "") for r in rejected.collect()) == sorted((k, t or "") for k, texts in bad.items() for t in texts)
    assert [(r.repo_id, r.id, r.age_days, r.ord) for r in RE.issues_of(ok).collect()] == [("o/n", "a", 3, 0)]


def test_commits_are_picked(spark):
    from siltmark.operators import timeline as TI

    log = spark.createDataFrame([("r", "abc1", 3, "Fix Bug", ["a"], True, 30), ("r", "def2", 2, "merge", ["a", "b"], False, 1), ("r", "abc3", 1, "x", [], False, 20)], "repo_id string, sha string, commit_ts int, subject string, parents array<string>, tagged boolean, files_changed int")
    shas = lambda df: sorted(r.sha for r in df.collect())
    assert [shas(TI.pick_commits(log, q, k)) for q, k in (("", "all"), (" BUG ", "all"), ("abc", "all"), ("", "tagged"), ("", "merges"), ("abc", "big"))] == [["abc1", "abc3", "def2"], ["abc1"], ["abc1", "abc3"], ["abc1"], ["def2"], ["abc1", "abc3"]]
    wanted = spark.createDataFrame([("r", "abc3"), ("r", "abc1"), ("r", "abc1"), ("r", "forged")], "repo_id string, sha string")
    assert [(r.sha, r.position) for r in TI.in_log(log, wanted).orderBy("position").collect()] == [("abc1", 1), ("abc3", 2)]
    assert TI.in_log(log, wanted, 1).count() == 1


def test_fixed_versions(spark):
    from siltmark.operators.scanners.deps import fixed_version

    shape = "array<struct<package:struct<ecosystem:string,name:string>,ranges:array<struct<events:array<struct<introduced:string,fixed:string>>>>>>"
    rows = [("npm", "a", [(("npm", "b"), [([("0", "9")],)]), (("npm", "a"), [([("0", None)],), ([("1", "1.2"), ("2", "2.1")],)])]), ("npm", "c", []), ("npm", "d", None)]
    df = spark.createDataFrame(rows, f"e string, n string, affected {shape}")
    assert [r.f for r in df.select(fixed_version(F.col("affected"), F.col("e"), F.col("n")).alias("f")).collect()] == ["1.2", None, None]


def test_markdown_sections_and_table_order(spark):
    from siltmark import sinks as SI
    from siltmark.operators import findings as FN

    rows = [("r", "a", "todo", "info", "t|1", "x:1", 9, "d", None, 1, 0), ("r", "b", "security", "critical", "t2", "y", 1, "d", None, 2, 5), ("r", "c", "todo", "warning", "t3", "z", 4, "d", None, 3, 7)]
    df = spark.createDataFrame(rows, "repo_id string, id string, category string, severity string, title string, location string, age_days int, detail string, evidence string, ord long, relevance int")
    lines = [r.line for r in SI.markdown_sections(df).orderBy("position").collect()]
    assert lines == ["## security (1)", "- **critical** t2 (y)", "## todo (2)", "- **warning** t3 (z)", "- **info** t\\|1 (x:1)"]
    assert [r.id for r in FN.table_order(df).collect()] == ["a", "c", "b"] and [r.id for r in FN.table_order(df, searching=True).collect()] == ["c", "b", "a"]
