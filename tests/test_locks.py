"""YAML nodes, lockfiles of three kinds, and what they say of vulnerable packages."""

import json
import random

import pytest
from pyspark.sql import functions as F

from siltmark.operators.scanners import RULES, Snapshot
from siltmark.operators.scanners.deps import runtime_names
from siltmark.sources import locks
from siltmark.sources.yaml import nodes, yaml_nodes

FILES = "repo_id string, path string, file_ord long, size long, content string"


def flat(x, keys=()):
    """[(keys, value)] of a tree of dicts, lists and texts, containers with None."""
    if isinstance(x, dict):
        return [(keys, None)] * bool(keys) + [y for k, v in x.items() for y in flat(v, (*keys, k))]
    if isinstance(x, list):
        return [(keys, None)] * bool(keys) + [y for k, v in enumerate(x) for y in flat(v, (*keys, str(k)))]
    return [(keys, x)]


def quoted(rng, x, flow=False):
    style = rng.choice(["plain", "single", "double"])
    if style == "plain" and x.strip() == x and x and not set(x) & set("#'\"[]{},&*!|>%@`:\n\\-"):
        return x
    if style == "single" and "\n" not in x:
        return "'" + x.replace("'", "''") + "'"
    return '"' + x.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'


def dump(rng, x, indent=0):
    """Lines of a tree in styles taken at random."""
    pad = " " * indent
    if isinstance(x, str):
        return [pad + quoted(rng, x)]
    out = []
    for k, v in x.items() if isinstance(x, dict) else enumerate(x):
        head = pad + (quoted(rng, k) + ":" if isinstance(x, dict) else "-")
        if rng.random() < 0.2:
            out.append(rng.choice(["", pad + "# a note: [", "   "]))
        if isinstance(v, str):
            if "\n" in v and v == v.strip() and rng.random() < 0.7:
                out += [f"{head} |"] + [(" " * (indent + 3) + y if y else "") for y in v.split("\n")]
            else:
                out.append(f"{head} {quoted(rng, v)}" + rng.choice(["", "  # note"]))
        elif rng.random() < 0.3:
            text = flow(rng, v)
            out += [f"{head} {text}"] if rng.random() < 0.7 else [f"{head} {text[0]}", " " * (indent + 4) + text[1:]]
        else:
            step = 0 if isinstance(v, list) and isinstance(x, dict) and rng.random() < 0.5 else rng.choice([1, 2, 4])
            below = dump(rng, v, indent + step + (isinstance(x, list) and 1))
            first = next(i for i, y in enumerate(below) if y.strip() and not y.strip().startswith("#"))
            if isinstance(x, list) and rng.random() < 0.6 and first == 0:
                own = len(below[0]) - len(below[0].lstrip())
                out += [head + " " * (own - indent - 1) + below[0].lstrip()] + below[1:]
            else:
                out += [head] + below
    return out


def flow(rng, x):
    if isinstance(x, str):
        return quoted(rng, x, True)
    gap = rng.choice(["", " "])
    if isinstance(x, dict):
        return "{" + gap + ", ".join(f"{quoted(rng, k)}: {flow(rng, v)}" for k, v in x.items()) + gap + "}"
    return "[" + gap + ", ".join(flow(rng, v) for v in x) + gap + "]"


def tree(rng, depth=0):
    words = ["a", "b c", "x.y/z", "it's", 'say "hi"', "1.0", "on", "k: v", "# no", "[z]", "two\nlines", "a\n  b\n\nc", "^1.2", "@s/n", "${{ x }}", "-d", "é"]
    if depth > 3 or (depth and rng.random() < 0.4):
        return rng.choice(words)
    if rng.random() < 0.35 and depth:
        return [tree(rng, depth + 1) for _ in range(rng.randrange(1, 4))]
    return {k.replace("\n", " "): tree(rng, depth + 1) for k in rng.sample(words, rng.randrange(1, 5))}


def test_nodes_give_back_random_trees():
    for seed in range(400):
        rng = random.Random(seed)
        x = tree(rng)
        text = "\n".join(dump(rng, x)) + "\n"
        assert [(tuple(n[0]), n[1]) for n in nodes(text)] == flat(x), text


def test_lines_spans_anchors_and_odd_texts():
    text = "base: &b  # note\n  x: 1\n  l: [p,\n    q]\nmore:\n  <<: *b\n  own: *none\nsteps:\n- run: |\n    a # kept\n\n     b\n- &s {k: v}\n- *s\nlast: goes\n  on\n"
    got = {".".join(n[0]): (n[1], n[2], n[3], n[4]) for n in nodes(text)}
    assert got["base"] == (None, "map", 1, 4) and got["base.l.1"] == ("q", "value", 3, 3) and got["more.x"][:2] == ("1", "value") and got["more.l.0"][0] == "p"
    assert got["more.own"][0] is None and got["steps"][2:] == (8, 14) and got["steps.0.run"] == ("a # kept\n\n b", "block", 9, 12) and got["steps.2.k"][0] == "v" and got["last"] == ("goes on", "value", 15, 16)
    for odd in (None, "", "\n\n", "# only\n", "---\n...\n", "[", "}{", ": x", "a: [1, {b", "\ta: 1", "a: b: c", "-", "- -", "x" * 10_000, "a: " + "[" * 5000, "&", "*", "a: &x *x", "k: 'open", "?\n"):
        assert isinstance(nodes(odd), list)
    wide = "p:\n" + "".join(f"  k{k}: {{a: {k}}}\n" for k in range(30_000))
    assert nodes(wide)[0][4] == 30_001


def test_nodes_of_a_frame(spark):
    files = spark.createDataFrame([("r", "a.yml", "x: [1, 2]"), ("r", "b.yml", None), ("r", "c.yml", "")], "repo_id string, path string, content string")
    assert sorted((r.path, ".".join(r["keys"]), r.value, r.line) for r in yaml_nodes(files).collect()) == [("a.yml", "x", None, 1), ("a.yml", "x.0", "1", 1), ("a.yml", "x.1", "2", 1)]


def pnpm(importers, snapshots, form):
    """Text of a pnpm lockfile: importers {path: {group: {name: version}}}, snapshots {(name, version): {group: {name: version}}}."""
    key = {"new": lambda n, v: f"'{n}@{v}(peer@1.0.0)'", "slash": lambda n, v: f"/{n}@{v}", "old": lambda n, v: f"/{n}/{v}"}[form]
    out = ["lockfileVersion: '9.0'", "", "importers:", ""]
    for path, groups in importers.items():
        out += [f"  {path}:"]
        for group, deps in groups.items():
            out += [f"    {group}:"]
            for n, v in deps.items():
                out += [f"      '{n}':", f"        specifier: ^{v}", f"        version: {v}"] if form == "new" else [f"      '{n}': {v}"]
        out += [""]
    out += ["packages:", ""]
    for (n, v), groups in snapshots.items():
        out += [f"  {key(n, v)}:", "    resolution: {integrity: sha512-x==}"]
        for group, deps in groups.items():
            out += [f"    {group}:"] + [f"      '{d}': {w}" for d, w in deps.items()]
        out += ["    dev: true", ""]
    return "\n".join(out)


def test_runtime_names_of_three_kinds_of_lockfiles(spark):
    rng, rows, want, versions = random.Random(2), [], {}, {}
    names = ["a", "b", "@s/c", "d-e", "f.g", "h", "i", "@s/j", "k", "l"]
    for k in range(60):
        repo = f"r{k}"
        edges = {n: {g: {d: "1.0.0" for d in rng.sample(names, rng.randrange(0, 3))} for g in ("dependencies", "optionalDependencies") if rng.random() < 0.6} for n in names}
        importers = {p: {g: {n: "1.0.0" for n in rng.sample(names, rng.randrange(0, 3))} for g in ("dependencies", "devDependencies", "optionalDependencies")} for p in (".", "packages/x")[: rng.randrange(1, 3)]}
        todo = [n for i in importers.values() for g in ("dependencies", "optionalDependencies") for n in i[g]]
        seen = set()
        while todo:
            if (n := todo.pop()) not in seen:
                seen.add(n)
                todo += [d for g in edges[n].values() for d in g]
        kind = k % 4
        if kind == 0:
            rows.append((repo, "pnpm-lock.yaml", pnpm(importers, {(n, "1.2.3"): g for n, g in edges.items()}, rng.choice(["new", "slash", "old"]))))
            want[repo] = seen or None
            versions[repo] = {n: "1.2.3" for n in names}
        elif kind == 1:
            dev = {n: rng.random() < 0.5 for n in names}
            flat_map = {"": {"dependencies": {}}} | {f"node_modules/{n}": {"version": "2.0.0", **({"dev": True} if dev[n] else {})} for n in names} | {"node_modules/a/node_modules/b": {"version": "9.0.0"}, "packages/x": {"version": "1.0.0"}}
            rows.append((repo, "package-lock.json", json.dumps({"lockfileVersion": 3, "packages": flat_map})))
            rows.append((repo, "pnpm-lock.yaml", pnpm(importers, {}, "new")))  # npm's own marks come first
            want[repo] = {n for n in names if not dev[n]} | {"b"}
            versions[repo] = {n: "2.0.0" for n in names}
        elif kind == 2:
            deep = {"version": "3.0.0", "dev": True}
            for n in names:
                deep = {"version": "3.0.0", "dev": rng.random() < 0.5, "dependencies": {n: deep}}
            rows += [(repo, "package-lock.json", "{not JSON"), (repo, "npm-shrinkwrap.json", json.dumps({"lockfileVersion": 1, "dependencies": {"top": deep}}))]
            want[repo], todo = set(), [("top", deep)]
            versions[repo] = {}
            while todo:
                n, v = todo.pop()
                want[repo] |= set() if v["dev"] else {n}
                versions[repo].setdefault(n, "3.0.0")
                todo += list(v.get("dependencies", {}).items())
        else:
            rows.append((repo, "yarn.lock", "# yarn\n\n" + "\n".join(f'"{n}@^1.0.0", {n}@^1.1.0:\n  version "4.0.{i}"\n  resolved "x"\n  dependencies:\n    q "^1"\n' for i, n in enumerate(names))))
            want[repo] = None
            versions[repo] = {n: f"4.0.{i}" for i, n in enumerate(names)}
    t = spark.createDataFrame(rows, "repo_id string, path string, content string")
    n = locks.pnpm_nodes(t)
    names_df, known = runtime_names(t, n)
    got = {}
    for r in names_df.collect():
        got.setdefault(r.repo_id, set()).add(r.name)
    sure = {r.repo_id for r in known.collect()}
    assert sure == {r for r, x in want.items() if x is not None}
    assert {r: got.get(r, set()) for r in sure} == {r: x for r, x in want.items() if x is not None}
    found = {}
    for r in locks.installed(t, n).collect():
        found.setdefault(r.repo_id, {})[r.name] = r.version
    assert found == versions


def test_declared_versions_by_precedence(spark):
    pkg = json.dumps({"dependencies": {"a": "^1.0.0", "b": "~2.1.0", "c": ">=3.0.1 <4", "d": "*"}, "devDependencies": {"a": "^9.0.0", "e": "5.5.5-rc.1"}})
    npm = json.dumps({"packages": {"node_modules/a": {"version": "1.1.1"}}, "dependencies": {"a": {"version": "7.7.7"}, "x": {"version": "1.0.0"}}})
    lock = pnpm({".": {"dependencies": {"b": "2.1.0"}}}, {("b", "2.2.2"): {}, ("a", "8.8.8"): {}}, "new")
    yarn = 'c@^3:\n  version "3.3.3"\n\nb@^2:\n  version "2.9.9"\n'
    rows = [("r", "package.json", pkg), ("r", "package-lock.json", npm), ("r", "pnpm-lock.yaml", lock), ("r", "yarn.lock", yarn), ("bare", "package.json", pkg), ("bad", "package.json", "{"), ("none", "README.md", "")]
    got = {(r.repo_id, r.name): (r.version, r.source) for r in locks.declared_versions(spark.createDataFrame(rows, "repo_id string, path string, content string")).collect()}
    assert got == {
        ("r", "a"): ("1.1.1", "npm"), ("r", "b"): ("2.2.2", "pnpm"), ("r", "c"): ("3.3.3", "yarn"), ("r", "e"): ("5.5.5-rc.1", "range"),
        ("bare", "a"): ("9.0.0", "range"), ("bare", "b"): ("2.1.0", "range"), ("bare", "c"): ("3.0.1", "range"), ("bare", "e"): ("5.5.5-rc.1", "range"),
    }


@pytest.mark.parametrize("kind", ["pnpm", "npm", "yarn", "none"])
def test_vulnerable_deps_follow_the_lockfile(spark, kind):
    pkg = json.dumps({"dependencies": {"app": "^1.0.0"}, "devDependencies": {"tool": "^1.0.0"}})
    graph = {("app", "1.0.0"): {"dependencies": {"deep": "1.0.0"}}, ("deep", "1.0.0"): {}, ("tool", "1.0.0"): {"dependencies": {"below": "1.0.0"}}, ("below", "1.0.0"): {}}
    text = {
        "pnpm": ("pnpm-lock.yaml", pnpm({".": {"dependencies": {"app": "1.0.0"}, "devDependencies": {"tool": "1.0.0"}}}, graph, "new")),
        "npm": ("package-lock.json", json.dumps({"packages": {f"node_modules/{n}": {"version": "1.0.0", "dev": n in ("tool", "below")} for n, _ in graph}})),
        "yarn": ("yarn.lock", "".join(f'{n}@^1.0.0:\n  version "1.0.0"\n\n' for n, _ in graph)),
    }
    rows = [("r", "package.json", pkg)] + ([("r", *text[kind])] if kind in text else [])
    files = spark.createDataFrame([(r, p, k, len(c), c) for k, (r, p, c) in enumerate(rows)], FILES)
    adv = spark.createDataFrame([("npm", n, "1.0.0", f"V-{n}", "s", "HIGH", None, None) for n, _ in graph], "ecosystem string, name string, version string, vuln_id string, summary string, label string, alias string, fixed string")
    got = {r.id: r.severity for r in RULES["vulnerable-deps"](Snapshot(files=files, advisories=adv)).collect()}
    known = {"vuln-app-V-app": "critical", "vuln-deep-V-deep": "critical", "vuln-tool-V-tool": "warning", "vuln-below-V-below": "info"}
    assert got == {"pnpm": known, "npm": known, "yarn": known | {"vuln-below-V-below": "critical"}, "none": {k: v for k, v in known.items() if "app" in k or "tool" in k}}[kind]


def test_no_files(spark):
    t = spark.createDataFrame([], "repo_id string, path string, content string")
    assert locks.installed(t).collect() == [] and locks.declared_versions(t).collect() == [] and yaml_nodes(t).select(F.lit(1)).collect() == []
