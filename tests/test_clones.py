"""Repeated blocks against a plain greedy search over files in order."""

import random
import re

import pytest
from pyspark.sql import functions as F

from siltmark.operators.scanners import RULES, Snapshot, clones
from siltmark.plans.queries import QUERIES
from siltmark.session import table

SF = "/root/testdata/sf0.001"


def plain_blocks(files, size, least=0, code=False):
    """(file, start, lines, places) in the order found: open at the first place of a repeated window that is not covered, go on while all partners follow, cover all places."""
    keys = {f: [tuple(x[i : i + size]) for i in range(len(x) - size + 1)] for f, x in files.items()}
    where = {}
    for f, ks in keys.items():
        for i, k in enumerate(ks):
            where.setdefault(k, []).append((f, i))
    covered, out = set(), []
    for f, ks in keys.items():
        for i, k in enumerate(ks):
            if (f, i) in covered or len(where[k]) < 2 or where[k][0] != (f, i):
                continue
            partners = [p for p in where[k][1:] if p not in covered]
            if not partners:
                continue
            extra = 0
            while i + extra + 1 < len(ks) and all(b + extra + 1 < len(keys[g]) and keys[g][b + extra + 1] == ks[i + extra + 1] for g, b in partners):
                extra += 1
            block = files[f][i : i + size + extra]
            if len("\n".join(block)) < least:
                continue
            if code:
                share = lambda test: sum(bool(test(x)) for x in block) / len(block)  # noqa: B023, E731
                if share(lambda x: any(re.search(p, x) for p in clones.DECLARATIVE)) >= 0.7:
                    continue
                if any(re.search(clones.SVG, x) for x in block) and share(lambda x: re.search(clones.SVG, x) or re.search(clones.ATTRIBUTE, x) or re.search(r"^</?\w", x)) >= 0.7:
                    continue
            covered |= {(g, b + e) for g, b in [(f, i), *partners] for e in range(extra + 1)}
            out.append((f, i, size + extra, tuple([(f, i), *partners])))
    return out


def plain_lines(content):
    out, inside = [], False
    for number, raw in enumerate(re.split(r"\r?\n", content), 1):
        line = raw.strip()
        if inside:
            inside = "*/" not in line
        elif line.startswith("/*"):
            inside = "*/" not in line
        elif line and not re.search(clones.COMMENT, line):
            line = re.sub(r"\s+", " ", line)
            if not re.search(clones.NOISE, line) and not re.search(clones.IMPORTS, line):
                out.append((number, line))
    return out


def repositories(seed, n):
    """Files of few different lines: blocks that overlap, repeat within a file, and begin in different first files; runs of one line; a long block in many files."""
    rng = random.Random(seed)
    out = {}
    for r in range(n):
        vocab = "abcdef"[: rng.randrange(1, 7)] + "ghijklmnop"[: rng.randrange(0, 11)]
        pieces = [[rng.choice(vocab) for _ in range(rng.randrange(3, 25))] for _ in range(3)]
        files = {}
        for k in range(rng.randrange(1, 7)):
            lines = []
            for _ in range(rng.randrange(0, 5)):
                piece = rng.choice(pieces)
                a = rng.randrange(len(piece))
                lines += piece[a : a + rng.randrange(1, 25)] if rng.random() < 0.6 else [rng.choice(vocab) for _ in range(rng.randrange(1, 10))]
                lines += [f"u{rng.random()}"] * (rng.random() < 0.4)
            files[f"f{k}"] = lines
        out[f"r{r}"] = files
    return out


@pytest.mark.parametrize("size, least", [(1, 0), (3, 0), (4, 12)])
def test_blocks_match_a_plain_greedy_search(spark, size, least):
    repos = repositories(size, 200)
    rows = [(r, f, k, n + 1, x, n) for r, files in repos.items() for k, (f, lines) in enumerate(files.items()) for n, x in enumerate(lines)]
    lines = spark.createDataFrame(rows, "repo_id string, path string, file_ord long, line int, text string, n int").repartition(5)
    kept, places = clones.blocks(lines, size, least, code=False)
    spots = {}
    for p in places.collect():
        spots.setdefault((p.repo_id, p.key), set()).add((p.path, p.n))
    got = {(b.repo_id, b.path, b.n, b.lines, frozenset(spots[b.repo_id, b.key])) for b in kept.collect()}
    want = {(r, f, i, n, frozenset(p)) for r, files in repos.items() for f, i, n, p in plain_blocks(files, size, least)}
    assert len(want) > 50 and got == want


def test_no_lines_no_blocks(spark):
    lines = spark.createDataFrame([], "repo_id string, path string, file_ord long, line int, text string, n int")
    assert clones.blocks(lines)[0].collect() == []
    assert RULES["duplicate-code"](Snapshot(files=spark.createDataFrame([], "repo_id string, path string, file_ord long, size long, content string"))).collect() == []


def expected_findings(rows, most=15):
    """{(repository, id): (lines, places, severity)} of the rule, from (repo, path, content) in order."""
    repos = {}
    for repo, path, content in rows:
        if content and not any(re.search(p, path) for p in (clones.FOLDERS, clones.GENERATED, clones.TESTED)) and re.search(clones.CODE, path):
            repos.setdefault(repo, {})[path] = content
    out = {}
    for repo, files in repos.items():
        if len(files) < 2:
            continue
        lines = {f: plain_lines(c) for f, c in files.items() if len(c) <= 2000 or "\n" in c}
        found = plain_blocks({f: [t for _, t in x] for f, x in lines.items()}, 8, 240, True)
        found.sort(key=lambda b: (-b[2], -len(b[3])))
        for f, i, n, places in found[:most]:
            out[repo, f"duplicate-{f}:{lines[f][i][0]}"] = (n, len(places), "warning" if n >= 30 or len(places) >= 4 else "info")
    return out


def reported(df):
    return {(r.repo_id, r.id): (*(int(x) for x in re.findall(r"\d+", r.title)), r.severity) for r in df.collect()}


def test_rule_matches_a_plain_search(spark):
    rng = random.Random(11)
    block = [f"    total += price * {k} + handling_of(order, line_{k});" for k in range(40)]
    types = ["export interface Money {"] + [f"  amount{k}?: SomeVeryLongTypeName{k}" for k in range(20)] + ["}"]
    svg = ["<svg>"] + [f"<path d=\"M0 0 L{k} {k} some long drawing of a logo\" />" for k in range(20)]
    rows = []
    for repo in ("a", "b", "c"):
        for k in range(14):
            body = [f"// note {rng.random()}", "import { x } from 'y'", "/*", " * block", "*/"]
            for _ in range(4):
                part = rng.choice([block, block[5:30], types, svg, block[:9]])
                body += part + rng.choice([[], ["{"], [f"let u{rng.random()} = 1;"], ["}", "else {"], ["", "  // a", "pass"]])
            path = rng.choice(["src", "lib/deep", "tests", "examples/one", "template-react", "dist"]) + f"/f{k}" + rng.choice([".ts", ".py", ".test.ts", ".min.js", ".vue", ".md"])
            rows.append((repo, path, "\r\n".join(body) if k % 3 else "\n".join(body)))
    rows += [("lonely", "src/a.py", "\n".join(block * 2)), ("wide", "a.js", "x" * 3000), ("wide", "b.js", "x" * 3000)]
    files = spark.createDataFrame([(r, p, k, len(c), c) for k, (r, p, c) in enumerate(rows)], "repo_id string, path string, file_ord long, size long, content string")
    want = expected_findings(rows)
    assert len(want) > 5 and reported(RULES["duplicate-code"](Snapshot(files=files))) == want


def test_rule_query_matches_a_plain_search(spark):
    rows = [(r.source, f"notes/{r.doc_id}.py", r.text) for r in table(spark, SF, "documents").orderBy("doc_id").collect()]
    assert reported(QUERIES["rule_duplicate_code"](spark, SF)) == expected_findings(rows)


def test_a_hot_block_lists_the_first_places(spark):
    body = "\n".join(f"value_{k} = compute_something_long({k}, 'of a certain length')" for k in range(10))
    files = spark.range(500).select(F.lit("r").alias("repo_id"), F.format_string("src/f%03d.py", "id").alias("path"), F.col("id").alias("file_ord"), F.lit(1).cast("long").alias("size"), F.lit(body).alias("content"))
    row = RULES["duplicate-code"](Snapshot(files=files)).collect()
    assert [(r.id, r.detail) for r in row] == [("duplicate-src/f000.py:1", "The block is also at src/f001.py:1, src/f002.py:1, src/f003.py:1, src/f004.py:1 and 495 more.")]
