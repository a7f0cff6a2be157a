"""Every named query against its SQL, and the entry points."""

import hashlib
import math
import re
from collections import Counter

import compare
import pytest

import __spark_entry__
from siltmark.plans import queries as Q
from siltmark.plans import views as V
from siltmark.session import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return compare.connection(SF)


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_gives_the_rows_of_its_sql(spark, duck, name):
    assert compare.differences(Q.QUERIES[name](spark, SF), Q.SQL[name], duck) == ""


def test_which_queries_have_no_sql():
    assert set(Q.QUERIES) - set(Q.SQL) == {"regression_story", "rule_secrets", "rule_duplicate_code"}  # the last is compared in test_clones


def plain_secrets(rows):
    """(repo, rule, location, severity, evidence) of each credential's first place, from (repo, path, file_ord, content)."""
    from siltmark.operators.scanners import base, code

    seen = {}
    for repo, path, order, content in rows:
        for n, line in enumerate(re.split(r"\r?\n", content or ""), 1):
            for k, (rule, pattern) in enumerate(code.SECRETS):
                for m in re.finditer(pattern, line, re.ASCII):
                    value = m[1]
                    if rule == "generic":
                        counts = Counter(value)
                        bits = -sum(c / len(value) * math.log2(c / len(value)) for c in counts.values())
                        if bits < 3.5 or re.search(r"^\$\{|^<|(?i:example|changeme|placeholder|your[-_])", value):
                            continue
                    digest = hashlib.sha256(value.encode()).hexdigest()
                    found = (k, order, n, rule, f"{path}:{n}", "info" if re.search(base.TESTS, path) else "critical", value[:4] + "*" * 8)
                    seen[repo, digest] = min(seen.get((repo, digest), found), found)
    return {(repo, f"secret-{rule}-{digest[:12]}", where, sev, shown) for (repo, digest), (_, _, _, rule, where, sev, shown) in seen.items()}


def test_secrets_match_a_plain_search(spark, tmp_path):
    small = table(spark, "/root/testdata/sf0.01", "documents")
    extra = [("s1", 'password = "Zx9Qw8Er7Ty6Ui5Op4As" and token: \'aaaaaaaaaaaaaaaaaaaaaaaa\''), ("s1", "AKIA" + "ABCDEFGH12345678 and again\r\nAKIA" + "ABCDEFGH12345678"), ("s2", "secret: 'example-Zx9Qw8Er7Ty6Ui5'\napi_key='Zx9Qw8Er7Ty6Ui5Op4As'"), ("s2", None), ("s2", "-----BEGIN RSA PRIVATE KEY-----")]
    planted = spark.createDataFrame([(10**7 + k, t, s) for k, (s, t) in enumerate(extra)], "doc_id long, text string, source string")
    small.select("doc_id", "text", "source").unionByName(planted).write.parquet(f"{tmp_path}/documents.parquet")
    rows = [(r.source, f"notes/{r.doc_id}.py", r.doc_id, r.text) for r in table(spark, str(tmp_path), "documents").collect()]
    want = plain_secrets(rows)
    got = {(r.repo_id, r.id, r.location, r.severity, r.evidence) for r in Q.QUERIES["rule_secrets"](spark, str(tmp_path)).collect()}
    assert got == want and len(want) >= 10


def test_regression_story_matches_plain_counts(spark):
    from siltmark.functions import scoring as S

    rows = {}
    for r in V.findings(spark, SF).collect():
        rows.setdefault(r.repo_id % 1000, []).append((r.location.split(":")[0], r.severity, r.title, r.ord))

    def score(found):
        lost = 0.0
        for s in S.SEVERITIES:
            n = sum(x[1] == s for x in found)
            lost += S.WEIGHTS[s] * (n if n <= S.FULL[s] else S.FULL[s] + (n - S.FULL[s]) ** S.TAIL[s])
        return max(0, math.floor(100 - lost + 0.5))

    want = {}
    grade = lambda n: next((g for g, least in S.GRADE_FLOORS.items() if n >= least), "F")
    for repo, found in rows.items():
        old, new = [x for x in found if x[3] <= 2], [x for x in found if x[3] >= 2]
        if not old or not new:
            continue
        a, b = score(old), score(new)
        had, has = {x[0] for x in old}, {x[0] for x in new}
        added, fixed = len(has - had), len(had - has)
        fresh = sorted((("critical", "warning", "info").index(x[1]), x[2], x[0]) for x in new if x[0] not in had)[:5]
        moved = f"{grade(a)} {a} → {grade(b)} {b}"
        head = f"{moved} · no change" if (added, fixed, a) == (0, 0, b) else " · ".join([f"{moved} ({b - a:+d})" if b > a else f"{moved} ({b - a})"] + [f"{added} new"] * (added > 0) + [f"{fixed} fixed"] * (fixed > 0))
        want[repo] = (b - a, added, fixed, head, [(x[2], x[1]) for x in fresh])
    got = {r.repo_id: (r.score_delta, r.added, r.fixed, r.headline, [(x.id, x.title) for x in r.new_findings or []]) for r in Q.QUERIES["regression_story"](spark, SF).collect()}
    assert got == want


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["repo_id", "critical", "warning", "info", "findings", "score", "grade"] and df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_results_do_not_depend_on_partitions(spark):
    from siltmark.operators import metrics
    from siltmark.plans import views

    f = views.findings(spark, SF)
    for make in (metrics.hotspot_files, metrics.issue_costs, metrics.quick_wins):
        a, b = (sorted(map(str, make(x).collect())) for x in (f, f.repartition(7)))
        assert a == b


def test_dependency_reach_reads_every_edge(spark, tmp_path):
    steps = [(200, 1), (7, 2), (14, 50), (150, 4)]
    spark.createDataFrame(steps, "l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    want, more = {0}, True
    while more:
        more = {s * 7 % 200 for p, s in steps if p % 200 in want} - want
        want |= more
    assert want == {0, 7, 14, 150, 28}
    assert {r.name for r in Q.QUERIES["dependency_reach"](spark, str(tmp_path)).collect()} == want


def test_merged_history_keeps_every_point(spark, tmp_path):
    n = 10_050
    spark.range(1, n + 1).selectExpr("1L as o_custkey", "id * 6 as o_orderkey", "cast(date_add(date '1970-01-01', cast(id as int)) as timestamp) as o_orderdate", "cast(id as double) as o_totalprice").write.parquet(f"{tmp_path}/orders.parquet")
    assert Q.QUERIES["merged_history"](spark, str(tmp_path)).count() == n


def test_merged_history_whole_has_the_day_of_every_scan(spark):
    from siltmark.plans import views

    days = {(r.repo_id, r.scan_ts.date()) for r in views.scans(spark, SF).collect()}
    assert {(r.repo_id, r.scan_ts.date()) for r in Q.QUERIES["merged_history_whole"](spark, SF).collect()} == days
