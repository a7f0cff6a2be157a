"""The index for many queries against one search for each query."""

import random

from siltmark.operators import findings as FI
from siltmark.operators import search as SE

FIND = "repo_id string, id string, category string, severity string, title string, location string, age_days int, detail string, evidence string, scanner string, ord long"


def rows(rng, n):
    vocab = ["lodash", "lodahs", "outdated", "todo", "TODO:", "committed", "credential", "secrets", "a", "ab", "abc", "é", "x_1", "token", "tokens", "broken-link", "README.md", "src/a.ts:3", "unused", "export", "stale", "leaked", "İ"]
    cats = ["security", "env", "dependency", "branch", "todo", "dead-code", "hygiene", "", None]
    return [(f"r{k % 7}", f"i{k}", rng.choice(cats), rng.choice(["info", "warning", None]), " ".join(rng.choice(vocab) for _ in range(rng.randrange(0, 5))), rng.choice(["src/lodash.ts:4", "", None]), 0, rng.choice(["", "see " + rng.choice(vocab), None]), None, rng.choice(["ci-health", None, "secrets"]), k) for k in range(n)]


def test_index_equals_a_search_for_each_query(spark):
    rng = random.Random(5)
    df = spark.createDataFrame(rows(rng, 160), FIND)
    queries = ["lodash", "lodahs", "lodas out", "Small TODO", "a", "ab a", "a a", "abcd", "secret", "sec tok", "tokne", "docs", "x_1 link", "ci", "hygiene", "zzzz", "md readme", "dep", "é lodash", "branches stale", "s", "credentials leak", "unuse exports"]
    queries += [" ".join(rng.choice(["lo", "todos", "ex", "abc", "lodashes", "li", "to", "config"]) for _ in range(rng.randrange(1, 4))) for _ in range(12)]
    index = SE.build(df)
    table = spark.createDataFrame([(q,) for q in [*queries, "", "!!", None, queries[0]]], "query string")
    got = {}
    for r in SE.search_all(index, table).collect():
        got.setdefault(r.query, {})[r.repo_id, r.id] = r.relevance
    for q in queries:
        assert got.get(q, {}) == {(r.repo_id, r.id): r.relevance for r in FI.search(df, q).select("repo_id", "id", "relevance").collect()}, q
    assert set(got) <= set(queries) and sum(map(len, got.values())) > 200


def test_empty_index_and_no_queries(spark):
    df = spark.createDataFrame(rows(random.Random(1), 5), FIND)
    queries = spark.createDataFrame([("todo",)], "query string")
    assert SE.search_all(SE.build(df.limit(0)), queries).collect() == []
    assert SE.search_all(SE.build(df), queries.limit(0)).collect() == []


def test_findings_of_one_text_are_looked_up_once_and_all_returned(spark, monkeypatch):
    """Many findings of few texts: what queries meet grows with the texts; a text of many findings is handed out in parts."""
    monkeypatch.setattr(SE, "CHUNK", 40)
    texts = [("security", "leaked token"), ("todo", "todo in the code"), ("", "unused export"), (None, "stale")]
    df = spark.createDataFrame([(f"r{k % 5}", f"i{k}", *texts[k % 4 if k < 300 else 0], "", "", "info", "") for k in range(600)], "repo_id string, id string, category string, title string, detail string, location string, severity string, scanner string")
    index = SE.build(df)
    assert index.postings.count() == 14 and index.members.count() == 600
    queries = ["tok", "todo code", "secret", "unuse", "stale", "e"]
    got = SE.search_all(index, spark.createDataFrame([(q,) for q in queries], "query string")).collect()
    want = {(q, r.repo_id, r.id, r.relevance) for q in queries for r in FI.search(df, q).collect()}
    assert len(got) == len(want) and {tuple(r) for r in got} == want
