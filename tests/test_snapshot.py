"""The snapshot that rule queries share: dealt over the cluster, and not taken for small."""

from siltmark.operators.scanners import RULES
from siltmark.plans import rules

D = "/root/testdata/sf0.1"


def _estimate(df):
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def test_customers_are_dealt_before_they_become_files(spark):
    assert rules.snapshot(spark, D).files.rdd.getNumPartitions() > 1


def test_files_are_not_taken_for_as_small_as_the_table_of_customers(spark):
    c = spark.read.parquet(f"{D}/customer.parquet").select("c_custkey")
    assert _estimate(rules.snapshot(spark, D).files) > 50 * _estimate(c)


def test_lines_of_blame_are_not_broadcast(spark):
    s = rules.snapshot(spark, D)
    plan = RULES["todo-debt"](s)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_lines_that_read_the_environment_are_made_once(spark):
    plan = RULES["env-lifecycle"](rules.snapshot(spark, D))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastNestedLoopJoin") <= 6


def test_an_answer_is_parsed_once(spark):
    from siltmark.sources import host

    df = host.repositories(spark.createDataFrame([(1, "{}")], "id long, payload string"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("parseJson") + df._jdf.queryExecution().optimizedPlan().toString().count("parse_json") == 1


def test_findings_of_one_id_have_one_order(spark):
    from siltmark import sinks

    rows = [("r", "a-1", "info", 3, 1, f"src/f{k}.ts:1", "todo", "t") for k in (3, 1, 2)]
    names = "repo_id string, id string, severity string, age_days int, ord int, location string, category string, title string"
    for order in (rows, rows[::-1]):
        got = sinks.ordered(spark.createDataFrame(order, names)).orderBy("position").collect()
        assert [r.location for r in got] == [f"src/f{k}.ts:1" for k in (1, 2, 3)]


def test_only_files_that_a_rule_asks_for_are_written_out(spark):
    """The condition on paths is met before customers meet the places, not by texts that were made."""
    plan = rules.snapshot(spark, D).matching(r"\.py$")._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan[: plan.index("Join Inner")]


def test_workflows_are_judged_where_they_lie(spark):
    """Only what is found is dealt: for its age (with the lines of blame) and for the limit of its repository."""
    plan = RULES["workflow-security"](rules.snapshot(spark, D))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 4 and "SortAggregate" not in plan


def test_nodes_of_files_are_those_of_their_texts_in_parts_of_any_size(spark, monkeypatch):
    from siltmark.sources import yaml

    texts = ["on: push\njobs:\n  t: [a, b]\n", "", None, "x: 1\n", "- é\n- b: &k {c: 1}\n- *k\n", "# none\n"]
    files = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id long, content string").coalesce(1)
    for most in (1, 3, 20_000):
        monkeypatch.setattr(yaml, "_SENT", most)
        got = {r.id: [[list(n[0]), *n[1:]] for n in r.nodes] for r in yaml.yaml_files(files).collect()}
        assert got == {k: yaml.nodes(t) for k, t in enumerate(texts) if t}


def test_exports_and_definitions_are_seen_where_their_files_lie(spark):
    """Neither tokens nor lines are dealt to see what stands before them."""
    plan = RULES["dead-code"](rules.snapshot(spark, D))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("lag(", "lead(", "last(", "collect_list("))


def test_many_tokens_of_one_file_are_looked_through_once(spark):
    """A token's neighbours are looked up in an array that is made once, so time follows the length of the file."""
    import time

    from siltmark.operators.scanners import Snapshot, deps

    code = "".join(f"import a{k} from 'm{k}';\n" for k in range(20_000))
    files = spark.createDataFrame([("r", "a.ts", 0, len(code), code)], "repo_id string, path string, file_ord long, size long, content string")
    s = Snapshot(files=files, limits=None)
    assert s.tokens.count() == 100_000
    start = time.time()
    assert deps.module_specs(s).filter("form = 'from'").count() == 20_000
    assert time.time() - start < 30


def test_lines_of_code_are_made_where_their_files_lie(spark):
    """Lines of tokens are not gathered, and files are read once a language beside the tokens."""
    plan = RULES["insecure-code"](rules.snapshot(spark, D))._jdf.queryExecution().executedPlan().toString()
    assert "collect_list(" not in plan and plan.count("BroadcastNestedLoopJoin") <= 2


def test_lines_of_tokens_keep_their_numbers(spark):
    from siltmark.operators.scanners import Snapshot

    code = "\n// one\neval(x); `a\n${b}\nselect`; y\r\n\n  z /* c\n d */ w // end"
    s = Snapshot(files=spark.createDataFrame([("r", "a.ts", 0, len(code), code), ("r", "b.ts", 1, 0, "")], "repo_id string, path string, file_ord long, size long, content string"))
    assert sorted((r.path, r.line, r.text) for r in s.js_lines.collect()) == [("a.ts", 3, "eval ( x ) ; `$q`"), ("a.ts", 5, "; y"), ("a.ts", 7, "z"), ("a.ts", 8, "w")]
    assert [(r.id, r.evidence) for r in RULES["insecure-code"](s).collect()] == [("insecure-eval-dynamic-a.ts:3", "eval(x); `a")]
