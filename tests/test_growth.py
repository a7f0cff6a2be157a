"""What queries read and move as tables grow: once, and no more than they need."""

from siltmark.operators import config, metrics

FIND = "repo_id string, id string, category string, severity string, location string"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_hotspots_read_findings_once(spark, tmp_path):
    rows = [("one", f"a{k}", "todo", s, f"f{k}:1") for k, s in enumerate(["info", "critical", "warning"])]
    rows += [("many", f"b{k}", "todo", s, f"{p}:{k}") for k, (p, s) in enumerate([("x", "critical"), ("y", "info"), ("y", "info"), ("z", "warning"), ("z", "info"), ("w", "critical")])]
    spark.createDataFrame(rows, FIND).write.parquet(f"{tmp_path}/f")
    out = metrics.hotspot_files(spark.read.parquet(f"{tmp_path}/f"), 2)
    assert sorted((r.repo_id, r["rank"], r.path) for r in out.collect()) == [("many", 1, "z"), ("many", 2, "y"), ("one", 1, "f1"), ("one", 2, "f2")]
    few = metrics.hotspot_files(spark.read.parquet(f"{tmp_path}/f"), 6)
    assert sorted(r.path for r in few.filter("repo_id = 'many'").collect()) == ["y", "z"] and few.filter("repo_id = 'one'").count() == 3
    assert plan(few).count("FileScan") == 1 and "WindowGroupLimit" in plan(few)


def test_muted_findings_are_read_once_and_counted_where_they_lie(spark, tmp_path):
    rows = [(f"r{k % 3}", f"i{k}", "todo", "info", f"src/d{k % 2}/f{k}:1") for k in range(12)]
    spark.createDataFrame(rows, FIND).write.parquet(f"{tmp_path}/f")
    mute = [("r0", [], [(None, None, "src/d0/**", None)], None), ("r1", [], [("i4", None, None, None), (None, "todo", "*/d1/f7", None), (None, None, None, "nothing")], None)]
    spark.createDataFrame(mute, f"repo_id string, {config._SHAPE.removeprefix('struct<').removesuffix('>').replace('ignore:', 'ignore ').replace('mute:', 'mute ').replace('weights:', 'weights ')}").write.parquet(f"{tmp_path}/c")
    left = config.unmuted(spark.read.parquet(f"{tmp_path}/f"), spark.read.parquet(f"{tmp_path}/c"))
    gone = {r for r in rows if (r[0] == "r0" and "/d0/" in r[4]) or r[1] in ("i4", "i7")}
    assert sorted(map(tuple, left.collect())) == sorted(set(rows) - gone)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        counted = plan(config.unmuted(spark.read.parquet(f"{tmp_path}/f"), spark.read.parquet(f"{tmp_path}/c")).groupBy("repo_id").count())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # findings by repository, rules without repeats, and those by repository
    assert counted.count("FileScan") == 2 and counted.count("Exchange hashpartitioning") == 3


def test_tree_reads_files_once_and_sums_folders_before_they_meet(spark, tmp_path):
    at = ["a/b/c/x:1", "a/b/c/x:2", "a/b/c/y", "d/e/z:3", "d//q", "/r", "top", ".", None, "d/e/f/g/h:1"]
    rows = [("r", f"i{k}", "todo", ("info", "critical", "warning")[k % 3], p) for k, p in enumerate(at)]
    spark.createDataFrame(rows, FIND).write.parquet(f"{tmp_path}/f")
    nodes = metrics.tree_nodes(spark.read.parquet(f"{tmp_path}/f"))
    got = {(r.node, r.kind, r.depth): (r.findings, r.weight) for r in nodes.collect()}
    want = {}
    for _, _, _, severity, p in rows:
        p = None if p in (None, ".") else p.split(":")[0]
        parts = p.split("/") if p else []
        names = [("", "root"), ("(other)", "bucket")] if p is None else [(n, "root" if n == "" else "file" if n == p else "dir") for n in ("/".join(parts[:k]) for k in range(len(parts) + 1))]
        for depth, (n, kind) in enumerate(names):
            count, weight = want.get((n, kind, depth), (0, 0.0))
            want[n, kind, depth] = count + 1, weight + {"info": 0.25, "critical": 10.0, "warning": 3.0}[severity]
    assert got == want
    labels = {r.node: r.label for r in metrics.compressed_tree(metrics.tree_nodes(spark.read.parquet(f"{tmp_path}/f"))).collect()}
    assert labels == {"a/b/c": "a/b/c", "a/b/c/x": "x", "a/b/c/y": "y", "d": "d", "d/": "", "d//q": "q", "d/e": "e", "d/e/z": "z", "d/e/f/g": "f/g", "d/e/f/g/h": "h", "/r": "/r", "top": "top"}
    assert plan(metrics.compressed_tree(nodes)).count("FileScan") == 2
