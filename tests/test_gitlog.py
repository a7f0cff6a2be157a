"""The data source of commit logs against the frame parser."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from siltmark.sources import git, gitlog


def line(rng, t):
    return "\x1f".join([f"{rng.getrandbits(160):040x}", str(t), " ".join(f"{rng.getrandbits(40):010x}" for _ in range(rng.randrange(3))), rng.choice(["", "tag: v1", "HEAD -> main"]), rng.choice(["Fix", "é \x1f part", "", "x" * 300])])


def dump(folder, seed, repos=5, n=120):
    rng = random.Random(seed)
    folder.mkdir(exist_ok=True)
    for r in range(repos):
        times = sorted((rng.randrange(1_700_000_000, 1_700_100_000) for _ in range(n)), reverse=True)
        lines = [line(rng, t) for t in times]
        lines[3:3] = ["", "not a commit", "abc\x1f12"]
        (folder / f"repo{r}.log").write_text(rng.choice(["\n", "\r\n"]).join(lines) + "\n" * (r % 2), newline="")
    (folder / "notes.txt").write_text("no log")


def plain(spark, folder):
    raw = spark.read.text(f"{folder}/*.log").select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.log$", 1).alias("repo_id"), F.col("value").alias("line"))
    return rows(git.parse_commits(raw))


def rows(df):
    return sorted((r.repo_id, r.sha, r.commit_ts, tuple(r.parents), r.subject, r.tagged) for r in df.collect())


@pytest.mark.parametrize("split", [64 << 20, 997])
def test_reads_what_the_parser_reads(spark, tmp_path, split):
    dump(tmp_path / "logs", 1)
    df = spark.read.format(gitlog.register(spark)).option("split", split).load(str(tmp_path / "logs"))
    assert rows(df) == plain(spark, tmp_path / "logs")
    assert df.rdd.getNumPartitions() >= (5 if split > 1000 else 50)


def test_lines_of_any_part_are_read_once(tmp_path):
    folder = tmp_path / "logs"
    dump(folder, 3, 1, 30)
    file = folder / "repo0.log"
    size = file.stat().st_size
    whole = list(gitlog._lines(str(folder), gitlog.Part("r", str(file), 0, size)))
    assert whole == [x.rstrip("\r") for x in file.read_text(newline="").rstrip("\n").split("\n")]
    for step in (1, 7, 64, 500):
        assert [x for a in range(0, size, step) for x in gitlog._lines(str(folder), gitlog.Part("r", str(file), a, min(a + step, size)))] == whole


def test_filters_reach_the_source(spark, tmp_path):
    dump(tmp_path / "logs", 2)
    df = spark.read.format(gitlog.register(spark)).load(str(tmp_path / "logs"))
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    low, high = dt.datetime(2023, 11, 15, 0, tzinfo=dt.UTC), dt.datetime(2023, 11, 15, 12, tzinfo=dt.UTC)
    some = df.filter((F.col("repo_id") == "repo2") & (F.col("commit_ts") >= F.lit(low)) & (F.col("commit_ts") < F.lit(high)) & F.col("subject").contains("x"))
    want = [r for r in plain(spark, tmp_path / "logs") if r[0] == "repo2" and low <= r[2].replace(tzinfo=dt.UTC) < high and "x" in r[4]]
    assert rows(some) == want and want
    plan = some._jdf.queryExecution().executedPlan().toString()
    above = plan.split("BatchScan")[0]
    assert "commit_ts" not in above.split("Filter", 1)[1].split("\n")[0] if "Filter" in above else True
    assert some.rdd.getNumPartitions() == 1
    assert rows(df.filter(F.col("repo_id").isin("repo0", "repo9"))) == [r for r in plain(spark, tmp_path / "logs") if r[0] == "repo0"]
    assert df.filter("repo_id = 'none'").count() == 0


def test_empty_folder(spark, tmp_path):
    (tmp_path / "none").mkdir()
    assert spark.read.format(gitlog.register(spark)).load(str(tmp_path / "none")).collect() == []


def test_stream_by_commit_time(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    rng = random.Random(4)
    old = [line(rng, t) for t in range(1_700_000_500, 1_700_000_000, -10)]
    (logs / "a.log").write_text("\n".join(old) + "\n")
    query = lambda: spark.readStream.format(gitlog.register(spark)).load(str(logs)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(once=True).start().awaitTermination(120)
    query()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 50
    new = [line(rng, t) for t in range(1_700_002_000, 1_700_001_000, -10)]
    (logs / "a.log").write_text("\n".join(new + old) + "\n")
    (logs / "b.log").write_text("\n".join(line(rng, t) for t in range(1_700_001_500, 1_700_000_600, -10)))
    query()
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == plain(spark, logs)
