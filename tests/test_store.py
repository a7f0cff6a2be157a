"""The store of scan points: batches, replays, restarts and compaction against a plain fold."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from siltmark.streaming import store

SCHEMA = "repo_id string, scan_ts timestamp, score int, note string"
T0 = dt.datetime(2026, 1, 1)


def batches(seed, n=6):
    rng = random.Random(seed)
    return [[(f"r{rng.randrange(9)}", T0 + dt.timedelta(hours=rng.randrange(12)), rng.randrange(3), f"b{k}") for _ in range(25)] for k in range(n)]


def fold(parts, keep=None):
    """Plain merge of batches: at one time of a repository a later point counts unless its score is the stored one."""
    held = {}
    for part in parts:
        own = {}
        for repo, at, score, note in part:
            own[repo, at] = max(own.get((repo, at), (-1, "")), (score, note))
        for key, (score, note) in own.items():
            if key not in held or held[key][0] != score:
                held[key] = (score, note)
    rows = [(r, t, *x) for (r, t), x in held.items()]
    if keep is None:
        return set(rows)
    return {x for repo in {x[0] for x in rows} for x in sorted((y for y in rows if y[0] == repo), key=lambda y: y[1])[-keep:]}


def stored(spark, folder, keep=None):
    return {tuple(r) for r in store.read_points(spark, folder, spark.createDataFrame([], SCHEMA).schema, keep).collect()}


def stream(spark, tmp_path, name):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))


def put(spark, tmp_path, name, parts, first=0):
    for k, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / name))


def test_batches_replays_and_compaction_match_a_plain_fold(spark, tmp_path):
    folder, parts = str(tmp_path / "store"), batches(1)
    schema = spark.createDataFrame([], SCHEMA).schema
    assert stored(spark, folder) == set() and store.compact(spark, folder, schema) == 0
    frame = lambda p: spark.createDataFrame(p, SCHEMA)
    for k, part in enumerate(parts):
        store.append_batch(frame(part), folder, "000000-a", k)
        store.append_batch(frame(part), folder, "000000-a", k)  # the batch runs again
        assert stored(spark, folder) == fold(parts[: k + 1])
        if k % 2:
            assert store.compact(spark, folder, schema, buckets=4, keep=None) == k // 2 + 1
            assert stored(spark, folder) == fold(parts[: k + 1])
    assert store.compact(spark, folder, schema, buckets=4, keep=None) == 3  # nothing new
    assert stored(spark, folder, 3) == fold(parts, 3)


def test_a_batch_writes_only_its_own_rows_and_compaction_only_touched_buckets(spark, tmp_path):
    folder = str(tmp_path / "store")
    schema = spark.createDataFrame([], SCHEMA).schema
    store.append_batch(spark.createDataFrame([(f"r{k}", T0, 1, "") for k in range(200)], SCHEMA), folder, "000000-a", 0)
    store.append_batch(spark.createDataFrame([("r1", T0, 2, "")], SCHEMA), folder, "000000-a", 1)
    assert spark.read.parquet(f"{folder}/deltas/writer=000000-a/batch=1").count() == 1
    store.compact(spark, folder, schema, buckets=8)
    store.append_batch(spark.createDataFrame([("r1", T0, 3, "")], SCHEMA), folder, "000000-a", 2)
    store.compact(spark, folder, schema, buckets=8)
    assert spark.read.parquet(f"{folder}/base/gen=1").select("bucket").distinct().count() == 8
    assert spark.read.parquet(f"{folder}/base/gen=2").select("bucket").distinct().count() == 1
    assert len(stored(spark, folder)) == 200 and ("r1", T0, 3, "") in stored(spark, folder)
    assert [p.name for p in (tmp_path / "store/deltas/writer=000000-a").iterdir()] == ["batch=2"]  # what the manifest before had folded is gone


@pytest.mark.parametrize("compact_every", [0, 2])
def test_a_restart_with_a_new_checkpoint_keeps_all_points(spark, tmp_path, compact_every):
    folder, parts = str(tmp_path / "store"), batches(5, 6)
    for name, ck, some in (("in1", "ck1", parts[:3]), ("in2", "ck2", parts[3:])):
        for part in some:
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
            store.upsert_points(stream(spark, tmp_path, name), folder, str(tmp_path / ck), compact_every).trigger(availableNow=True).start().awaitTermination(300)
    assert stored(spark, folder) == fold(parts)


def test_a_store_that_cannot_be_read_is_not_taken_for_empty(spark, tmp_path):
    folder = str(tmp_path / "store")
    store.append_batch(spark.createDataFrame([("r", T0, 1, "")], SCHEMA), folder, "000000-a", 0)
    for p in (tmp_path / "store/deltas/writer=000000-a/batch=0").glob("part-*"):
        p.write_bytes(b"not parquet")
    with pytest.raises(Exception, match="(?i)parquet|footer|malformed"):
        stored(spark, folder)


def test_points_without_repository_or_time_are_left_out(spark, tmp_path):
    folder = str(tmp_path / "store")
    rows = [(None, T0, 1, "a"), ("r", None, 1, "b"), ("r", T0, None, "c"), ("r", T0, None, "d")]
    store.append_batch(spark.createDataFrame(rows, SCHEMA), folder, "000000-a", 0)
    assert stored(spark, folder) == {("r", T0, None, "d")}
    assert spark.createDataFrame([], SCHEMA).select(F.lit(1)).count() == 0
