"""Rate windows and history streams: batch and stream against plain loops, for any split into batches."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from siltmark.operators import limits
from siltmark.operators import timeline as TL
from siltmark.streaming import ordered

START = dt.datetime(2026, 1, 1, tzinfo=dt.UTC)


def hits(seed=1, n=400, span=7200.0):
    """(client, microseconds, event_id): clients of very different rates, hits at one time, gaps, and one that comes exactly at a reset."""
    rng = random.Random(seed)
    out = [(f"c{min(int(rng.expovariate(0.7)), 5)}", int(rng.random() ** 2 * span * 1e6), k) for k in range(n)]
    out += [("edge", 10_000_000, n), ("edge", 309_999_999, n + 1), ("edge", 310_000_000, n + 2), ("edge", 310_000_000, n + 3), ("edge", 610_000_000, n + 4), ("one", 5, n + 5)]
    return out + [("c0", t, n + 10 + k) for k, (_, t, _) in enumerate(out[:60])]


def plain_fixed(rows, most, seconds):
    open_, out = {}, {}
    for c, t, e in sorted(rows, key=lambda r: (r[1], r[2])):
        start, n = open_.get(c, (None, 0))
        if start is None or t >= start + seconds * 1_000_000:
            start, n = t, 0
        ok = n < max(1, most)
        open_[c] = (start, n + ok)
        out[e] = (c, start, ok)
    return out


def plain_sliding(rows, most, seconds):
    held, out = {}, {}
    for c, t, e in sorted(rows, key=lambda r: (r[1], r[2])):
        times = [x for x in held.get(c, []) if x > t - seconds * 1_000_000]
        ok = len(times) < most
        held[c] = times + [t] * ok
        out[e] = (c, ok, most - len(held[c]))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(c, t, e) for c, t, e in rows], "client string, t long, event_id long").withColumn("event_ts", F.timestamp_micros(F.col("t") + int(START.timestamp()) * 1_000_000))


def since(column):
    return (F.unix_micros(column) - int(START.timestamp()) * 1_000_000).alias(column)


@pytest.mark.parametrize("most, seconds", [(3, 300), (1, 60), (0, 1000), (1000, 86400)])
def test_fixed_windows_match_a_plain_loop(spark, most, seconds):
    rows = hits()
    df = frame(spark, rows).withColumn("opened", F.lit("x")).repartition(7)
    got = {r.event_id: (r.client, r.opened_at, r.allowed) for r in limits.fixed_windows(df, most, seconds).select("client", "event_id", since("opened_at"), "allowed").collect()}
    assert got == plain_fixed(rows, most, seconds)


def test_fixed_windows_of_odd_rows(spark):
    rows = spark.createDataFrame([(None, START, 1), ("a", None, 2), ("a", START, 3), ("a", START, 3), ("a", START, 4)], "client string, event_ts timestamp, event_id long")
    got = sorted(((r.event_id, r.allowed, r.opened_at is None) for r in limits.fixed_windows(rows, 1, 60).collect()), key=str)
    assert got == [(1, None, True), (2, None, True), (3, True, False), (3, True, False), (4, False, False)]
    assert limits.fixed_windows(rows.limit(0), 1, 60).collect() == []


def streamed(spark, tmp_path, parts, make, end, name):
    """Rows of a stream that reads one part a batch, then a row far ahead that moves the watermark past all others."""
    folder = str(tmp_path / name)
    for k, part in enumerate([*parts, end]):
        part.coalesce(1).write.parquet(f"{folder}/b={k:03d}")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ordered.PROVIDER)
    try:
        source = spark.readStream.schema(StructType([*end.schema.fields, StructField("b", IntegerType())])).option("maxFilesPerTrigger", 1).parquet(folder).drop("b")
        make(source).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-ck")).trigger(availableNow=True).start().awaitTermination(300)
        return spark.table(name).collect()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


@pytest.mark.parametrize("split", ["whole", "by time", "mixed"])
def test_streams_decide_like_plain_loops(spark, tmp_path, split):
    rows = hits(seed=3, n=150)
    rng = random.Random(9)
    if split == "whole":
        parts = [rows]
    elif split == "by time":
        ordered_rows = sorted(rows, key=lambda r: r[1])
        parts = [ordered_rows[i : i + 60] for i in range(0, len(rows), 60)]
    else:
        mixed = rng.sample(rows, len(rows))
        parts = [mixed[i::3] for i in range(3)]
    frames = [frame(spark, p) for p in parts]
    end = frame(spark, [("end", 10**12, -1)])
    late = "3 hours"
    key = split.replace(" ", "_")
    got = streamed(spark, tmp_path, frames, lambda s: ordered.fixed_windows(s, 3, 300, late).withColumn("opened_at", since("opened_at")), end, f"fixed_{key}")
    assert {r.event_id: (r.client, r.opened_at, r.allowed) for r in got} == plain_fixed(rows, 3, 300)
    got = streamed(spark, tmp_path, frames, lambda s: ordered.rate_limit(s, 4, 300, late), end, f"sliding_{key}")
    assert {r.event_id: (r.client, r.allowed, r.remaining) for r in got} == plain_sliding(rows, 4, 300)
    assert all((r.retry_after == 0) == r.allowed for r in got)


@pytest.mark.parametrize("parts", [1, 4])
def test_scan_changes_equal_successive_diffs(spark, tmp_path, parts):
    rng = random.Random(parts)
    scans, findings = [], []
    for repo in ("a", "b", "c"):
        for k in range(8):
            ids = sorted(rng.sample("abcdefghij", rng.randrange(0, 7)))
            scans.append((repo, START + dt.timedelta(hours=k * (2 if repo == "a" else 5)), k, ids))
            findings += [(repo, k, i) for i in ids or ["-"]]
    rng.shuffle(scans)
    schema = "repo_id string, scan_ts timestamp, scan_id long, ids array<string>"
    frames = [spark.createDataFrame(scans[i::parts], schema) for i in range(parts)]
    end = spark.createDataFrame([("end", START + dt.timedelta(days=90), 0, [])], schema)
    got = streamed(spark, tmp_path, frames, lambda s: ordered.scan_changes(s, "60 days"), end, f"changes_{parts}")
    rows = spark.createDataFrame(findings, "repo_id string, scan_idx long, id string")
    counts = {(r.repo_id, r.scan_idx): (r.added, r.fixed) for r in TL.successive_diffs(rows).collect()}
    blank = lambda repo, k: not next(s[3] for s in scans if s[0] == repo and s[2] == k)
    want = {(r, k): (a - blank(r, k) + (blank(r, k) and blank(r, k - 1)), f - blank(r, k - 1) + (blank(r, k) and blank(r, k - 1))) for (r, k), (a, f) in counts.items()}
    assert {(r.repo_id, r.scan_id): (r.added, r.fixed) for r in got} == want
    assert all(len(r.new_ids) == r.added and len(r.fixed_ids) == r.fixed for r in got)
