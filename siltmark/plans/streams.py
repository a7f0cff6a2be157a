"""Queries of rate windows, and of streams that read all that is there and end; their rows go to a folder that all machines share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import limits
from ..session import shared_folder, table
from ..streaming import ordered, store
from ..streaming.usage import daily_usage
from . import views as V
from .named import register

QUERIES, SQL, _query = register()
MOST, SECONDS = 3, 86400


def _source(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.readStream.schema(table(spark, d, name).schema).parquet(f"{d}/{name}.parquet*")


def _rows(stream: DataFrame, complete: bool = False) -> DataFrame:
    """What a stream gives until its source is read, in a shared folder. complete: its last whole result."""
    spark = stream.sparkSession
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, ordered.PROVIDER)
    try:
        writer = stream.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
        if complete:
            writer = writer.outputMode("complete").foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{folder}/rows"))
        else:
            writer = writer.outputMode("append").format("parquet").option("path", f"{folder}/rows")
        writer.start().awaitTermination()
    finally:
        spark.conf.unset(provider) if before is None else spark.conf.set(provider, before)
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def _windows_sql(ts: str) -> str:
    return f"""WITH RECURSIVE hits AS (SELECT event_id, user_id, {ts} AS ts FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL), times AS (SELECT DISTINCT user_id, ts FROM hits),
    links AS (SELECT a.user_id, a.ts, min(b.ts) AS nxt FROM times a JOIN times b ON a.user_id = b.user_id AND b.ts >= a.ts + INTERVAL {SECONDS} SECOND GROUP BY 1, 2),
    opened AS (SELECT user_id, min(ts) AS opened_at FROM times GROUP BY 1 UNION ALL SELECT o.user_id, l.nxt FROM opened o JOIN links l ON l.user_id = o.user_id AND l.ts = o.opened_at),
    placed AS (SELECT event_id, h.user_id, h.ts, max(opened_at) AS opened_at FROM hits h JOIN opened o ON h.user_id = o.user_id AND h.ts >= o.opened_at GROUP BY ALL)
    SELECT event_id, user_id, opened_at, row_number() OVER (PARTITION BY user_id, opened_at ORDER BY ts, event_id) <= {MOST} AS allowed FROM placed"""


@_query(_windows_sql("ts"))
def fixed_window_hits(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("event_ts"))
    return limits.fixed_windows(e.filter("user_id is not null and event_ts is not null"), MOST, SECONDS, client="user_id").select("event_id", "user_id", "opened_at", "allowed")


@_query(_windows_sql("date_trunc('milliseconds', ts)"))
def streaming_fixed_windows(spark: SparkSession, d: str) -> DataFrame:
    """The same windows decided by a stream, over times in milliseconds, as the watermark has them."""
    e = _source(spark, d, "events").select("event_id", F.col("user_id").alias("client"), F.date_trunc("millisecond", F.col("ts").cast("timestamp")).alias("event_ts"))
    return _rows(ordered.fixed_windows(e, MOST, SECONDS, "0 seconds")).select("event_id", F.col("client").cast("long").alias("user_id"), "opened_at", "allowed")


@_query(f"WITH usage AS ({V.USAGE}) SELECT event_ts::DATE AS day, event, count(*) AS events, sum(amount)::BIGINT AS amount FROM usage GROUP BY 1, 2")
def streaming_usage_daily(spark: SparkSession, d: str) -> DataFrame:
    """The daily roll-up as a stream."""
    events = _source(spark, d, "events").select(F.col("ts").cast("timestamp").alias("event_ts"), F.col("event_type").alias("event"), F.floor("value").cast("long").alias("amount"))
    return _rows(daily_usage(events, "400 days"), complete=True)


@_query(
    """WITH ids AS (SELECT DISTINCT o_custkey AS repo_id, o_orderdate AS scan_ts, l_partkey % 20 AS id FROM orders JOIN lineitem ON l_orderkey = o_orderkey), scans AS (SELECT repo_id, scan_ts, lag(scan_ts) OVER (PARTITION BY repo_id ORDER BY scan_ts) AS before FROM (SELECT DISTINCT repo_id, scan_ts FROM ids))
    SELECT repo_id::VARCHAR AS repo_id, scan_ts, (SELECT count(*) FROM ids i WHERE i.repo_id = s.repo_id AND i.scan_ts = s.scan_ts AND NOT EXISTS (SELECT 1 FROM ids j WHERE j.repo_id = s.repo_id AND j.scan_ts = s.before AND j.id = i.id)) AS added,
    (SELECT count(*) FROM ids i WHERE i.repo_id = s.repo_id AND i.scan_ts = s.before AND NOT EXISTS (SELECT 1 FROM ids j WHERE j.repo_id = s.repo_id AND j.scan_ts = s.scan_ts AND j.id = i.id)) AS fixed FROM scans s WHERE before IS NOT NULL"""
)
def streaming_scan_changes(spark: SparkSession, d: str) -> DataFrame:
    """Changes of a repository's findings from day to day, decided by a stream: each customer is a repository, each day of orders a scan, and parts modulo 20 its findings."""
    ids = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    scans = ids.groupBy(F.col("o_custkey").cast("string").alias("repo_id"), F.col("o_orderdate").cast("timestamp").alias("scan_ts")).agg(F.min("o_orderkey").alias("scan_id"), F.collect_set((F.col("l_partkey") % 20).cast("string")).alias("ids"))
    folder = f"{shared_folder(spark)}/scans-{uuid.uuid4().hex}"
    scans.write.parquet(folder)
    return _rows(ordered.scan_changes(spark.readStream.schema(scans.schema).parquet(folder), "0 seconds")).select("repo_id", "scan_ts", "added", "fixed")


@_query(
    f"""WITH scans AS ({V.SCANS}), each AS (SELECT scan_id % 3 AS b, repo_id, scan_ts, max((score, critical, warning, info, scan_id)) AS x FROM scans GROUP BY 1, 2, 3),
    seen AS (SELECT *, x[1] IS DISTINCT FROM lag(x[1]) OVER w OR row_number() OVER w = 1 AS fresh FROM each WINDOW w AS (PARTITION BY repo_id, scan_ts ORDER BY b)),
    last AS (SELECT repo_id, scan_ts, max_by(x, b) AS x FROM seen WHERE fresh GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY scan_ts DESC) AS n FROM last) SELECT repo_id, scan_ts, x[1] AS score, x[5] AS scan_id FROM r WHERE n <= 50"""
)
def stored_history(spark: SparkSession, d: str) -> DataFrame:
    """All scans put into the store of points in three batches, with a compaction between, and read back: the last 50 of each repository."""
    scans = V.scans(spark, d).select("repo_id", "scan_ts", "score", "critical", "warning", "info", "scan_id")
    folder = f"{shared_folder(spark)}/points-{uuid.uuid4().hex}"
    for k in range(3):
        store.append_batch(scans.filter(F.col("scan_id") % 3 == k), folder, "000000-query", k)
        if k == 1:
            store.compact(spark, folder, scans.schema)
    return store.read_points(spark, folder, scans.schema).select("repo_id", "scan_ts", "score", "scan_id")
