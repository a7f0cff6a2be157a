"""Structured Streaming counterparts of the usage and alert operators; rate limits are in `ordered`, the store of points in `store`."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import scoring as S


def daily_usage(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events per day and kind from a stream, with what comes later than `late` left out."""
    return events.withWatermark("event_ts", late).groupBy(F.window("event_ts", "1 day"), "event").agg(F.count("*").alias("events"), F.sum(F.coalesce("amount", F.lit(1))).alias("amount")).select(F.to_date("window.start").alias("day"), "event", "events", "amount")


def daily_visitors(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Distinct known visitors per day: repeats are dropped within the watermark, so the count is exact for what is not late."""
    known = events.filter(F.col("visitor") != "anonymous").withColumn("day", F.date_trunc("day", "event_ts")).withWatermark("day", late)
    return known.dropDuplicates(["day", "visitor"]).groupBy("day").agg(F.count("*").alias("visitors"))


def hourly_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each visitor: events no further apart than the gap."""
    return events.withWatermark("event_ts", late).groupBy(F.session_window("event_ts", gap), "visitor").agg(F.count("*").alias("events")).select("visitor", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events")


def sliding_counts(events: DataFrame, size: str = "1 hour", step: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("event_ts", late).groupBy(F.window("event_ts", size, step), "event").agg(F.count("*").alias("events")).select(F.col("window.start").alias("start"), "event", "events")


def drop_alerts(scans: DataFrame, least: int = 3) -> DataFrame:
    """Alerts from a stream of scans (repo_id, scan_ts, score): worse than the repository's last scan by grade, or by so many points. State is one score for each repository."""

    def alert(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rank = lambda score: sum(score >= floor for floor in S.GRADE_FLOORS.values())
        out = []
        for at, score in pd.concat(list(frames)).sort_values("scan_ts")[["scan_ts", "score"]].itertuples(index=False):
            if last is not None and (rank(score) < rank(last) or last - score >= least):
                out.append((key[0], at, int(last), int(score), "grade" if rank(score) < rank(last) else "score"))
            last = score
        state.update((int(last),))
        yield pd.DataFrame(out, columns=["repo_id", "scan_ts", "previous_score", "score", "reason"])

    return scans.groupBy("repo_id").applyInPandasWithState(alert, "repo_id string, scan_ts timestamp, previous_score int, score int, reason string", "score int", "append", GroupStateTimeout.NoTimeout)
