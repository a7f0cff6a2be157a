"""Stateful streams that decide a key's rows in the order of their event times, whatever batches they come in."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: The state store that state of this kind needs.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class InOrder(StatefulProcessor):
    """Rows wait until the watermark has passed their time (`at`, microseconds), as then no earlier one can follow; timers of event time wake the key.

    A subclass gives the schemas and decides one row after another, with what it remembers of the key.
    """

    waiting = "at long, tie long"
    memory = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", self.waiting)
        self.known = handle.getValueState("known", self.memory)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        fields = [f.split()[0] for f in self.waiting.split(", ")]
        new = [tuple(r[f] for f in fields) for r in rows]
        if new:
            self.rows.appendList(new)
            self._wake(min(r[0] for r in new))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted(self.rows.get(), key=lambda r: r[:2]) if self.rows.exists() else []
        ready = [r for r in held if r[0] <= passed]
        rest = held[len(ready) :]
        known = self.known.get() if self.known.exists() else None
        for r in ready:
            known, out = self.decide(key, tuple(r), known)
            if out is not None:
                yield out
        if rest:
            self.rows.put([tuple(r) for r in rest])
            self._wake(rest[0][0])
        elif held:
            self.rows.clear()
        end = None if known is None else self.forget_at(known)
        if known is not None and end is not None and not rest and end <= passed:
            self.known.clear()
        elif known is not None and ready:
            self.known.update(known)
            if end is not None:
                self._wake(end)

    def _wake(self, at: int) -> None:
        """Be called once the watermark has reached a time: a timer goes off when the watermark is past it, in whole milliseconds."""
        self.handle.registerTimer(-(-at // 1000) - 1)

    def decide(self, key: tuple, row: tuple, known: tuple | None) -> tuple[tuple, Row | None]:
        raise NotImplementedError

    def forget_at(self, known: tuple) -> int | None:
        """The time from which the memory plays no part any more; None to keep it."""
        return None

    def close(self) -> None:
        pass


class SlidingLimit(InOrder):
    """Allowed while fewer than `most` allowed ones lie in the last `width` microseconds; remembers those times."""

    memory = "times array<long>"

    def __init__(self, most: int, width: int):
        self.most, self.width = most, width

    def decide(self, key, row, known):
        at, event = row
        times = [t for t in (known[0] if known else []) if t > at - self.width]
        ok = len(times) < self.most
        retry = 0 if ok else max(1, -(-(times[0] + self.width - at) // 1_000_000)) if times else self.width // 1_000_000
        if ok:
            times.append(at)
        return (times,), Row(client=key[0], event_id=event, allowed=ok, retry_after=int(retry), remaining=self.most - len(times))

    def forget_at(self, known):
        return known[0][-1] + self.width if known[0] else 0


class FixedLimit(InOrder):
    """Allowed while fewer than `most` lie in the window that opened at a first hit; remembers its start and count."""

    memory = "opened long, n long"

    def __init__(self, most: int, width: int):
        self.most, self.width = max(1, most), width

    def decide(self, key, row, known):
        at, event = row
        opened, n = known if known and at < known[0] + self.width else (at, 0)
        ok = n < self.most
        return (opened, n + ok), Row(client=key[0], event_id=event, opened_us=opened, allowed=ok)

    def forget_at(self, known):
        return known[0] + self.width


class ScanChanges(InOrder):
    """What each scan of a repository adds and fixes against the one before it in time; remembers the ids of the last one."""

    waiting = "at long, tie long, ids array<string>"
    memory = "ids array<string>"

    def decide(self, key, row, known):
        at, scan, ids = row
        new, old = set(ids or []), set(known[0]) if known else set()
        out = Row(repo_id=key[0], scan_us=at, scan_id=scan, added=len(new - old), fixed=len(old - new), new_ids=sorted(new - old), fixed_ids=sorted(old - new))
        return (sorted(new),), out if known else None


def _by(rows: DataFrame, key: str, at: str, tie: str, late: str, processor: InOrder, schema: str, *more: str) -> DataFrame:
    known = rows.filter(F.col(key).isNotNull() & F.col(at).isNotNull())
    timed = known.select(F.col(key).cast("string").alias("key"), F.col(at).alias("event_ts"), F.unix_micros(F.col(at)).alias("at"), F.col(tie).cast("long").alias("tie"), *more).withWatermark("event_ts", late)
    return timed.groupBy("key").transformWithState(processor, schema, "Append", "EventTime")


def rate_limit(events: DataFrame, most: int = 30, seconds: int = 3600, late: str = "1 minute") -> DataFrame:
    """Decide each request (client, event_ts, event_id) of a stream: allowed while fewer than `most` allowed ones lie in the last `seconds`.

    Requests are decided in the order of time and id once the watermark, `late` behind the newest, has passed them, so a replay or another split into batches decides the same. What comes
    later than that is left out, as is a request without client or time. State is at most `most` times a client and what waits; it goes once it plays no part.
    """
    return _by(events, "client", "event_ts", "event_id", late, SlidingLimit(most, seconds * 1_000_000), "client string, event_id long, allowed boolean, retry_after int, remaining int")


def fixed_windows(events: DataFrame, most: int = 30, seconds: int = 3600, late: str = "1 minute") -> DataFrame:
    """The stream of operators.limits.fixed_windows, on the same terms as rate_limit: (client as text, event_id, opened_at, reset_at, allowed)."""
    out = _by(events, "client", "event_ts", "event_id", late, FixedLimit(most, seconds * 1_000_000), "client string, event_id long, opened_us long, allowed boolean")
    return out.select("client", "event_id", F.timestamp_micros("opened_us").alias("opened_at"), F.timestamp_micros(F.col("opened_us") + seconds * 1_000_000).alias("reset_at"), "allowed")


def scan_changes(scans: DataFrame, late: str = "1 day") -> DataFrame:
    """Changes of each scan (repo_id, scan_ts, scan_id, ids: its findings) against the repository's scan before it in time: added, fixed, new_ids, fixed_ids.

    A repository's first scan gives none. State is the ids of its last scan and the scans that wait for the watermark.
    """
    out = _by(scans, "repo_id", "scan_ts", "scan_id", late, ScanChanges(), "repo_id string, scan_us long, scan_id long, added long, fixed long, new_ids array<string>, fixed_ids array<string>", "ids")
    return out.withColumn("scan_ts", F.timestamp_micros("scan_us")).drop("scan_us")
