"""A data source for folders of dumped commit logs, one file a repository: batch reads with pushed filters, and a stream by commit time."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from .git import COMMIT

FORMAT = "siltmark-git-log"
ENDING = ".log"
#: Bytes of a file that one task reads.
SPLIT = 64 << 20
ROWS = 10_000
_ROWS = pa.schema([("repo_id", pa.string()), ("sha", pa.string()), ("commit_ts", pa.timestamp("us", "UTC")), ("parents", pa.list_(pa.string())), ("subject", pa.string()), ("tagged", pa.bool_())])


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[tuple[str, str, int]]:
    """(repository, file, size) of the logs in a folder, by name."""
    from pyarrow import fs

    system, root = _system(path)
    found = [f for f in system.get_file_info(fs.FileSelector(root)) if f.is_file and f.base_name.endswith(ENDING)]
    return sorted((f.base_name.removesuffix(ENDING), f.path, f.size) for f in found)


def parse(line: str) -> tuple | None:
    """(sha, seconds, parents, subject, tagged) of a line: hash, seconds, parents, decorations and subject, split by U+001F; None for another shape."""
    p = line.split("\x1f")
    if len(p) < 5 or not re.fullmatch(r"[0-9a-f]{7,40}", p[0]) or not re.fullmatch(r"[0-9]{1,11}", p[1]):
        return None
    return p[0], int(p[1]), [x for x in p[2].split(" ") if x], "\x1f".join(p[4:]), "tag:" in p[3]


@dataclass
class Part(InputPartition):
    """The lines of a file that begin in a range of its bytes."""

    repo: str
    file: str
    start: int
    stop: int
    #: Microseconds from and up to which commits count.
    least: int = -(2**62)
    most: int = 2**62


@dataclass
class Wanted:
    """What pushed filters leave: repositories (None: all), and microseconds from and up to which commits count."""

    repos: set | None = None
    least: int = -(2**62)
    most: int = 2**62


def _micros(t: dt.datetime) -> int:
    t = t if t.tzinfo else t.astimezone(dt.UTC)
    return (t - dt.datetime(1970, 1, 1, tzinfo=dt.UTC)) // dt.timedelta(microseconds=1)


def _split(path: str, wanted: Wanted, split: int) -> list[Part]:
    return [Part(repo, file, a, min(a + split, size), wanted.least, wanted.most) for repo, file, size in _files(path) if wanted.repos is None or repo in wanted.repos for a in range(0, size, split)]


def _lines(path: str, part: Part) -> Iterator[str]:
    """Lines that begin in the part's bytes; the last one may end behind them."""
    system, _ = _system(path)
    with system.open_input_file(part.file) as raw:
        at = max(0, part.start - 1)
        raw.seek(at)
        rest, skip = b"", part.start > 0
        while at < part.stop or rest:
            block = raw.read(1 << 20)
            if not block:
                if rest and not skip and at - len(rest) < part.stop:
                    yield rest.decode(errors="replace")
                return
            rest += block
            at += len(block)
            *whole, rest = rest.split(b"\n")
            begin = at - len(rest) - sum(len(x) + 1 for x in whole)
            for x in whole:
                if skip:
                    skip = False  # the end of a line that began before
                elif begin >= part.stop:
                    return
                else:
                    yield x.decode(errors="replace").removesuffix("\r")
                begin += len(x) + 1
            if not skip and begin >= part.stop:
                return


def _batches(path: str, part: Part) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    for line in _lines(path, part):
        c = parse(line)
        if c is None or not part.least <= c[1] * 1_000_000 <= part.most:
            continue
        rows.append((part.repo, c[0], c[1] * 1_000_000, c[2], c[3], c[4]))
        if len(rows) >= ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _ROWS, strict=True)], schema=_ROWS)
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _ROWS, strict=True)], schema=_ROWS)


class _Reader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split, self.wanted = path, split, Wanted()

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Repositories and bounds on the commit time are taken; the rest stays with Spark."""
        w = self.wanted
        for f in filters:
            column = f.attribute if hasattr(f, "attribute") else None
            if isinstance(f, IsNotNull) and column in (("repo_id",), ("commit_ts",)):
                continue
            if column == ("repo_id",) and isinstance(f, EqualTo | In):
                given = {f.value} if isinstance(f, EqualTo) else set(f.value)
                w.repos = given if w.repos is None else w.repos & given
            elif column == ("commit_ts",) and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual) and isinstance(f.value, dt.datetime):
                t = _micros(f.value)
                if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                    w.least = max(w.least, t + isinstance(f, GreaterThan))
                if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                    w.most = min(w.most, t - isinstance(f, LessThan))
            else:
                yield f

    def partitions(self) -> list[Part]:
        return _split(self.path, self.wanted, self.split)

    def read(self, partition: Part | None) -> Iterator[pa.RecordBatch]:
        if partition is not None:  # there is no log to read
            yield from _batches(self.path, partition)


class _Stream(DataSourceStreamReader):
    """Offsets are commit times: a batch has the commits after the last offset up to the newest one that a log begins with."""

    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def initialOffset(self) -> dict:
        return {"seconds": -1}

    def latestOffset(self) -> dict:
        newest = -1
        for repo, file, size in _files(self.path):
            first = next((c for c in map(parse, _lines(self.path, Part(repo, file, 0, size))) if c is not None), None)
            newest = max(newest, first[1] if first else -1)
        return {"seconds": newest}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        wanted = Wanted(None, (start["seconds"] + 1) * 1_000_000, end["seconds"] * 1_000_000)
        return _split(self.path, wanted, self.split) if wanted.most >= wanted.least else []

    def read(self, partition: Part | None) -> Iterator[pa.RecordBatch]:
        if partition is not None:
            yield from _batches(self.path, partition)

    def commit(self, end: dict) -> None:
        pass


class GitLogSource(DataSource):
    """Commits of logs <repository>.log in the folder `path`, newest first, a line each as git.parse_commits reads them; lines of another shape are left out.

    A large file is read by several tasks, `split` bytes each. The stream gives commits as their time comes into reach of the newest line of any log; one that turns up later with a time that was passed already is
    seen by a batch read only.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return COMMIT

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("split", SPLIT)))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options["path"], int(self.options.get("split", SPLIT)))


def register(spark: SparkSession) -> str:
    """Make the format known to a session, with pushed filters; its name."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GitLogSource)
    return FORMAT
