"""Whole documents, one a repository: text parts in order, written piece by piece in as many tasks as there is text, joined by a data source that puts all documents in place at its commit or none."""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from . import sinks
from .functions import scoring as S
from .session import checkpointed

FORMAT = "siltmark-documents"
#: Findings a task writes, categories of repositories that are sent to all tasks, and bytes that are read or copied at once.
ROWS, FEW, BLOCK = 400_000, 10_000, 4 << 20
TOOL = "siltmark"
# The standard's schema and version, and levels of severities.
SARIF_SCHEMA, SARIF_VERSION = "https://json.schemastore.org/sarif-2.1.0.json", "2.1.0"
LEVELS = {"critical": "error", "warning": "warning", "info": "note"}
ABOUT = {
    "env": ("Environment variables", "Variables that code reads and no example names, or the reverse."), "dependency": ("Dependencies", "Packages that are old, left behind, unused or not locked."), "branch": ("Stale branches", "Branches on which nothing has happened for long."),
    "todo": ("Deferred work", "Notes of work to be done, and how old they are."), "security": ("Security", "Credentials in files or history, vulnerable packages and unsafe code."), "dead-code": ("Dead code", "Code that nothing refers to."), "hygiene": ("Repository hygiene", "Files, checks and texts that are missing, broken or in the way."),
}


@dataclass
class Parts:
    """Rows that become parts of documents: their document's name, what orders them in it, and their text, made only where a row is written, as is what `made` adds to a row. `between` comes between two `inner` rows that follow each other."""

    rows: DataFrame
    order: list[Column]
    text: Column
    inner: Column | None = None
    between: str = ""
    tasks: int | None = None
    made: Callable[[DataFrame], DataFrame] = lambda rows: rows


@dataclass
class Written(WriterCommitMessage):
    """What a task has written: its folder, and names of the documents in it."""

    folder: str
    names: list[str]


def _system(path: str):
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def _clean(path: str, job: str) -> None:
    from pyarrow import fs

    system, root = _system(path)
    if system.get_file_info(f"{root}/{job}").type != fs.FileType.NotFound:
        system.delete_dir(f"{root}/{job}")


def _packer():
    return zlib.compressobj(1, wbits=31)  # gzip, of which any number may follow one another


#: What a task has of a document: where its bytes lie, and whether its first and last row are inner ones.
PIECE = "name string, position long, file string, start long, bytes long, starts boolean, ends boolean"


def _pieces(path: str, job: str, between: int, packed: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Writes a task's rows (name, text, inner), in order, one after another into a file, and gives its pieces. Inner texts begin with what comes between, of so many bytes, which is left out where no inner row comes before."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _system(path)
        file, first = f"{root}/{job}/{uuid.uuid4().hex}", TaskContext.get().partitionId() << 32
        made, out, pack, at = [], None, None, 0

        def put(data) -> None:
            nonlocal at
            data = pack.compress(data) if packed else data
            out.write(data)
            at += len(data)

        def close() -> None:
            nonlocal at
            if packed:
                rest = pack.flush()
                out.write(rest)
                at += len(rest)
            made[-1]["bytes"] = at - made[-1]["start"]

        try:
            for b in batches:
                if not b.num_rows:
                    continue
                names, inner, texts = b.column("name"), b.column("inner").to_numpy(zero_copy_only=False), b.column("text").cast(pa.large_string())
                offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
                data = memoryview(texts.buffers()[2] or b"")
                changes = np.flatnonzero(pa.compute.not_equal(names[1:], names[:-1]).to_numpy(zero_copy_only=False)) + 1
                for a, z in pairwise([0, *changes.tolist(), len(names)]):
                    name, flags = names[a].as_py(), inner[a:z]
                    if not made or name != made[-1]["name"]:
                        if made:
                            close()
                        if not name or "/" in name or name in (".", ".."):
                            raise ValueError(f"not the name of a file: {name!r}")
                        if out is None:
                            system.create_dir(f"{root}/{job}")
                            out = system.open_output_stream(file, compression=None)
                        made.append({"name": name, "position": first + len(made), "file": file, "start": at, "bytes": 0, "starts": bool(flags[0]), "ends": False})
                        pack = _packer()
                    begin = offsets[a]
                    for k in np.flatnonzero(flags & ~np.concatenate(([made[-1]["ends"]], flags[:-1]))):
                        put(data[begin : offsets[a + k]])
                        begin = offsets[a + k] + between
                    put(data[begin : offsets[z]])
                    made[-1]["ends"] = bool(flags[-1])
            if made:
                close()
        finally:
            if out is not None:
                out.close()
        if made:
            yield pa.RecordBatch.from_pylist(made)

    return write


class _Writer(DataSourceWriter):
    """Documents from their pieces in order, each a file. A task writes into a folder of its own; the commit moves files into place, an abort removes them."""

    def __init__(self, path: str, between: str, packed: bool):
        self.path, self.job, self.ending = path, f"_job-{uuid.uuid4().hex}", ".gz" if packed else ""
        self.between = between.encode()
        if packed:
            pack = _packer()
            self.between = pack.compress(self.between) + pack.flush()

    def write(self, iterator: Iterator[Row]) -> Written:
        system, root = _system(self.path)
        folder = f"{root}/{self.job}/{uuid.uuid4().hex}"
        names, out, piece, file, inner = [], None, None, None, False
        try:
            for row in iterator:
                if not names or row.name != names[-1]:
                    if out is not None:
                        out.close()
                    if not names:
                        system.create_dir(folder)
                    names.append(row.name)
                    out, inner = system.open_output_stream(f"{folder}/{row.name}{self.ending}", compression=None), False
                if inner and row.starts:
                    out.write(self.between)
                if row.file != file:
                    if piece is not None:
                        piece.close()
                    piece, file = system.open_input_file(row.file), row.file
                piece.seek(row.start)
                left = row.bytes
                while left:
                    data = piece.read(min(left, BLOCK))
                    if not data:
                        raise OSError(f"{row.file} ends too early")
                    out.write(data)
                    left -= len(data)
                inner = row.ends
        finally:
            for x in (out, piece):
                if x is not None:
                    x.close()
        return Written(folder, names)

    def commit(self, messages: list) -> None:
        system, root = _system(self.path)
        where: dict[str, str] = {}
        for m in messages:
            for name in m.names:
                if where.setdefault(name, m.folder) != m.folder:
                    self.abort(messages)
                    raise ValueError(f"parts of {name} lay in two partitions")
        system.create_dir(root)
        for name, folder in where.items():
            system.move(f"{folder}/{name}{self.ending}", f"{root}/{name}{self.ending}")
        _clean(self.path, self.job)

    def abort(self, messages: list) -> None:
        _clean(self.path, self.job)


@dataclass
class _Files(InputPartition):
    """Documents that a task reads: (path, name)."""

    files: list[tuple[str, str]]


class _Reader(DataSourceReader):
    """Lines of the documents in a folder, or the first line of each."""

    def __init__(self, path: str, first: bool, tasks: int):
        self.path, self.first, self.tasks = path, first, tasks

    def partitions(self) -> list[_Files]:
        from pyarrow import fs

        system, root = _system(self.path)
        found = sorted((f for f in system.get_file_info(fs.FileSelector(root)) if f.type == fs.FileType.File and f.base_name[0] not in "_."), key=lambda f: f.base_name)
        most = min(32 << 20, sum(f.size for f in found) // (4 * self.tasks) + 1)
        out, size = [], most
        for f in found:
            if size >= most:
                out.append(_Files([]))
                size = 0
            out[-1].files.append((f.path, f.base_name.removesuffix(".gz")))
            size += f.size
        return out or [_Files([])]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        system, _ = _system(self.path)
        for path, name in partition.files:
            with system.open_input_stream(path, compression="gzip" if path.endswith(".gz") else None) as stream:
                at, rest = 0, []
                while True:
                    block = stream.read(BLOCK)
                    cut = block.rfind(b"\n")
                    if block and cut < 0:
                        rest.append(block)
                        continue
                    whole = b"".join((*rest, block[: cut + 1] if block else b""))
                    rest = [block[cut + 1 :]]
                    lines = whole.removesuffix(b"\n").split(b"\n") if whole else []
                    if self.first:
                        lines = lines[:1]
                    if lines:
                        yield pa.record_batch([pa.repeat(pa.scalar(name), len(lines)), pa.array(range(at, at + len(lines)), pa.int64()), pa.array(lines, pa.binary()).cast(pa.string())], ["name", "position", "text"])
                    at += len(lines)
                    if not block or (self.first and at):
                        break


class DocumentSource(DataSource):
    """Writes documents from their pieces, dealt by name and sorted by name and position, as files in the folder `path`; reads their lines."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "name string, position long, text string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], self.options["between"], self.options["packed"] == "true")

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self.options["first"] == "true", int(self.options["tasks"]))


def write_documents(parts: DataFrame | Parts, folder: str, packed: bool = False) -> None:
    """Write documents from parts (or rows name, position, text), of which null texts count as empty. Files of the same name are replaced; the others in the folder stay. All documents appear together, at the end.

    Rows are dealt once, in ranges of their order, and become text where they then lie; so a document of any length is written by many tasks, none of which holds it, and its pieces are joined as bytes.
    `packed` writes gzip, with .gz behind each name. `folder` is one that all machines share, or an address that pyarrow.fs knows.
    """
    if isinstance(parts, DataFrame):
        parts = Parts(parts, [F.col("position").cast("long")], F.col("text"))
    spark: SparkSession = parts.rows.sparkSession
    spark.dataSource.register(DocumentSource)
    order, inner, job = [F.col("name"), *parts.order], F.lit(False) if parts.inner is None else parts.inner, f"_job-{uuid.uuid4().hex}"
    dealt = parts.rows.repartitionByRange(*([parts.tasks] if parts.tasks else []), *order).sortWithinPartitions(*order)
    text = F.coalesce(parts.text, F.lit(""))
    rows = parts.made(dealt).select("name", (F.concat(F.when(inner, parts.between).otherwise(""), text) if parts.between else text).alias("text"), inner.alias("inner"))
    pieces = rows.mapInArrow(_pieces(folder, job, len(parts.between.encode()), packed), PIECE)
    try:
        joined = pieces.repartition(spark.sparkContext.defaultParallelism, "name").sortWithinPartitions("name", "position")
        joined.write.format(FORMAT).option("path", folder).option("between", parts.between).option("packed", str(packed).lower()).mode("append").save()
    finally:
        _clean(folder, job)


def read_lines(spark: SparkSession, folder: str, first: bool = False) -> DataFrame:
    """Lines (name, position from 0, text) of the documents in a folder, or only the first of each; packed ones are opened. A task reads a document block by block."""
    spark.dataSource.register(DocumentSource)
    return spark.read.format(FORMAT).option("path", folder).option("first", str(first).lower()).option("tasks", str(spark.sparkContext.defaultParallelism)).load()


def file_name(repo: Column, ending: str) -> Column:
    """A repository's file: what a file name cannot have becomes a line."""
    return F.concat(F.regexp_replace(repo.cast("string"), r"[^A-Za-z0-9._-]+", "-"), F.lit(f".{ending}"))


def _framed(scores: DataFrame, rows: DataFrame, order: list[Column], text: Column, head: Column, tail: str, ending: str, between: str = ",\n", **more) -> Parts:
    """Parts of documents: a head for every repository of `scores` (repo_id, ...), rows (repo_id, ...) in order with a separator between their texts, and a tail."""
    frame = lambda kind, what: scores.select(file_name(F.col("repo_id"), ending).alias("name"), F.lit(kind).alias("_kind"), what.alias("_frame"))
    body = rows.withColumns({"name": file_name(F.col("repo_id"), ending), "_kind": F.lit(1)}).drop("repo_id")
    every = frame(0, head).unionByName(body, True).unionByName(frame(2, F.lit(tail)), True)
    inner = F.col("_kind") == 1
    return Parts(every, [F.col("_kind"), *order], F.when(inner, text).otherwise(F.col("_frame")), inner, between, **more)


def _categories(findings: DataFrame, order: list[Column]) -> DataFrame:
    """(repo_id, rules, n): categories of each repository by their first finding in order, and its findings. Of few repositories, only findings with the rank and age of a category's first one are compared by all columns."""
    rank, ranks = order[0], range(len(S.SEVERITIES) + 1)
    held = findings.groupBy("repo_id", "category").agg(F.min(rank).alias("_rank"), F.array(*(F.max(F.when(rank == k, F.col("age_days"))) for k in ranks)).alias("_ages"), F.count("*").alias("_n"))
    held = checkpointed(held.select("repo_id", "category", "_rank", F.get("_ages", F.col("_rank")).alias("_age"), "_n"))
    near = findings
    if held.count() <= FEW:
        near = findings.join(F.broadcast(held.drop("_n")), ["repo_id", "category"]).filter((rank == F.col("_rank")) & F.col("age_days").eqNullSafe(F.col("_age")))
    first = near.groupBy("repo_id", "category").agg(F.min(F.struct(*(c.alias(f"o{k}") for k, c in enumerate(order)))).alias("p"))
    listed = first.groupBy("repo_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "category"))), lambda x: x["category"]).alias("rules"))
    return listed.join(held.groupBy("repo_id").agg(F.sum("_n").alias("n")), "repo_id")


#: What closes a SARIF document: its results, its run and its runs.
_CLOSE = "]}]}"


def sarif_documents(scores: DataFrame, findings: DataFrame, version: str = "0.0.0") -> Parts:
    """Parts of a SARIF document for every repository of `scores`: a rule for each category that it has, by its first finding in order, and a result for each finding, a line each."""
    order = sinks.order_of(findings)
    listed = _categories(findings, order)
    heads = checkpointed(scores.select("repo_id").distinct().join(listed, "repo_id", "left").select("repo_id", F.coalesce("rules", F.array().cast("array<string>")).alias("rules"), "n"))
    held, n = heads.agg(F.coalesce(F.sum(F.size("rules")), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    index = heads.select("repo_id", F.posexplode("rules").alias("rule_index", "category"))
    rows = findings.join(F.broadcast(index) if held <= FEW else index, ["repo_id", "category"])
    about = lambda k, c: F.create_map(*(F.lit(x) for name, texts in ABOUT.items() for x in (name, texts[k])))[c]
    text = lambda k, c: F.struct(F.coalesce(about(k, c), c).alias("text"))
    rule = lambda c: F.struct(c.alias("id"), F.regexp_replace(F.coalesce(about(0, c), c), r"\s+", "").alias("name"), text(0, c).alias("shortDescription"), text(1, c).alias("fullDescription"), F.struct(F.lit("warning").alias("level")).alias("defaultConfiguration"))
    tool = json.dumps({"name": TOOL, "version": version, "semanticVersion": version})[:-1]
    head = F.concat(F.lit(f'{{"$schema": "{SARIF_SCHEMA}", "version": "{SARIF_VERSION}", "runs": [{{"tool": {{"driver": {tool}, "rules": '), F.to_json(F.transform("rules", rule)), F.lit('}}, "results": [\n'))
    tasks = max(1, min(findings.sparkSession.sparkContext.defaultParallelism, n // 2_000), -(-n // ROWS))
    return _framed(heads, rows, order, sinks.sarif_result(F.col("rule_index")), head, f"\n{_CLOSE}\n", "sarif", tasks=tasks, made=sinks.placed)


def read_sarif(spark: SparkSession, folder: str, shape: str) -> tuple[DataFrame, DataFrame]:
    """What a folder of documents of `sarif_documents` holds: rules (name, rules) and results (name, nth, result in the shape asked for). Each line is read as JSON, up to the comma behind it; one that is not is an error."""
    strict = {"mode": "FAILFAST"}
    run = F.from_json(F.concat("text", F.lit(_CLOSE)), "struct<runs:array<struct<tool:struct<driver:struct<rules:array<struct<id:string>>>>>>>", strict)["runs"][0]
    lines = read_lines(spark, folder).filter((F.col("position") > 0) & ~F.col("text").isin(_CLOSE, ""))
    return read_lines(spark, folder, first=True).select("name", run["tool"]["driver"]["rules"]["id"].alias("rules")), lines.select("name", (F.col("position") - 1).alias("nth"), F.from_json("text", shape, strict).alias("result"))


def json_documents(scores: DataFrame, findings: DataFrame) -> Parts:
    """Parts of a JSON report for every repository of `scores` (repo_id, score, grade), its findings in order."""
    issue = F.to_json(F.struct("id", "category", "severity", "title", "location", F.col("age_days").alias("ageDays"), "detail", "evidence", "scanner"))
    head = F.concat(F.regexp_replace(F.to_json(F.struct(F.lit(1).alias("schemaVersion"), F.col("repo_id").cast("string").alias("repo"), "score", "grade")), r"\}$", ""), F.lit(',"issues":[\n'))
    return _framed(scores, findings, sinks.order_of(findings), issue, head, "\n]}\n", "json")


def markdown_documents(scores: DataFrame, findings: DataFrame) -> Parts:
    """Parts of a Markdown report for every repository of `scores`: its grade, then its findings by category."""
    rows = sinks.markdown_sections(findings)
    head = F.concat(F.lit("# "), F.col("repo_id").cast("string"), F.lit("\n\nGrade "), F.col("grade"), F.lit(", "), F.col("score").cast("string"), F.lit(" of 100\n\n"))
    return _framed(scores, rows, [F.col("position")], F.col("line"), head, "\n", "md", "\n")


def csv_documents(findings: DataFrame) -> DataFrame:
    """Parts of a CSV file for every repository with findings."""
    return sinks.csv_rows(findings).select(file_name(F.col("repo_id"), "csv").alias("name"), F.col("position").cast("long").alias("position"), F.col("line").alias("text"))


def summary(scores: DataFrame, failed: DataFrame | None = None) -> Parts:
    """Parts of summary.json: a line for each repository (repo_id, score, grade, findings) by name, and of `failed` (repo_id, error) those that could not be scanned."""
    ok = scores.select(F.col("repo_id").cast("string").alias("name"), F.col("score").cast("int").alias("score"), "grade", F.col("findings").cast("long").alias("issues"), F.lit(None).cast("string").alias("error"))
    if failed is not None:
        ok = ok.unionByName(failed.select(F.col("repo_id").cast("string").alias("name"), F.lit(None).cast("int").alias("score"), F.lit("-").alias("grade"), F.lit(0).cast("long").alias("issues"), F.col("error").cast("string").alias("error")))
    rows = ok.withColumn("position", F.row_number().over(Window.orderBy("name"))).select("position", F.to_json(F.struct("name", "score", "grade", "issues", "error"), {"ignoreNullFields": "false"}).alias("text"))
    one = rows.sparkSession.createDataFrame([("summary",)], "repo_id string")
    return _framed(one, rows.withColumn("repo_id", F.lit("summary")), [F.col("position")], F.col("text"), F.lit("[\n"), "\n]\n", "json")


def batch_average(scores: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """One row: repositories scanned and failed, and the average score of those scanned, rounded half up (null if none was)."""
    bad = failed.agg(F.count("*").alias("failed")) if failed is not None else scores.sparkSession.createDataFrame([(0,)], "failed long")
    good = scores.agg(F.count("*").alias("scanned"), F.floor(F.avg("score") + 0.5).cast("int").alias("average"))
    return good.join(bad, F.lit(True))


def ci_outputs(scores: DataFrame, fail_on: str = "") -> DataFrame:
    """(repo_id, lines, failed): what a job gives on, as lines of key=value, and whether a grade at or below `fail_on` fails it; any other word than a grade never does."""
    lines = F.concat(F.lit("score="), F.col("score").cast("string"), F.lit("\ngrade="), F.col("grade"), F.lit("\nissues="), F.col("findings").cast("string"), F.lit("\n"))
    bad = S.grade_rank(F.col("grade")) <= S.grade_rank(F.lit(fail_on.upper())) if fail_on.upper() in S.GRADES else F.lit(False)
    return scores.select("repo_id", lines.alias("lines"), bad.alias("failed"))


MARK = "<!-- siltmark-report -->"


def comments(scores: DataFrame, findings: DataFrame, story: DataFrame | None = None, top: int = 10, base_url: str = "") -> DataFrame:
    """(repo_id, body): the whole comment of every repository of `scores` (repo_id, score, grade, critical, warning, info, findings), of bounded length.

    With a mark to find it again, the grade, the change against the scan before (story: repo_id, score_delta, added, fixed, new_findings of timeline.regression_story), counts, a table of the worst
    findings and how many more there are.
    """
    cell = sinks._cell
    line = F.concat(F.lit("| "), F.col("severity"), F.lit(" | "), cell(F.col("title")), F.lit(" | `"), cell(F.col("location")), F.lit("` |"))
    rows = sinks.ordered(findings).filter(F.col("position") <= top).groupBy("repo_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", line.alias("l")))), lambda x: x["l"]), "\n").alias("rows"))
    out = scores.join(rows, "repo_id", "left")
    num = lambda c: F.col(c).cast("string")
    delta = news = F.lit("")
    if story is not None:
        out = out.join(story.select("repo_id", "score_delta", "added", "fixed", "new_findings"), "repo_id", "left")
        score = F.when(F.col("score_delta") > 0, F.concat(F.lit("score **+"), num("score_delta"), F.lit("**"))).when(F.col("score_delta") < 0, F.concat(F.lit("score **"), num("score_delta"), F.lit("**"))).otherwise("score as before")
        parts = F.concat_ws(" · ", score, F.when(F.col("added") > 0, F.concat(F.lit("**"), num("added"), F.lit("** new"))), F.when(F.col("fixed") > 0, F.concat(F.lit("**"), num("fixed"), F.lit("** fixed"))))
        same = (F.col("score_delta") == 0) & (F.col("added") == 0) & (F.col("fixed") == 0)
        delta = F.when(F.col("score_delta").isNull(), "").when(same, "Nothing has changed since the scan before.\n\n").otherwise(F.concat(parts, F.lit(" since the scan before.\n\n")))
        items = F.array_join(F.transform("new_findings", lambda x: F.concat(F.lit("- **"), x["severity"], F.lit("** "), cell(x["title"]))), "\n")
        news = F.when(F.size(F.coalesce("new_findings", F.array().cast(story.schema["new_findings"].dataType))) > 0, F.concat(F.lit("**New**\n\n"), items, F.lit("\n\n"))).otherwise("")
    head = F.concat(F.lit(f"{MARK}\n### Grade **"), F.col("grade"), F.lit("** ("), num("score"), F.lit(" of 100)\n\n"))
    counts = F.concat(F.lit("**"), num("findings"), F.when(F.col("findings") == 1, "** finding: ").otherwise("** findings: "), num("critical"), F.lit(" critical · "), num("warning"), F.lit(" warning · "), num("info"), F.lit(" info\n\n"))
    rest = F.when(F.col("findings") > top, F.concat(F.lit("\n\nand "), (F.col("findings") - top).cast("string"), F.lit(" more"))).otherwise("")
    table = F.when(F.col("findings") == 0, "No findings.").otherwise(F.concat(F.lit("| Severity | Finding | Location |\n| --- | --- | --- |\n"), F.coalesce("rows", F.lit("")), rest))
    link = F.concat(F.lit(f"\n\n[Report]({base_url.rstrip('/')}/"), F.col("repo_id").cast("string"), F.lit(")")) if base_url else F.lit("")
    return out.select("repo_id", F.concat(head, delta, news, counts, table, link).alias("body"))
