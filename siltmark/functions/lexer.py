"""Tokens of JavaScript and TypeScript, once per file, as an Arrow function."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"[A-Za-z_$][\w$]*|\d[\w.]*|\s+|.", re.S)
_VALUE = re.compile(r"[\w$)\]}]$")
_KEYWORDS = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "instanceof", "await", "yield"}
_PARTS = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*(?:\"|$)|'(?:\\.|[^'\\\n])*(?:'|$)|`(?:\\.|[^`\\])*(?:`|\Z)", re.S | re.M)
_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[A-Za-z]*")


#: Bytes beyond which a file is taken for output.
MOST_BYTES = 512 * 1024


def looks_generated(path: str, content: str, most_bytes: int | None = MOST_BYTES) -> bool:
    """Bundled or minified output, which is not worth reading: by its name, its size (None: any) or its long lines."""
    return bool(re.search(r"\.min\.|\.bundle\.", path)) or (most_bytes is not None and len(content.encode()) > most_bytes) or len(content) / (content.count("\n") + 1) > 200


def split_code(code: str) -> list[tuple[str, str, int]]:
    """(kind, text, line): comment, string, template, regex, name, number or sign. A slash is a pattern where no value stands before it."""
    out, i, line, before = [], 0, 1, ""
    while i < len(code):
        c = code[i]
        m = _PARTS.match(code, i) if c in "/\"'`" else None
        kind = {"/": "comment", '"': "string", "'": "string", "`": "template"}[c] if m else ""
        if m is None and c == "/" and (not _VALUE.search(before) or before in _KEYWORDS):
            m = _REGEX.match(code, i)
            kind = "regex"
        if m is None:
            m = _WORD.match(code, i)
            kind = "space" if m[0].isspace() else "name" if c.isalpha() or c in "_$" else "number" if c.isdigit() else "sign"
        if kind != "space":
            out.append((kind, m[0], line))
        if kind not in ("space", "comment"):
            before = m[0] if kind in ("name", "sign", "number") else "x"
        line += m[0].count("\n")
        i = m.end()
    return out


def with_calls(tokens: list[tuple[str, str, int]]) -> list[tuple[str, str, int]]:
    """The tokens, and a `call` for each called name, dotted or not, and each debugger statement."""
    out = list(tokens)
    real = [t for t in tokens if t[0] != "comment"]
    for k, (kind, text, line) in enumerate(real):
        if kind != "name" or (k and real[k - 1][1] in (".", "?.")):
            continue
        if text == "debugger":
            out.append(("call", text, line))
        elif k + 1 < len(real) and real[k + 1][1] == "(":
            out.append(("call", text, line))
        elif k + 3 < len(real) and real[k + 1][1] == "." and real[k + 2][0] == "name" and real[k + 3][1] == "(":
            out.append(("call", f"{text}.{real[k + 2][1]}", line))
    return out


#: How many tokens are sent on at once, more only where one file has more.
_SENT = 50_000
_TOKEN = pa.schema([("kind", pa.string()), ("text", pa.string()), ("line", pa.int32())])


def token_files(files: DataFrame, most_bytes: int | None = MOST_BYTES) -> DataFrame:
    """(repo_id, path, file_ord, tokens) of files: an array of (kind, text, line), in order, calls at the end; generated files have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent(batch: pa.RecordBatch, first: int, each: list[list[tuple]]) -> pa.RecordBatch:
            ends = [0]
            for found in each:
                ends.append(ends[-1] + len(found))
            columns = list(zip(*(t for found in each for t in found), strict=True)) or [()] * len(_TOKEN)
            flat = pa.StructArray.from_arrays([pa.array(v, f.type) for v, f in zip(columns, _TOKEN, strict=True)], fields=list(_TOKEN))
            array = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
            return pa.RecordBatch.from_arrays([*(batch.column(c).slice(first, len(each)) for c in range(3)), array], names=["repo_id", "path", "file_ord", "tokens"])

        for batch in batches:
            first, each, held = 0, [], 0
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                code = content.as_py()
                each.append(with_calls(split_code(code)) if code and not looks_generated(path.as_py(), code, most_bytes) else [])
                held += len(each[-1])
                if held >= _SENT:
                    yield sent(batch, first, each)
                    first, each, held = first + len(each), [], 0
            if each:
                yield sent(batch, first, each)

    given = files.select(F.col("repo_id").cast("string").alias("repo_id"), "path", F.col("file_ord").cast("long").alias("file_ord"), "content")
    return given.mapInArrow(run, "repo_id string, path string, file_ord long, tokens array<struct<kind:string,text:string,line:int>>")
