"""Nodes of YAML files: a table function that reads a file once, line by line, with a stack of indents."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, StructField, StructType

NODES = "keys array<string>, value string, kind string, line int, end_line int, source string"
_KEY = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s'"\[\]{},#&*!|>%@`-][^#]*?|-[^\s#][^#]*?)\s*:(?=\s|$)""")
_MARK = re.compile(r"(?:(&)([^\s,\]}]+)|![^\s,\]}]*)\s*")
_BLOCK = re.compile(r"[|>][+\-0-9]*$")
_NODE = pa.schema([("keys", pa.list_(pa.string())), ("value", pa.string()), ("kind", pa.string()), ("line", pa.int32()), ("end_line", pa.int32()), ("source", pa.string())])
#: How many nodes are sent on at once, more only where one file has more.
_SENT = 20_000


def bare(line: str) -> str:
    """A line without its comment: a # at its start or behind white space, outside of quotes."""
    if "#" not in line:
        return line.rstrip()
    quote = ""
    for k, c in enumerate(line):
        if quote:
            quote = "" if c == quote and not (quote == '"' and line[k - 1] == "\\") else quote
        elif c in "\"'" and (k == 0 or line[k - 1] in " \t[{,:-"):
            quote = c
        elif c == "#" and (k == 0 or line[k - 1] in " \t"):
            return line[:k].rstrip()
    return line.rstrip()


def scalar(text: str) -> str:
    """What a plain or quoted scalar says."""
    text = text.strip()
    if len(text) > 1 and text[0] == text[-1] == "'":
        return text[1:-1].replace("''", "'")
    if len(text) > 1 and text[0] == text[-1] == '"':
        return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), text[1:-1])
    return text


def _open(text: str) -> int:
    """How many brackets of a flow text are open, outside of quotes."""
    return sum((c in "[{") - (c in "]}") for c in re.sub(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^']|'')*'", "", text))


class _Reader:
    """Nodes as [keys, value, kind, line, end_line, source]; anchors keep the nodes of what they name, relative to it."""

    def __init__(self, text: str):
        self.lines = text.splitlines()
        self.nodes: list[list] = []
        self.anchors: dict[str, list[list]] = {}
        self.named: list[tuple[str, int]] = []  # anchors of containers that are still being read, with their first node

    def put(self, keys: list[str], value: str | None, kind: str, line: int, end: int | None = None) -> None:
        self.nodes.append([keys, value, kind, line + 1, (line if end is None else end) + 1, bare(self.lines[line]).strip()])

    def value(self, keys: list[str], rest: str, line: int) -> bool:
        """Add the node of a value that begins on a line; whether it is an empty one, whose children follow."""
        rest = rest.strip()
        first, anchor = len(self.nodes), None
        while m := _MARK.match(rest):
            anchor, rest = m[2] or anchor, rest[m.end() :]
        if not rest:
            if anchor:
                self.named.append((anchor, first))
            self.put(keys, None, "map", line)
            return True
        if rest[0] == "*":
            self.alias(keys, rest[1:].strip(), line)
        elif rest[0] in "[{":
            self.put(keys, None, "seq" if rest[0] == "[" else "map", line)
            try:
                self.flow(keys, rest, 0, line)
            except RecursionError:  # hundreds of brackets in one another: what was read so far stays
                pass
        else:
            self.put(keys, scalar(rest), "value", line)
        if anchor:
            self.keep(anchor, first)
        return False

    def keep(self, anchor: str, first: int) -> None:
        """Remember what an anchor names: the node at `first` and those below it."""
        depth = len(self.nodes[first][0])
        below = [n for n in self.nodes[first:] if n[0][:depth] == self.nodes[first][0]]
        self.anchors[anchor] = [[n[0][depth:], *n[1:]] for n in below]

    def alias(self, keys: list[str], name: str, line: int) -> None:
        """The nodes of an anchor in the place of its alias; those of a merge key go into the map that has it."""
        self.closed(keys)
        merged = keys and keys[-1] == "<<"
        base = keys[:-1] if merged else keys
        for rel, value, kind, *_ in self.anchors.get(name, [] if merged else [[[], None, "value"]]):
            if rel or not merged:
                self.put(base + rel, value, kind, line)

    def closed(self, keys: list[str] | None) -> None:
        """End the anchors of containers that a node with these keys is not below."""
        while self.named and (keys is None or keys[: len(k := self.nodes[self.named[-1][1]][0])] != k or keys == k):
            self.keep(*self.named.pop())

    def flow(self, keys: list[str], text: str, at: int, line: int) -> int:
        """Nodes of a flow list or map that begins at a place of a text; the place behind it."""
        is_map, k, at = text[at] == "{", 0, at + 1
        while at < len(text):
            c = text[at]
            if c in "]}":
                return at + 1
            if c in ", \t":
                at += 1
                continue
            m = re.compile(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^']|'')*'|[^,\]}\[{:]+(?::(?=\S)[^,\]}\[{:]+)*").match(text, at) if c not in "[{" else None
            token, at = (m[0], m.end()) if m else ("", at)
            if is_map:
                own = [*keys, scalar(token)]
                at = re.compile(r"\s*:?\s*").match(text, at).end()
                if at < len(text) and text[at] in "[{":
                    self.put(own, None, "seq" if text[at] == "[" else "map", line)
                    at = self.flow(own, text, at, line)
                else:
                    m = re.compile(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^']|'')*'|[^,}\]]*").match(text, at)
                    self.value(own, m[0], line)
                    at = m.end()
            else:
                own = [*keys, str(k)]
                if m:
                    self.value(own, token, line)
                elif c in "[{":
                    self.put(own, None, "seq" if c == "[" else "map", line)
                    at = self.flow(own, text, at, line)
                else:
                    at += 1
                    continue
                k += 1
        return at

    def read(self) -> list[list]:
        stack: list[list] = []  # [column, whether a sequence, keys above, number of items, keys of the last child]
        i = 0
        while i < len(self.lines):
            line = bare(self.lines[i])
            text = line.strip()
            if not text or text in ("---", "...") or text.startswith("%"):
                if text == "---":
                    stack = []
                i += 1
                continue
            col, here = len(line) - len(line.lstrip(" ")), i
            while True:  # dashes, then a key or a value
                dash = text == "-" or text.startswith("- ")
                while stack and (stack[-1][0] > col or (stack[-1][0] == col and stack[-1][1] and not dash)):
                    stack.pop()
                above = stack[-1][4] if stack else []
                if dash:
                    if not (stack and stack[-1][0] == col and stack[-1][1]):
                        stack.append([col, True, above, 0, above])
                    top = stack[-1]
                    top[4] = [*top[2], str(top[3])]
                    top[3] += 1
                    rest = text[1:].lstrip()
                    self.closed(top[4])
                    if not rest:
                        self.put(top[4], None, "map", here)
                        break
                    col, text = col + len(text) - len(rest), rest
                    if rest == "-" or rest.startswith("- ") or _KEY.match(rest):
                        self.put(top[4], None, "map", here)
                        continue
                    keys, rest = top[4], text
                elif m := _KEY.match(text):
                    if not (stack and stack[-1][0] == col):
                        stack.append([col, False, above, 0, above])
                    top = stack[-1]
                    keys = top[4] = [*top[2], scalar(m[1])]
                    rest = text[m.end() :].strip()
                    self.closed(keys)
                else:  # goes on from the line before
                    if self.nodes and self.nodes[-1][2] == "value":
                        self.nodes[-1][1] += " " + scalar(text)
                        self.nodes[-1][4] = here + 1
                    break
                mark = _MARK.sub("", rest) if rest[:1] in "&!" else rest
                if _BLOCK.match(mark):
                    i = self.block(keys, col if not dash else stack[-1][0], here)
                else:
                    parts, left = [rest], _open(mark) if mark[:1] in ("[", "{") else 0
                    while left > 0 and i + 1 < len(self.lines):
                        i += 1
                        parts.append(bare(self.lines[i]).strip())
                        left += _open(parts[-1])
                    first = len(self.nodes)
                    self.value(keys, " ".join(parts), here)
                    if i > here and first < len(self.nodes):
                        self.nodes[first][4] = i + 1
                break
            i += 1
        self.closed(None)
        self.spans()
        return self.nodes

    def block(self, keys: list[str], col: int, line: int) -> int:
        """A literal or folded text: the lines that are further in, without their common indent; the last of its lines."""
        last = line
        while last + 1 < len(self.lines) and (not self.lines[last + 1].strip() or len(self.lines[last + 1]) - len(self.lines[last + 1].lstrip(" ")) > col):
            last += 1
        while last > line and not self.lines[last].strip():
            last -= 1
        own = self.lines[line + 1 : last + 1]
        margin = min((len(x) - len(x.lstrip(" ")) for x in own if x.strip()), default=0)
        self.put(keys, "\n".join(x[margin:] for x in own), "block", line, last)
        return last

    def spans(self) -> None:
        """A container ends where the last node below it does."""
        last: list[int] = []  # the latest node of each depth
        above = []
        for k, (keys, *_) in enumerate(self.nodes):
            above.append(last[len(keys) - 2] if 2 <= len(keys) <= len(last) + 1 else None)
            del last[len(keys) - 1 :]
            last += [k] * (len(keys) - len(last))
        for k in reversed(range(len(self.nodes))):
            if above[k] is not None:
                self.nodes[above[k]][4] = max(self.nodes[above[k]][4], self.nodes[k][4])


def nodes(text: str | None) -> list[list]:
    """[keys, value, kind, line, end_line, source] of a YAML text, in order."""
    return _Reader(text).read() if text else []


@udtf(returnType=NODES)
class _Nodes:
    def eval(self, content: str) -> Iterator[tuple]:
        yield from (tuple(n) for n in nodes(content))


def yaml_nodes(files: DataFrame, content: str = "content") -> DataFrame:
    """Rows of files without their content, one for each node: keys (the path; items of a list are numbered from 0), value (null for maps and lists), kind (map, seq, value or block), the lines on
    which it begins and ends, and its first line without its comment.

    Quotes, flow lists and maps (also over lines), block texts, anchors, aliases and merge keys are read. A null or empty text has no node; a line that is none of these is taken to go on from the
    one before or is left out. A file is read in one task, once.
    """
    rest = [c for c in files.columns if c != content]
    return files.filter(F.length(content) > 0).lateralJoin(_Nodes(F.col(content).outer())).select(*rest, *(f.split()[0] for f in NODES.split(", ")))


def yaml_files(files: DataFrame, content: str = "content") -> DataFrame:
    """Rows of files without their content and with all their nodes, in order, as one array of NODES: for many small files, of which each is looked at as a whole. Files are read as yaml_nodes reads them."""
    rest = [c for c in files.columns if c != content]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent(batch: pa.RecordBatch, first: int, each: list[list[list]]) -> pa.RecordBatch:
            ends = [0]
            for found in each:
                ends.append(ends[-1] + len(found))
            columns = list(zip(*(n for found in each for n in found), strict=True)) or [()] * len(_NODE)
            flat = pa.StructArray.from_arrays([pa.array(v, f.type) for v, f in zip(columns, _NODE, strict=True)], fields=list(_NODE))
            array = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
            return pa.RecordBatch.from_arrays([*(batch.column(c).slice(first, len(each)) for c in rest), array], names=[*rest, "nodes"])

        for batch in batches:
            first, each, held = 0, [], 0
            for text in batch.column(content):
                each.append(nodes(text.as_py()))
                held += len(each[-1])
                if held >= _SENT:
                    yield sent(batch, first, each)
                    first, each, held = first + len(each), [], 0
            if each:
                yield sent(batch, first, each)

    given = files.filter(F.length(content) > 0)
    shape = StructType([*(given.schema[c] for c in rest), StructField("nodes", ArrayType(StructType.fromDDL(NODES)))])
    return given.mapInArrow(run, shape)
