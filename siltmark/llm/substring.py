"""Removal of repeated passages, found by anchors at the positions of a difference cover."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks_of, places, text_bytes, total, windows_hash, words_of
from .exchange import BLOCKS, FEWEST, answered, blocks, chunked, distinct_with_owners, grouped, held_elsewhere, replies

#: Difference covers: for any two positions there is a shift below the period that brings both into the cover.
COVERS = {1: (0,), 2: (0, 1), 3: (0, 1), 7: (1, 2, 4), 13: (0, 1, 3, 9)}
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])


def cover_for(window: int) -> tuple[int, tuple[int, ...]]:
    """The period that samples least while anchors keep at least half a window: a match of `window` words holds an aligned anchor of window - period + 1."""
    fit = [p for p in COVERS if 2 * p <= window + 1]
    p = min(fit, key=lambda p: len(COVERS[p]) / p)
    return p, COVERS[p]


#: What goes with a window's first hash: its second one, and the smallest id that holds it here.
_WINDOW = np.dtype([("two", "<u8"), ("id", "<i8")])
_NONE = np.iinfo(np.int64).max


class Chunk:
    """The words of a chunk's texts, its anchors, and the windows that hold a shared one."""

    def __init__(self, t: pa.Table, window: int):
        self.table = t
        # a document without an id comes after all others
        self.ids = t.column("doc_id").fill_null(_NONE).to_numpy()
        self.data, self.offsets = text_bytes(t.column("text"))
        self.start, self.end, self.word, self.first = words_of(self.data, self.offsets, lower=False)
        self.window = window
        self.period, self.cover = cover_for(window)
        self.span = window - self.period + 1
        kind = places(len(self.word))
        n = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(n), dtype=kind), n)
        # words from here to the text's end
        self.left = (self.first[1:].astype(kind))[self.doc] - np.arange(len(self.word), dtype=kind)
        nth = np.arange(len(self.word), dtype=kind) - self.first.astype(kind)[self.doc]
        nth %= self.period
        at = np.isin(nth, self.cover) & (self.left >= self.span) & (n[self.doc] >= window)
        self.anchor = np.flatnonzero(at).astype(kind)
        self.hashes, self.index, self.local = distinct_with_owners(windows_hash(self.word, self.anchor, self.span, 1), self.ids[self.doc[self.anchor]])
        self.index = self.index.astype(kind)

    def windows(self, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word of each window that holds a shared anchor, its hash, a second hash): the anchors extended to whole windows."""
        sums = np.zeros(len(self.word) + self.period + 1, self.anchor.dtype)
        sums[1:][self.anchor] = (shared | self.local)[self.index]
        np.cumsum(sums, out=sums)
        n = len(self.word)
        at = np.flatnonzero((sums[self.period : n + self.period] > sums[:n]) & (self.left >= self.window)).astype(self.anchor.dtype)
        return at, windows_hash(self.word, at, self.window, 2), windows_hash(self.word, at, self.window, 3)


def _owners(one: np.ndarray, two: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct windows by both hashes: (first hash, what goes with it, index of each entry)."""
    lead, index = grouped(one, two)
    extra = np.empty(len(lead), _WINDOW)
    extra["two"] = two[lead]
    extra["id"] = _NONE
    low = extra["id"].copy()
    np.minimum.at(low, index, ids)
    extra["id"] = low
    return one[lead], extra, index


def _smallest(group: np.ndarray, extra: np.ndarray) -> np.ndarray:
    """Whether an entry's document is the first of all that hold the window."""
    low = np.full(group.max(initial=-1) + 1, _NONE)
    np.minimum.at(low, group, extra["id"])
    return extra["id"] == low[group]


def _marked(t: pa.Table, answers: pa.Table, window: int, buckets: int):
    c = Chunk(t, window)
    at, one, two = c.windows(replies(answers, 1, c.hashes, buckets))
    return c, at, *_owners(one, two, c.ids[c.doc[at]])


def find_repeats(docs: DataFrame, finish, schema, window: int = 13, chunk_bytes: int = 4 << 20, hashes_a_bucket: int = 1 << 18, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Run finish(chunk, removed: bool for each of its words) on each chunk of documents."""
    size = total(docs, F.octet_length(text_col))
    chunks = max(FEWEST, -(-size // chunk_bytes))
    buckets = max(FEWEST, -(-size // (14 * hashes_a_bucket)))  # an anchor every 14 bytes, or so
    columns = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *(F.col(c).alias(f"_{c}") for c in keep or [])]
    dealt = chunked(docs.select(*columns), chunks, "doc_id", "text")

    def ask(t: pa.Table) -> pa.Table:
        return blocks(t.column("chunk")[0].as_py(), Chunk(t, window).hashes, buckets)

    def ask_windows(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return blocks(0, np.zeros(0, np.uint64), buckets)
        _, _, one, extra, _ = _marked(left, right, window, buckets)
        return blocks(left.column("chunk")[0].as_py(), one, buckets, extra)

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return finish(None, None)
        c, at, one, extra, index = _marked(left, right, window, buckets)
        first = replies(right, 2, one, buckets)[index] & (c.ids[c.doc[at]] == extra["id"][index])
        edge = np.zeros(len(c.word) + 1, np.int32)
        gone = at[~first]  # distinct places, so each counts once
        edge[gone] += 1
        edge[np.minimum(gone + window, len(c.word))] -= 1
        np.cumsum(edge, out=edge)
        return finish(c, edge[:-1] > 0)

    shared = answered(dealt.groupBy("chunk").applyInArrow(ask, BLOCKS), 1, held_elsewhere)
    windows = answered(dealt.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(ask_windows, BLOCKS), 2, _smallest, _WINDOW, "two")
    return dealt.groupBy("chunk").cogroup(shared.unionByName(windows).groupBy("chunk")).applyInArrow(remove, schema)


def kept_texts(c: Chunk, removed: np.ndarray, block: int = 1 << 18) -> Iterator[tuple[int, int, bytes]]:
    """(text, words that went, the kept words joined by a space) of each text, a block of texts at a time."""
    for lo, hi in blocks_of(c.offsets, block):
        a, b = int(c.first[lo]), int(c.first[hi])
        keep = np.flatnonzero(~removed[a:b]) + a
        size = (c.end[keep] - c.start[keep]).astype(np.int64) + 1  # with a space behind
        stop = np.cumsum(size)
        from_ = np.arange(int(size.sum()))
        from_ += np.repeat(c.start[keep] - (stop - size), size)
        joined = c.data[np.minimum(from_, max(len(c.data) - 1, 0))] if len(c.data) else np.zeros(0, np.uint8)
        joined[stop - 1] = 32
        raw = joined.tobytes()
        ends = np.concatenate([[0], stop])[np.searchsorted(keep, c.first[lo : hi + 1])].tolist()
        gone = (np.diff(c.first[lo : hi + 1]) - np.diff(np.searchsorted(keep, c.first[lo : hi + 1]))).tolist()
        for k in range(hi - lo):
            yield lo + k, gone[k], raw[ends[k] : max(ends[k], ends[k + 1] - 1)]


def digests(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed and the SHA-256 of the kept words joined by one space.

    A word goes if a window of `window` words that covers it also starts in a document with a smaller id. Anchors (spans of
    window - period + 1 words at cover positions) are shared before windows are compared, so texts without a repeated anchor
    send nothing more; windows are compared by two 64-bit hashes. A null text is an empty one; a row without an id counts as coming after all others,
    so it loses what any document with an id holds and takes nothing from others; rows with one id take nothing from each other and are each returned;
    an empty table gives no rows; other columns are dropped.
    """

    def finish(c: Chunk | None, removed) -> pa.Table:
        if c is None:
            return _RESULT.empty_table()
        rows = [(n, hashlib.sha256(x).hexdigest()) for _, n, x in kept_texts(c, removed)]
        return pa.table([c.table.column("doc_id"), pa.array(np.diff(c.first)), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], schema=_RESULT)

    return find_repeats(docs, finish, RESULT, **options)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents with repeated words removed, in the input's columns.

    A text from which nothing goes stays as it is, white space too; one that loses all its words becomes empty. See digests().
    """
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    schema = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *(F.col(c).alias(f"_{c}") for c in rest)).schema

    def finish(c: Chunk | None, removed) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema

        own = to_arrow_schema(schema)
        if c is None:
            return own.empty_table()
        changed = [(k, x.decode()) for k, n, x in kept_texts(c, removed) if n]
        mask = np.zeros(len(c.ids), bool)
        mask[[k for k, _ in changed]] = True
        old = c.table.column("text").combine_chunks()
        new = pc.replace_with_mask(old, pa.array(mask), pa.array([x for _, x in changed], old.type)) if changed else old
        return pa.table([new if f.name == "text" else c.table.column(f.name) for f in own], schema=own)

    out = find_repeats(docs, finish, schema, id_col=id_col, text_col=text_col, keep=rest, **options)
    names = {id_col: "doc_id", text_col: "text"} | {c: f"_{c}" for c in rest}
    return out.select(*(F.col(names[c]).cast(docs.schema[c].dataType).alias(c) for c in docs.columns))
