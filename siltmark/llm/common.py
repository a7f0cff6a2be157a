"""Shared helpers of the text operators: checkpoints, byte-level views of Arrow text, word hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_folder

#: Bytes that separate words: space and U+0009 to U+000D.
SPACES = (0x20, *range(0x09, 0x0E))
_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the session's checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def total(df: DataFrame, column) -> int:
    """Sum of a numeric column over all rows, as a plain int."""
    return int(df.agg(F.sum(column)).first()[0] or 0)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text. Offsets have one more entry than rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def in_pieces(batch: pa.RecordBatch, text: str, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with at most so many bytes of text each, or one row."""
    if not batch.num_rows:
        return
    ends = text_bytes(batch.column(text))[1]
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + most, "right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser over uint64 values (wraps around)."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASES = {0: 0xD6E8FEB86659FD93, 1: 0xA0761D6478BD642F, 2: 0xE7037ED1A0B428DB, 3: 0x8EBC6AF09C88C6E3}
#: Powers that are kept between calls; longer tables are made when they are needed and dropped again.
_KEPT = 1 << 16
_POWERS: dict[tuple[int, bool], np.ndarray] = {}


def powers(seed: int, inverse: bool, n: int) -> np.ndarray:
    """The first n powers of an odd base modulo 2**64, or of its inverse."""
    base = pow(_BASES[seed], -1, 2**64) if inverse else _BASES[seed]
    have = _POWERS.get((seed, inverse))
    if have is None or n > len(have):
        out = np.full(max(n, _KEPT), np.uint64(base))
        out[0] = 1
        have = np.cumprod(out, dtype=np.uint64)
        if n <= _KEPT:
            _POWERS[seed, inverse] = have
    return have[:n]


def _with_length(h: np.ndarray, size, seed: int) -> np.ndarray:
    return mix(h, seed) + np.asarray(size).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hashes of values[start:end], equal where the sequences are equal."""
    n = len(values)
    if not len(starts):
        return np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(values, seed + 11) * powers(seed, False, n), out=sums[1:])
    back = powers(seed, True, n + 1)
    return _with_length((sums[ends] - sums[starts]) * back[starts], ends - starts, seed)


def windows_hash(values: np.ndarray, starts: np.ndarray, size: int, seed: int, block: int = 1 << 17) -> np.ndarray:
    """64-bit hashes of values[start:start + size] for ascending starts: those of spans_hash, without tables as long as the values."""
    out = np.empty(len(starts), np.uint64)
    base = np.uint64(_BASES[seed])
    at = 0
    while at < len(starts):
        lo = int(starts[at])
        to = int(np.searchsorted(starts, lo + block, "left"))
        m = mix(values[lo : int(starts[to - 1]) + size], seed + 11)
        n = len(m) - size + 1
        h = m[size - 1 :].copy()
        for k in range(size - 2, -1, -1):
            h *= base
            h += m[k : k + n]
        out[at:to] = h[starts[at:to] - lo]
        at = to
    return _with_length(out, size, seed)


_BYTES = {seed: mix(np.arange(256, dtype=np.uint64), seed + 11) for seed in _BASES}


def places(n: int) -> type:
    """The smaller integer type that holds positions up to n."""
    return np.int32 if n < 2**31 - 1 else np.int64


def cut_at_spaces(data: np.ndarray, offsets: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(offsets with more cuts, at a space, in texts longer than `most` bytes; places of the given offsets among them). A word of any length stays whole."""
    long = np.flatnonzero(np.diff(offsets) > most)
    if not len(long):
        return offsets, np.arange(len(offsets))
    more = []
    for t in long.tolist():
        at, end = int(offsets[t]) + most, int(offsets[t + 1])
        while at < end:
            space = np.flatnonzero(_SPACE[data[at : min(end, at + most)]][: most])
            if len(space):
                more.append(at + int(space[0]))
                at = more[-1]
            at += most
    cuts = np.unique(np.concatenate([offsets, np.array(more, offsets.dtype)]))  # an empty text's offset is there once
    return cuts, np.searchsorted(cuts, offsets)


def _long_words(part: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool, seed: int, block: int = 1 << 18) -> np.ndarray:
    """What words_of sums up for each word, a block of a word at a time."""
    out = np.zeros(len(starts), np.uint64)
    for k, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
        h = 0
        for at in range(a, b, block):
            piece = part[at : min(b, at + block)]
            byte = _BYTES[seed][_LOWER[piece] if lower else piece]
            h += int((byte * powers(seed, False, len(piece))).sum(dtype=np.uint64)) * pow(_BASES[seed], at - a, 2**64)
        out[k] = h % 2**64
    return out


def words_of(data: np.ndarray, offsets: np.ndarray, lower: bool, seed: int = 0, block: int = 1 << 18) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words [^space]+ of the texts: (starts, ends, hash, first), first[i] being the first word of text i (one more entry than texts).

    Works through blocks of texts, and blocks of a long text cut at spaces, so that the arrays for each byte stay small.
    """
    kind = places(len(data))
    offsets, given = cut_at_spaces(data, offsets, block)
    starts, ends, hashes, counts = [], [], [], []
    at = seen = 0
    while at < len(offsets) - 1:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + block, "right")) - 1)
        lo, hi = int(offsets[at]), int(offsets[to])
        part = data[lo:hi]
        inside = ~_SPACE[part]
        edge = np.zeros(hi - lo + 1, bool)
        if hi > lo:
            edge[1:-1] = inside[1:] != inside[:-1]
            edge[0], edge[-1] = inside[0], inside[-1]
        cut = offsets[at + 1 : to] - lo  # a word ends with its text
        both = cut[(cut > 0) & (cut < hi - lo)]
        joined = np.unique(both[inside[both] & inside[both - 1]]) if len(both) else both
        points = np.flatnonzero(edge)
        if len(joined):
            points = np.sort(np.concatenate([points, joined, joined]))
        s, e = points[0::2], points[1::2]
        if len(s) and hi - lo > 4 * block:  # a word of that length is in it
            hashes.append(_with_length(_long_words(part, s, e, lower, seed), e - s, seed))
            starts.append((s + lo).astype(kind))
            ends.append((e + lo).astype(kind))
        elif len(s):
            # each byte counts by its place in its word
            size = e - s
            byte = np.zeros(int(e[-1]) + 1, np.uint64)
            byte[:-1] = _BYTES[seed][_LOWER[part[: e[-1]]] if lower else part[: e[-1]]]
            place = np.zeros(len(byte), np.int32)
            place[s] = 1
            np.cumsum(place, out=place)
            place = np.arange(len(byte), dtype=np.int32) - s.astype(np.int32)[np.maximum(place - 1, 0)]
            byte *= powers(seed, False, int(size.max()) + 1)[np.clip(place, 0, int(size.max()))]
            h = np.add.reduceat(byte, points)[0::2]
            hashes.append(_with_length(h, size, seed))
            starts.append((s + lo).astype(kind))
            ends.append((e + lo).astype(kind))
        counts.append(np.searchsorted(s, offsets[at + 1 : to + 1] - lo, "left") + seen)
        seen += len(s)
        at = to
    cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
    return cat(starts, kind), cat(ends, kind), cat(hashes, np.uint64), np.concatenate([[0], *counts]).astype(np.int64)[given]


def blocks_of(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts with at most so many bytes each, or one text."""
    at = 0
    while at < len(offsets) - 1:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, to
        at = to


def arrow_rows(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A record batch from numpy arrays or lists, in the schema's order and types."""
    return pa.RecordBatch.from_arrays([c if isinstance(c := columns[f.name], pa.Array) else pa.array(c, f.type) for f in schema], schema=schema)


def over_texts(f: Callable[[pa.RecordBatch], pa.RecordBatch | None], text: str = "text", most: int = 4 << 20) -> Callable:
    """A function for mapInArrow that calls f on slices with bounded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in in_pieces(batch, text, most):
                if (out := f(piece)) is not None:
                    yield out

    return run
