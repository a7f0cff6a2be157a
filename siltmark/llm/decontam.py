"""Benchmark decontamination by greedy string tiling."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_pieces, spans_hash, text_bytes, total, windows_hash, words_of

RESULT = "doc_id long, item_id long, item_words long, covered long, tiles long, coverage double"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("item_words", pa.int64()), ("covered", pa.int64()), ("tiles", pa.int64()), ("coverage", pa.float64())])
#: Pairs of a text and a place in the benchmark that are looked at together, at most, unless one text alone has more; those are no more than a block's places.
PAIRS = 1 << 20


@dataclass(frozen=True)
class Index:
    """Words of benchmark items, the seed (hash of `least` words) that starts at each, and all seeds in order with their places."""

    item: np.ndarray
    first: np.ndarray
    word: np.ndarray
    own: np.ndarray
    seed: np.ndarray
    at: np.ndarray


def index_items(ids: list[int], texts: list[str], least: int) -> Index:
    data, offsets = text_bytes(pa.array(texts, pa.string()))
    _, _, word, first = words_of(data, offsets, lower=True)
    doc = np.repeat(np.arange(len(ids)), np.diff(first))
    at = np.flatnonzero(first[doc + 1] - np.arange(len(word)) >= least)
    seed = windows_hash(word, at, least, 1)
    own = np.zeros(len(word), np.uint64)
    own[at] = seed
    order = np.lexsort((at, seed))
    return Index(np.array(ids, np.int64), first, word, own, seed[order], at[order])


def shared_index(items: DataFrame, blocks: int, least: int) -> Callable[[int], Index]:
    """Give every executor the index of each block of items (i, t) as files; the result opens one there, mapped from its file, not held in memory.

    The driver holds one block at a time.
    """
    context, name = items.sparkSession.sparkContext, f"items-{uuid.uuid4().hex}"
    folder = Path(tempfile.mkdtemp(prefix="siltmark-"))
    names = [f.name for f in fields(Index)]
    for b in range(blocks):
        rows = sorted(items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b).collect())
        ix = index_items([r[0] for r in rows], [r[1] for r in rows], least)
        for part in names:
            np.save(folder / f"{name}-{b}-{part}.npy", getattr(ix, part))
            context.addFile(str(folder / f"{name}-{b}-{part}.npy"))

    def opened(b: int) -> Index:
        return Index(*(np.load(SparkFiles.get(f"{name}-{b}-{part}.npy"), mmap_mode="r") for part in names))

    return opened


def longest_run(flags: np.ndarray) -> int:
    """Length of the longest run of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return int((edges[1::2] - edges[0::2]).max(initial=0))


def tiling(item: np.ndarray, text: np.ndarray, gap: np.ndarray, least: int) -> tuple[int, int]:
    """(words of the item covered, number of tiles): the longest matches of unmarked words are marked first, down to `least` words.

    Matches of a length are found by running Karp-Rabin hashes over both; gap is true at words of the text that do not follow the one before. Lengths start
    at the longest run of places whose seed both sides still have, as no match is longer.
    """
    free_i, free_t = np.ones(len(item), bool), np.ones(len(text), bool)
    covered = tiles = 0
    broken = np.concatenate([[0], np.cumsum(gap)])

    def open_places(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Where so many unmarked words in a row start in the item and in the text, and their hashes."""
        runs_i, runs_t = (np.concatenate([[0], np.cumsum(~f)]) for f in (free_i, free_t))
        a = np.flatnonzero(runs_i[size:] == runs_i[: len(item) - size + 1])
        b = np.flatnonzero((runs_t[size:] == runs_t[: len(text) - size + 1]) & (broken[size:] == broken[1 : len(text) - size + 2]))
        return a, b, spans_hash(item, a, a + size, 2), spans_hash(text, b, b + size, 2)

    while min(len(item), len(text)) >= least:
        a, b, ha, hb = open_places(least)
        common = np.zeros(len(item), bool)
        common[a[np.isin(ha, hb)]] = True
        both = np.zeros(len(text), bool)
        both[b[np.isin(hb, ha)]] = True
        if not common.any():
            break
        size = least - 1 + min(longest_run(common), longest_run(both))
        marked = False
        while size >= least and not marked:
            a, b, ha, hb = open_places(size)
            order = np.argsort(hb, kind="stable")
            lo, hi = (np.searchsorted(hb[order], ha, side) for side in ("left", "right"))
            for i, x, y in zip(a[hi > lo], lo[hi > lo], hi[hi > lo], strict=True):
                if not free_i[i : i + size].all():
                    continue
                for k in order[x:y]:
                    j = int(b[k])
                    if free_t[j : j + size].all() and (item[i : i + size] == text[j : j + size]).all():
                        free_i[i : i + size] = free_t[j : j + size] = False
                        covered, tiles, marked = covered + size, tiles + 1, True
                        break
            size -= 1
        if not marked:
            break
    return covered, tiles


def overlaps(ix: Index, data: np.ndarray, offsets: np.ndarray, least: int, threshold: float) -> list[tuple[int, int, int, int, int]]:
    """(text, item, words of the item, covered, tiles) of the pairs that reach the threshold; texts and items by their place."""
    _, _, word, first = words_of(data, offsets, lower=True)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    at = np.flatnonzero(first[doc + 1] - np.arange(len(word)) >= least)
    if not len(at) or not len(ix.seed):
        return []
    h = windows_hash(word, at, least, 1)
    lo = np.searchsorted(ix.seed, h, "left")
    hit = np.asarray(ix.seed[np.minimum(lo, len(ix.seed) - 1)]) == h
    at, h, d = at[hit], h[hit], doc[at[hit]]
    # distinct seeds of each text: the places that they have in the benchmark differ, so a text has no more pairs than the benchmark has places
    order = np.lexsort((h, d))
    new = np.ones(len(order), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (d[order][1:] != d[order][:-1])
    seeds, texts = h[order][new], d[order][new]
    lo = np.searchsorted(ix.seed, seeds, "left")
    count = np.searchsorted(ix.seed, seeds, "right") - lo
    ends, text_ends = np.cumsum(count), np.append(np.flatnonzero(np.diff(texts)) + 1, len(texts)) if len(texts) else np.zeros(0, int)
    out, begin = [], 0
    while begin < len(texts):
        limit = (ends[begin - 1] if begin else 0) + PAIRS
        fit = text_ends[(text_ends > begin) & (ends[text_ends - 1] <= limit)]
        stop = int(fit[-1] if len(fit) else text_ends[np.searchsorted(text_ends, begin, "right")])
        n, start = count[begin:stop], lo[begin:stop]
        place = np.asarray(ix.at)[np.repeat(start, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)]
        who = np.repeat(texts[begin:stop], n)
        item = np.searchsorted(ix.first, place, "right") - 1
        by = np.lexsort((place, item, who))
        place, who, item = place[by], who[by], item[by]
        pair = np.ones(len(by), bool)
        pair[1:] = (who[1:] != who[:-1]) | (item[1:] != item[:-1])
        heads = np.flatnonzero(pair)
        # words of the item that any seed covers: no tiling covers more
        step = np.full(len(by), least)
        step[:-1] = np.where(pair[1:], least, np.minimum(np.diff(place), least))
        most = np.add.reduceat(step, heads)
        size = ix.first[item[heads] + 1] - ix.first[item[heads]]
        for g in np.flatnonzero(most >= threshold * size):
            k, t = int(item[heads[g]]), int(who[heads[g]])
            i0, i1 = int(ix.first[k]), int(ix.first[k + 1])
            mine = at[d == t]
            mine = mine[np.isin(h[d == t], ix.own[i0 : i1 - least + 1])]
            near = np.unique((mine[:, None] + np.arange(least)).ravel())
            gap = np.concatenate([[True], np.diff(near) > 1])
            covered, tiles = tiling(np.asarray(ix.word[i0:i1]), word[near], gap, least)
            if covered >= threshold * (i1 - i0):
                out.append((t, k, i1 - i0, covered, tiles))
        begin = stop
    return out


def _items(benchmark: DataFrame, item_id: str, item_text: str, block_bytes: int) -> tuple[DataFrame, int]:
    """(items (i, t) with an id and a text, number of blocks)."""
    items = benchmark.filter(F.col(item_id).isNotNull() & (F.octet_length(item_text) > 0)).select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t"))
    return items, max(1, -(-total(items, F.octet_length("t")) // block_bytes))


def contaminated(
    docs: DataFrame, benchmark: DataFrame, least: int = 4, threshold: float = 0.6, block_bytes: int = 16 << 20, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """Pairs of a document and a benchmark item of which tiles cover at least `threshold`: doc_id, item_id, item_words, covered, tiles, coverage.

    A tile is a run of at least `least` equal words (lower-cased A-Z); tiles may lie in any order, so reordered passages count. Documents are read once and do not move; items
    go out as files, in blocks of bounded size. A null or empty text or item matches nothing, nor does an item of
    fewer words than `least`; a row or item without an id is left out; equal items each match; rows with one id give a row each; no rows if either table is empty.
    """
    items, blocks = _items(benchmark, item_id, item_text, block_bytes)
    opened = shared_index(items, blocks, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = [opened(b) for b in range(blocks)]
        for batch in batches:
            for part in in_pieces(batch, "text", 2 << 20):
                ids, texts = part.column("doc_id").to_numpy(), text_bytes(part.column("text"))
                for ix in index:
                    if found := overlaps(ix, *texts, least, threshold):
                        d, k, n, c, m = (np.array(x) for x in zip(*found, strict=True))
                        yield pa.RecordBatch.from_arrays([pa.array(ids[d]), pa.array(np.asarray(ix.item)[k]), pa.array(n), pa.array(c), pa.array(m), pa.array(c / n)], schema=_SCHEMA)

    return docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, RESULT)


def clean(
    docs: DataFrame, benchmark: DataFrame, least: int = 4, threshold: float = 0.6, block_bytes: int = 16 << 20, text_col: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """The rows that cover no benchmark item, in the input's columns. Each row, with or without an id, is judged by its own text where it lies; see contaminated()."""
    items, blocks = _items(benchmark, item_id, item_text, block_bytes)
    opened = shared_index(items, blocks, least)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = [opened(b) for b in range(blocks)]
        for batch in batches:
            for part in in_pieces(batch, batch.schema.names[at], 2 << 20):
                keep, texts = np.ones(part.num_rows, bool), text_bytes(part.column(at))
                for ix in index:
                    keep[[t for t, *_ in overlaps(ix, *texts, least, threshold)]] = False
                yield part.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
