"""Alignment of two tokenizers: token ends of both swept together, a document at a time, and the id pairs that end together counted over the corpus."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, in_pieces, total
from .exchange import FEWEST
from .packing import encoder, segments

RESULT = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
#: An event row holds the ids of one side's tokens that start in one span of so many bytes.
SPAN = 1 << 16
#: Distinct pairs of documents that a chunk holds.
HELD = 1 << 21
EVENTS = "doc_id long, h1 long, h2 long, offset long, side int, tokens long, copies long, n int, ids binary"
_EVENTS = pa.schema([("doc_id", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("offset", pa.int64()), ("side", pa.int32()), ("tokens", pa.int64()), ("copies", pa.int64()), ("n", pa.int32()), ("ids", pa.binary())])
SWEPT = "chunk long, doc_id long, copies long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, places binary, times binary, pairs array<long>, counts array<long>, entries long"
_SWEPT = pa.schema(
    [(c, pa.int64()) for c in ("chunk", "doc_id", "copies", "n_a", "n_b", "n_groups", "n_links")]
    + [("groups_sha256", pa.string()), ("places", pa.binary()), ("times", pa.binary()), ("pairs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("entries", pa.int64())]
)
_RESULT = pa.schema([(c, pa.string() if c == "groups_sha256" else pa.int64()) for c in (*RESULT, "copies")])


@dataclass(frozen=True)
class Side:
    """A tokenizer: ids of a text to which a space is put in front, and the bytes of each id."""

    encode: Callable[[str], list[int]]
    table: list[bytes]

    @property
    def lengths(self) -> np.ndarray:
        return np.array([len(x) for x in self.table], np.int64)


def byte_level(entry: str) -> bytes:
    """Bytes of an entry of a byte-level vocabulary, in which printable bytes stand for themselves and others for characters from U+0100 on, in their order."""
    return bytes(_ALPHABET[c] if c in _ALPHABET else 0 for c in entry) if all(c in _ALPHABET for c in entry) else entry.encode()


_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_ALPHABET = {chr(b): b for b in _PLAIN} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(_PLAIN)))}


def byte_side(tokenizer: str, ranks: str = "", pattern: str = "") -> Side:
    """A byte-level .json tokenizer; strings of its special tokens are plain text. ranks, pattern: as for packing.encoder."""
    with open(tokenizer) as f:
        known = json.load(f)
    ids = known["model"]["vocab"] | {t["content"]: t["id"] for t in known["added_tokens"]}
    table = [b""] * (max(ids.values()) + 1)
    for entry, k in ids.items():
        table[k] = byte_level(entry)
    plain = encoder(tokenizer, ranks, pattern, special=False)
    return Side(lambda text: plain(" " + text), table)


def piece_side(model: str) -> Side:
    """A sentencepiece model that puts a space in front of a text by itself."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=model)
    table = [bytes([int(p.id_to_piece(k)[3:5], 16)]) if p.is_byte(k) else p.id_to_piece(k).replace("▁", " ").encode() for k in range(p.get_piece_size())]
    return Side(p.encode, table)


def encoded(side: Side, text: str) -> np.ndarray | None:
    """Token ids of space+text, a segment after another; None if their bytes are not those of the text."""
    out = []
    for part in segments(text):
        ids = side.encode(part)
        if b"".join(map(side.table.__getitem__, ids)) != b" " + part.encode():
            return None
        out.append(np.array(ids, "<u4"))
    return np.concatenate(out)


def events(docs: DataFrame, number: int, side: Callable[[], Side], span: int = SPAN) -> DataFrame:
    """End events of one side. A row holds the tokens that start in one span; their ends follow from the offset of the first and the ids.

    Every document has a row at offset 0, which says how many tokens there are: none for an empty text, -1 where the tokens' bytes are not those of the text. Rows of a batch equal in
    id and text are sent once, with their number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = side()
        lengths = own.lengths
        small = len(lengths) <= 1 << 16
        for batch in batches:
            for piece in in_pieces(batch, "text", 4 << 20):
                seen: dict[tuple, int] = {}
                rows: list[list] = []
                for doc, h1, h2, text in zip(*(piece.column(k).to_pylist() for k in range(3)), piece.column("text"), strict=True):
                    if (doc, h1, h2) in seen:
                        rows[seen[doc, h1, h2]][6] += 1
                        continue
                    seen[doc, h1, h2] = len(rows)
                    ids = encoded(own, x) if (x := text.as_py()) else np.zeros(0, "<u4")
                    tokens = -1 if ids is None else len(ids)
                    if tokens <= 0:
                        rows.append([doc, h1, h2, 0, number, tokens, 1, 0, None])
                        continue
                    starts = np.cumsum(lengths[ids]) - lengths[ids]
                    cuts = np.unique(np.searchsorted(starts, np.arange(0, int(starts[-1]) + 1, span)))
                    ids = ids.astype("<u2") if small else ids
                    for a, b in zip(cuts, [*cuts[1:], len(ids)], strict=True):
                        rows.append([doc, h1, h2, int(starts[a]), number, tokens, 1 if a == 0 else 0, int(b - a), pa.compress(ids[a:b].tobytes(), "zstd", asbytes=True)])
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _EVENTS, strict=True)], schema=_EVENTS)

    return docs.mapInArrow(run, EVENTS)


class Sweep:
    """The machine: token ends of one document come in by offset from both sides; wherever a token of each ends, a group is closed and linked.

    It holds what has come in since the last common end, a block of each side at most beyond it, and the distinct pairs so far.
    """

    def __init__(self, lengths: tuple[np.ndarray, np.ndarray], strings: list[bytes]):
        self.lengths, self.strings, self.base = lengths, strings, len(strings) // 3
        self.reset()

    def reset(self) -> None:
        self.ids = [np.zeros(0, np.int64)] * 2
        self.ends = [np.zeros(0, np.int64)] * 2
        self.groups, self.digest = 0, hashlib.sha256()
        self.found: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def take(self, side: int, offset: int, ids: np.ndarray) -> None:
        ids = ids.astype(np.int64)
        self.ids[side] = np.concatenate([self.ids[side], ids])
        self.ends[side] = np.concatenate([self.ends[side], offset + np.cumsum(self.lengths[side][ids])])
        (a, b), (ea, eb) = self.ids, self.ends
        if not len(a) or not len(b):
            return
        at = np.minimum(np.searchsorted(eb, ea), len(eb) - 1)
        i = np.flatnonzero(eb[at] == ea)
        if not len(i):
            return
        j = at[i]
        self._write(a[: i[-1] + 1], b[: j[-1] + 1], i, j)
        self._link(a[i] << 32 | b[j])
        self.ids, self.ends = [a[i[-1] + 1 :], b[j[-1] + 1 :]], [ea[i[-1] + 1 :], eb[j[-1] + 1 :]]

    def _write(self, a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
        """Feed a1,a2|b1;... to the digest: each id with the mark in front of it."""
        first_a, first_b = np.concatenate([[0], i[:-1] + 1]), np.concatenate([[0], j[:-1] + 1])
        mark_a, mark_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)  # 0 comma, 1 bar, 2 semicolon
        mark_a[first_a], mark_b[first_b] = 2, 1
        out = np.empty(len(a) + len(b), np.int64)
        out[np.arange(len(a)) + np.repeat(first_b, np.diff(first_a, append=len(a)))] = a + mark_a * self.base
        out[np.arange(len(b)) + np.repeat(i + 1, np.diff(first_b, append=len(b)))] = b + mark_b * self.base
        text = b"".join(map(self.strings.__getitem__, out.tolist()))
        self.digest.update(text if self.groups else text[1:])
        self.groups += len(i)

    def _link(self, pairs: np.ndarray) -> None:
        self.found.append((pairs, np.ones(len(pairs), np.int64)))
        self.waiting += len(pairs)
        if self.waiting > HELD:
            self.found = [self.pairs()]
            self.waiting = len(self.found[0][0])

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """(distinct pairs as a * 2**32 + b, links of each)."""
        if not self.found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        values, index = np.unique(np.concatenate([x for x, _ in self.found]), return_inverse=True)
        return values, np.bincount(index, np.concatenate([n for _, n in self.found])).astype(np.int64)


def marked(size: int) -> list[bytes]:
    """Decimal ids with each mark in front: comma, bar, semicolon."""
    return [m + b"%d" % k for m in (b",", b"|", b";") for k in range(size)]


def swept(rows: DataFrame, sides: tuple[Callable[[], Side], Callable[[], Side]]) -> DataFrame:
    """Groups and links of each document from its events in order; of a chunk of documents, one more row with the chunk's distinct pairs and how often they are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [s().lengths for s in sides]
        sweep = Sweep(tuple(tables), marked(max(map(len, tables))))
        kinds = ["<u2" if len(x) <= 1 << 16 else "<u4" for x in tables]
        chunk = TaskContext.get().partitionId() << 33
        done: list[tuple] = []
        entries, current, tokens, copies, last = 0, None, [0, 0], 0, None

        def flush() -> pa.RecordBatch:
            values, index = np.unique(np.concatenate([d[-2] for d in done]), return_inverse=True)
            counts = np.zeros(len(values), np.int64)
            ends = np.cumsum([len(d[-2]) for d in done])
            out = []
            for (doc, n, n_a, n_b, groups, links, sha, u, times), end in zip(done, ends.tolist(), strict=True):
                places = index[end - len(u) : end]
                counts[places] += n * times
                out.append([chunk, doc, n, n_a, n_b, groups, links, sha, places.astype("<u4").tobytes(), times.astype("<i8").tobytes(), None, None, None])
            out.append([chunk, *[None] * 9, values, counts, int(ends[-1])])
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _SWEPT, strict=True)], schema=_SWEPT)

        def close() -> None:
            nonlocal entries
            if min(tokens) < 0 or not max(tokens):
                done.append((current[0], copies, 0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64)))
            else:
                u, times = sweep.pairs()
                done.append((current[0], copies, *tokens, sweep.groups, int(times.sum()), sweep.digest.hexdigest(), u, times))
            entries += len(done[-1][-1]) + 16
            sweep.reset()

        for batch in batches:
            for doc, h1, h2, offset, side, n_tokens, n_copies, n, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (doc, h1, h2) != current:
                    if current is not None:
                        close()
                        if entries >= HELD:
                            yield flush()
                            done.clear()
                            chunk, entries = chunk + 1, 0
                    current, copies, tokens = (doc, h1, h2), 0, [0, 0]
                if offset == 0:
                    tokens[side] = n_tokens
                    copies += n_copies if side == 0 else 0
                if (current, offset, side) != last and min(tokens) >= 0 and n:  # equal rows bring equal events
                    sweep.take(side, offset, np.frombuffer(pa.decompress(ids, n * int(kinds[side][2]), "zstd"), kinds[side]))
                last = (current, offset, side)
        if current is not None:
            close()
            yield flush()

    return rows.mapInArrow(run, SWEPT)


def _counted(rows: pa.Table, replies: pa.Table) -> pa.Table:
    """Sums over the documents of some chunks, from the totals of all pairs that these chunks hold."""
    pair = replies.column("pair").to_numpy()
    order = np.argsort(pair)
    pair, total, best = pair[order], replies.column("total").to_numpy()[order], replies.column("best").to_numpy(zero_copy_only=False)[order]
    lists = rows.filter(pc.is_valid(rows.column("pairs")))
    known = {c: np.searchsorted(pair, x.values.to_numpy()) for c, x in zip(lists.column("chunk").to_pylist(), lists.column("pairs"), strict=True)}
    docs = rows.filter(pc.is_null(rows.column("pairs")))
    n_best, count_sum = np.zeros(docs.num_rows, np.int64), np.zeros(docs.num_rows, np.int64)
    for k, (c, places, times) in enumerate(zip(docs.column("chunk").to_pylist(), docs.column("places"), docs.column("times"), strict=True)):
        p, t = known[c][np.frombuffer(places.as_buffer(), "<u4")], np.frombuffer(times.as_buffer(), "<i8")
        n_best[k], count_sum[k] = t[best[p]].sum(), (t * total[p]).sum()
    return pa.table([pa.array(n_best) if f.name == "n_best" else pa.array(count_sum) if f.name == "count_sum" else docs.column(f.name).combine_chunks() for f in _RESULT], schema=_RESULT)


def align(docs: DataFrame, a: Callable[[], Side], b: Callable[[], Side], id_col: str = "doc_id", text_col: str = "text", span: int = SPAN) -> DataFrame:
    """Groups and links of every document's tokens under two tokenizers, and how its links stand among those of all documents.

    Tokens of space+text, as bytes; byte offsets where a token of each side ends cut them into groups and link the two tokens. A pair of ids counts as many links as hold it in all documents.
    Returns doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair is linked most often of all with its b, ties included), count_sum (counts over links) and groups_sha256.
    A null or empty text, or one that a tokenizer changes, has zeros and an empty digest. Rows without an id, or with one id and different texts, are documents of their own; each of
    equal rows is returned and counts. An empty table gives no rows; other columns play no part. A long text is encoded in segments and sent in spans; a task holds one span of each
    side beyond the last common end. Bytes of every id must not be empty.

    Events of both sides are dealt by document and sorted by offset. A task counts the pairs of its own chunks of documents before they are added up, so a pair that is everywhere costs
    one row a chunk; sets of chunks get their pairs' totals back by a join.
    """
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(71), text).alias("h2"), text.alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ends = events(rows, 0, a, span).union(events(rows, 1, b, span))
    laid = checkpointed(swept(ends.repartition(parts, "doc_id", "h1", "h2").sortWithinPartitions("doc_id", "h1", "h2", "offset", "side"), (a, b)))
    # chunks go together in sets whose number follows from the data, however many tasks there were
    sets = FEWEST + 2 * total(laid, "entries") // HELD
    laid = laid.withColumn("home", F.pmod(F.xxhash64("chunk"), F.lit(sets)))
    listed = laid.filter("pairs is not null").select("home", F.explode(F.arrays_zip("pairs", "counts")).alias("x"))
    asked = listed.groupBy("home", F.col("x.pairs").alias("pair")).agg(F.sum("x.counts").alias("n"))
    totals = asked.groupBy("pair").agg(F.sum("n").alias("total")).withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)))
    top = totals.groupBy("b").agg(F.max("total").alias("top"))
    known = totals.join(top, "b").select("pair", "total", (F.col("total") == F.col("top")).alias("best"))
    replies = asked.select(F.col("home").alias("set"), "pair").join(known, "pair").select("set", "pair", "total", "best")
    counted = laid.drop("counts", "entries").groupBy("home").cogroup(replies.groupBy("set")).applyInArrow(_counted, ", ".join(f"{f.name} {'string' if f.name == 'groups_sha256' else 'long'}" for f in _RESULT))
    return counted.select(*RESULT, F.explode(F.expr("array_repeat(1, cast(copies as int))"))).select(*RESULT)


def public_sides(byte_name: str = "byte_bpe_50k", piece_name: str = "piece_bpe_32k") -> tuple[Callable[[], Side], Callable[[], Side]]:
    """The two sides from public vocabulary files, opened where a task runs."""

    def a() -> Side:
        import public_tokenizers

        return byte_side(public_tokenizers.path(f"{byte_name}.json"), public_tokenizers.path(f"{byte_name}.tiktoken"), public_tokenizers.PATTERN)

    def b() -> Side:
        import public_tokenizers

        return piece_side(public_tokenizers.path(f"{piece_name}.model"))

    return a, b
