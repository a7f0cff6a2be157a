"""Packing of tokenised documents into fixed-length sequences with balanced attention cost."""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_SCHEMA = pa.schema([(c.split()[0], pa.int64()) for c in PIECES.split(", ")])


#: A space between two characters of which neither is white space, nor U+2581, which some vocabularies use for it. No token of a vocabulary that splits words holds such a space inside.
_CUT = re.compile(r"(?<=[^\s\u2581]) (?=[^\s\u2581])")


def segments(text: str, most: int = 1 << 18) -> Iterator[str]:
    """Parts of a text, of about `most` characters, whose tokens are those of the text; the space between two parts is left out and belongs to the second one.

    A longer run without a cut stays whole.
    """
    at = 0
    while len(text) - at > most and (cut := _CUT.search(text, at + most)):
        yield text[at : cut.start()]
        at = cut.end()
    yield text[at:] if at else text


def encoder(tokenizer: str, ranks: str = "", pattern: str = "", special: bool = True) -> Callable[[str], list[int]]:
    """Token ids of a text as the .json tokenizer gives them without tokens around it. special: its added tokens' strings in a text are those tokens, else plain text.

    ranks: a .tiktoken file of the same vocabulary, with the pattern that splits words; its encoder gives the same ids, faster. Where that pattern's engine gives up,
    on white space of about a million characters, the .json tokenizer does the text.
    """
    known_slow: list = []

    def slow(text: str) -> list[int]:
        if not known_slow:
            from tokenizers import Tokenizer

            known_slow.append(Tokenizer.from_file(tokenizer))
            known_slow[0].encode_special_tokens = not special
        return known_slow[0].encode(text, add_special_tokens=False).ids

    if not ranks:
        return slow
    import tiktoken

    with open(tokenizer) as f:
        added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]} if special else {}
    with open(ranks, "rb") as f:
        known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=known, special_tokens=added)

    def fast(text: str) -> list[int]:
        try:
            return own.encode(text, allowed_special="all", disallowed_special=())
        except ValueError:
            return slow(text)

    return fast


def token_ids(encode: Callable[[str], list[int]], text: str) -> np.ndarray:
    """Ids of a whole text, a segment at a time."""
    return np.concatenate([np.array(encode(" " + part if k else part), "<u4") for k, part in enumerate(segments(text))])


def capacities(tokens: int, length: int) -> list[int]:
    """Sequence sizes that hold exactly so many tokens: full ones, then powers of two, which need no padding."""
    rest = tokens % length
    return [length] * (tokens // length) + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]


def balanced(lengths: np.ndarray, length: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, size, sequence, offset) that fill the sequences exactly.

    Whole sequences are cut from long documents first. The rest go in descending cost (linear * n + quadratic * n**2)
    to the sequence of lowest cost that still has room; one that fits nowhere is cut over the cheapest ones with any room.
    """
    out, seq = [], 0
    full = lengths // length
    for d in np.flatnonzero(full):
        for k in range(int(full[d])):
            out.append((int(d), k * length, length, seq, 0))
            seq += 1
    rest = lengths - full * length
    room = np.array(capacities(int(rest.sum()), length), np.int64)
    size, cost = room.copy(), np.zeros(len(room))
    order = np.argsort(-(linear * rest + quadratic * rest.astype(float) ** 2), kind="stable")
    for d in order[: np.count_nonzero(rest)]:
        left, start = int(rest[d]), int(full[d]) * length
        while left:
            fits = room >= left
            k = int(np.where(fits if fits.any() else room > 0, cost, np.inf).argmin())
            n = min(left, int(room[k]))
            out.append((int(d), start, n, seq + k, int(size[k] - room[k])))
            cost[k] += linear * n + quadratic * n * n
            room[k] -= n
            left, start = left - n, start + n
    return out


def pack(
    docs: DataFrame,
    tokenizer: str,
    ranks: str = "",
    pattern: str = "",
    length: int = 1024,
    end_id: int = 0,
    linear: float = 1.0,
    quadratic: float = 1.0 / 1024,
    tokens_a_block: int = 3_000_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Cut tokenised documents into pieces and pack them.

    Each task packs its own rows in blocks of bounded tokens, so nothing is shuffled; every sequence is full or a
    power of two long, so none is padded. A null text is an empty one: it has only the end id. Repeated rows are packed
    each; an empty table gives no rows; other columns are dropped. with_ids adds the piece's ids as array<int>.
    Sequence ids hold the partition in their upper bits and are the same if a task runs again.
    """
    blocks = _schema(with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, ranks, pattern)
        base = TaskContext.get().partitionId() << 36
        ids: list[np.ndarray] = []
        keys: list = []
        held = 0

        def flush():
            nonlocal base, held
            pieces = balanced(np.array([len(x) for x in ids], np.int64), length, linear, quadratic)
            d, s, n, q, o = (np.array(c, np.int64) for c in zip(*pieces, strict=True))
            cuts = [ids[a][b : b + c] for a, b, c in zip(d, s, n, strict=True)]
            columns = [
                pa.array([keys[i] for i in d], pa.int64()), pa.array(s), pa.array(n), pa.array([zlib.crc32(x.tobytes()) for x in cuts], pa.int64()),
                pa.array([len(ids[i]) for i in d], pa.int64()), pa.array(q + base), pa.array(o),
            ]
            if with_ids:
                columns.append(pa.array([x.astype(np.int32) for x in cuts], pa.list_(pa.int32())))
            base += int(q.max()) + 1
            ids.clear(), keys.clear()
            held = 0
            return pa.RecordBatch.from_arrays(columns, schema=blocks)

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                t = np.append(token_ids(encode, text.as_py() or ""), np.array([end_id], "<u4"))
                ids.append(t)
                keys.append(key)
                held += len(t)
                if held >= tokens_a_block:
                    yield flush()
        if ids:
            yield flush()

    return docs.select(docs[id_col].cast("long"), docs[text_col]).mapInArrow(run, PIECES + ", ids array<int>" * with_ids)


def _schema(with_ids: bool) -> pa.Schema:
    return _SCHEMA.append(pa.field("ids", pa.list_(pa.int32()))) if with_ids else _SCHEMA


def padding(lengths: list[int], length: int) -> int:
    """Pad tokens that sequences of these lengths need: none at a power of two, else up to the full length."""
    return sum(0 if n & (n - 1) == 0 else length - n for n in lengths)
