"""Ask and answer: chunks of documents ask, once for each distinct hash they hold, who else has it.

Documents are dealt to chunks by a hash of their id and text. A chunk sends each bucket of the hash space one block with its sorted
distinct hashes; the bucket replies to each chunk with one array in the same order. So a hash that a third of all documents
hold costs one entry a chunk, and replies need no hash at all. Chunks and buckets are of bounded size; their number grows with the data.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Chunks, and buckets, that small data have at least, so that all cores share them.
FEWEST = 32
BLOCKS = "chunk int, bucket int, hashes binary, extra binary"
_BLOCKS = pa.schema([("chunk", pa.int32()), ("bucket", pa.int32()), ("hashes", pa.binary()), ("extra", pa.binary())])
REPLIES = "chunk int, bucket int, kind int, reply binary"
_REPLIES = pa.schema([("chunk", pa.int32()), ("bucket", pa.int32()), ("kind", pa.int32()), ("reply", pa.binary())])


def chunked(docs: DataFrame, chunks: int, *by: str) -> DataFrame:
    """Add chunk, by a hash of the columns: of id and text, so that rows without an id, or with one id, spread as others do."""
    return docs.withColumn("chunk", F.pmod(F.xxhash64(*by, F.lit(17)), F.lit(chunks)).cast("int"))


def by_bucket(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of hashes by (bucket, hash), equal ones as they come, and where each bucket starts."""
    b = (hashes >> np.uint64(20)) % np.uint64(buckets)
    order = np.lexsort((hashes, b))
    return order, np.searchsorted(b[order], np.arange(buckets + 1, dtype=np.uint64))


def blocks(chunk: int, hashes: np.ndarray, buckets: int, extra: np.ndarray | None = None) -> pa.Table:
    """Rows that ask about distinct hashes; extra: fixed-size values to go with them."""
    order, cut = by_bucket(hashes, buckets)
    hashes = hashes[order]
    extra = None if extra is None else extra[order]
    full = np.flatnonzero(np.diff(cut))
    return pa.table(
        [
            pa.array(np.full(len(full), chunk, np.int32)),
            pa.array(full.astype(np.int32)),
            pa.array([hashes[cut[i] : cut[i + 1]].tobytes() for i in full], pa.binary()),
            pa.array([None if extra is None else extra[cut[i] : cut[i + 1]].tobytes() for i in full], pa.binary()),
        ],
        schema=_BLOCKS,
    )


def grouped(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(an entry of each group, group of each entry); groups have equal keys and are numbered in the order of the keys, the first one leading."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    return order[new], group


def answered(asked: DataFrame, kind: int, answer: Callable[[np.ndarray, np.ndarray | None], np.ndarray], extra_type=None, second: str | None = None) -> DataFrame:
    """Reply to blocks. answer(group of each entry, extra) gives a bool or byte for each entry.

    Entries of one group have the same hash and, with `second`, the same value of that field of extra.
    """

    def run(t: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("hashes")]
        sizes = np.array([len(x) for x in parts])
        hashes = np.concatenate(parts)
        extra = None if extra_type is None else np.concatenate([np.frombuffer(x.as_buffer(), extra_type) for x in t.column("extra")])
        out = answer(grouped(hashes, *([] if second is None else [extra[second]]))[1], extra)
        pack = (lambda x: np.packbits(x).tobytes()) if out.dtype == bool else (lambda x: x.tobytes())
        ends = np.cumsum(sizes)
        return pa.table([t.column("chunk"), t.column("bucket"), pa.array(np.full(len(sizes), kind, np.int32)), pa.array([pack(out[e - n : e]) for n, e in zip(sizes, ends, strict=True)], pa.binary())], schema=_REPLIES)

    return asked.groupBy("bucket").applyInArrow(run, REPLIES)


def replies(t: pa.Table, kind: int, hashes: np.ndarray, buckets: int, bits: bool = True) -> np.ndarray:
    """A chunk's replies, in the order of its distinct hashes."""
    order, cut = by_bucket(hashes, buckets)
    out = np.zeros(len(hashes), bool if bits else np.uint8)
    for b, k, r in zip(t.column("bucket").to_pylist(), t.column("kind").to_pylist(), t.column("reply"), strict=True):
        if k == kind:
            raw = np.frombuffer(r.as_buffer(), np.uint8)
            n = int(cut[b + 1] - cut[b])
            out[order[cut[b] : cut[b + 1]]] = np.unpackbits(raw, count=n).astype(bool) if bits else raw
    return out


def held_elsewhere(group: np.ndarray, extra) -> np.ndarray:
    """Whether more than one chunk asks about a hash."""
    return np.bincount(group)[group] > 1


def distinct_with_owners(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct hashes, index of each entry's hash, whether two different owners in here hold the hash)."""
    values, index = np.unique(hashes, return_inverse=True)
    low = np.full(len(values), np.iinfo(np.int64).max)
    high = np.full(len(values), np.iinfo(np.int64).min)
    np.minimum.at(low, index, owner)
    np.maximum.at(high, index, owner)
    return values, index, low < high
