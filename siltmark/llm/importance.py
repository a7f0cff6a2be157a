"""Importance resampling towards a target: hashed word runs of a corpus and of target texts, and a weighted draw without replacement."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, checkpointed

#: Bytes of lower-cased text: word bytes (digits, letters, 0x80 and above) as they are, all others a space.
_WORD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Bytes of a text that are split into words at a time.
BLOCK = 1 << 20
RESULT = ("doc_id", "n_features", "weight", "score", "rank")


def words(text: bytes, block: int = BLOCK) -> Iterator[list[bytes]]:
    """Lower-cased words of a text, in order, a block at a time; a block ends between words."""
    at = 0
    while at < len(text):
        to = at + block
        part = text[at:to].translate(_WORD)
        while to < len(text) and b" " not in part:  # a word longer than the block
            part += text[to : to + block].translate(_WORD)
            to += block
        if to < len(text):
            part = part[: part.rfind(b" ")]
        at += len(part) + 1
        if got := part.split():
            yield got


class Ring:
    """Running zlib states of the last `size` starts. Each word extends every state by a space and itself and opens one more, so a word gives the CRCs of all runs that end at it."""

    def __init__(self, size: int):
        self.size, self.states = size, []

    def __call__(self, block: list[bytes]) -> Iterator[int]:
        crc, keep, states = zlib.crc32, self.size - 1, self.states
        if not keep:
            yield from map(crc, block)
            return
        for word in block:
            longer = b" " + word
            states = [crc(longer, s) for s in states[-keep:]]
            states.append(crc(word))
            yield from states
        self.states = states


def words_in(n_features: int, runs: int) -> int:
    """Words of a text with so many runs of 1 to `runs` words: n words have n * runs - runs * (runs - 1) / 2 of them, and fewer than `runs` words n * (n + 1) / 2."""
    short = runs * (runs + 1) // 2
    return (isqrt(8 * int(n_features) + 1) - 1) // 2 if n_features < short else (int(n_features) + runs * (runs - 1) // 2) // runs


def features(text: bytes, runs: int) -> Iterator[np.ndarray]:
    """CRCs of a text's runs of 1 to `runs` words, a block at a time."""
    ring = Ring(runs)
    for block in words(text):
        yield np.fromiter(ring(block), np.int64)


def _texts(batch: pa.RecordBatch, column: str) -> Iterator[bytes]:
    for x in batch.column(column):
        yield bytes(x.as_buffer()) if x.is_valid else b""


def corpus_counts(texts: DataFrame, runs: int, buckets: int, text_col: str = "text") -> DataFrame:
    """(bucket, n) over all texts. A task adds up its own counts, so it sends on one row a bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in _texts(batch, "text"):
                for got in features(text, runs):
                    held += np.bincount(got % buckets, minlength=buckets)
        full = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(held[full])], names=["bucket", "n"])

    return texts.select(F.col(text_col).alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """floor(1000 ln) of how much likelier a bucket is in the target than in the source, both counts raised by one; `buckets` numbers at the driver."""
    s, t = np.zeros(buckets), np.zeros(buckets)
    for counts, into in ((source, s), (target, t)):
        for bucket, n in counts.toPandas().itertuples(index=False):
            into[bucket] = n
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, runs: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each row: the sum of its features' gains."""
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "n_words", "n_features", "weight")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((3, batch.num_rows), np.int64)
            for k, text in enumerate(_texts(batch, "text")):
                for got in features(text, runs):
                    out[1:, k] += len(got), gain[got % len(gain)].sum()
                out[0, k] = words_in(out[1, k], runs)
            yield arrow_rows(schema, doc_id=batch.column("doc_id"), n_words=out[0], n_features=out[1], weight=out[2])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(id_col: str, seed: int) -> Column:
    """floor(1000 times a Gumbel variate) that the id and the seed fix; null without an id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h.cast("double") + 0.5) / F.lit(4294967296.0)))).cast("long")


def numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """Add place = 1, 2, 3... in the order of all rows: ranges are sorted apart, written, and numbered on from the sizes of those before."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    within = F.monotonically_increasing_id()
    laid = checkpointed(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.shiftright(within, 33)).withColumn("nth", within.bitwiseAND(F.lit((1 << 33) - 1))))
    before, bases = 0, []
    for part, n in sorted((r["part"], r["n"]) for r in laid.groupBy("part").agg(F.count("*").alias("n")).collect()):  # a number for each range
        bases.append((part, before))
        before += n
    base = rows.sparkSession.createDataFrame(bases, "part long, base long")
    return laid.join(F.broadcast(base), "part").withColumn("place", F.col("base") + F.col("nth") + 1).drop("part", "nth", "base")


def resample(
    docs: DataFrame, target: DataFrame, runs: int = 1, buckets: int = 10_000, share: tuple[int, int] = (10, 100), least_words: int = 20, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Draw share[0]/share[1] of the documents that have `least_words` words or more, likelier those that look like the target texts.

    Features are runs of 1 to `runs` lower-cased words, hashed to buckets by the CRC of their bytes. A document's weight is the sum of its features' gains, its score the
    weight and a Gumbel variate; the highest scores are drawn (ties: the smaller id, then weight, then features), which draws without replacement by weight.
    Returns doc_id, n_features, weight, score, rank of every row (rank null where not drawn).
    A null, empty or wordless text has no feature and weight 0. Rows with one id are documents of their own with the same variate. A row without an id has no variate: its score and
    rank are null, and it does not count among the documents to draw from. Empty documents give no rows; an empty target makes all gains follow from the corpus alone. Very long texts
    are read a block at a time. Other columns play no part. Broadcast are only the gains, one number a bucket.
    """
    source = corpus_counts(docs, runs, buckets, text_col)
    gain = gains(source, corpus_counts(target, runs, buckets), buckets)
    scored = checkpointed(weighed(docs, gain, runs, id_col, text_col)).withColumn("score", F.col("weight") + noise("doc_id", seed))
    can = (F.col("n_words") >= least_words) & F.col("doc_id").isNotNull()
    placed = numbered(scored.withColumn("can", can), F.desc("can"), F.desc("score"), F.asc("doc_id"), F.desc("weight"), F.desc("n_features"), F.desc("n_words"))
    drawn = placed.filter("can").count() * share[0] // share[1]
    return placed.withColumn("rank", F.when(F.col("can") & (F.col("place") <= drawn), F.col("place"))).select(*RESULT)
