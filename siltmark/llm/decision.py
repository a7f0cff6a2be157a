"""Quality rules: a decision list learned from labelled statistics by sequential covering, applied as one Spark expression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, arrow_rows, checkpointed, over_texts, text_bytes, windows_hash, words_of
from .langid import remainder
from .sampling import hash_bound

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_calls", "n_echoes", "n_distinct", "n_other")
_SCHEMA = pa.schema([(c, pa.int64()) for c in ("doc_id", *COUNTS)])
#: Rates that conditions are about: each is one count over another.
RATES = {
    "word_length": ("word_chars", "n_words"), "symbols_a_word": ("n_symbols", "n_words"), "repeated_words": ("n_repeat_words", "n_words"), "repeated_lines": ("n_dup_lines", "n_lines"), "words_a_line": ("n_words", "n_lines"),
    "capitals": ("n_upper", "word_chars"), "calls_a_word": ("n_calls", "n_words"), "echoes": ("n_echoes", "n_words"), "distinct_words": ("n_distinct", "n_words"), "other_characters": ("n_other", "word_chars"), "words": ("n_words", None),
}
RUN = 5
_SYMBOL, _UPPER, _CALL, _OTHER, _START, _INSIDE, _BLANK = range(7)
_KIND = np.full(256, _START)
_KIND[0x80:0xC0] = _INSIDE
_KIND[[b for b in range(0x80) if not chr(b).isalnum()]] = _OTHER
_KIND[list(b"!?")] = _CALL
_KIND[65:91] = _UPPER
_KIND[list(b"#*$%&|<>")] = _SYMBOL
_KIND[list(SPACES)] = _BLANK


def _later_lines(text: bytes) -> tuple[int, int]:
    """(lines with a word, of them those equal to an earlier line)."""
    lines = [x for x in text.split(b"\n") if x.strip(bytes(SPACES))]
    return len(lines), len(lines) - len(set(lines))


def _repeated(h: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """Words of each text in windows of `size` words that it holds twice or more."""
    room = np.maximum(np.diff(first) - size + 1, 0)
    doc = np.repeat(np.arange(len(room)), room)
    starts = first[:-1][doc] + np.arange(len(doc)) - np.repeat(np.cumsum(room) - room, room)
    wh = windows_hash(h, starts, size, 2)
    order = np.lexsort((wh, doc))
    same = (wh[order][1:] == wh[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    twice = np.zeros(len(starts), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    edge = np.zeros(len(h) + 1, np.int32)
    np.add.at(edge, starts[twice], 1)
    np.add.at(edge, starts[twice] + size, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])
    return covered[first[1:]] - covered[first[:-1]]


def _stats(batch: pa.RecordBatch) -> pa.RecordBatch:
    data, offsets = text_bytes(batch.column("text"))
    _, _, h, first = words_of(data, offsets, lower=False)
    n = batch.num_rows
    kinds, lines = np.zeros((n, 7), np.int64), np.zeros((n, 2), np.int64)
    for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        for x in range(a, b, 1 << 20):
            kinds[k] += np.bincount(_KIND[data[x : min(b, x + (1 << 20))]], minlength=7)
        lines[k] = _later_lines(data[a:b].tobytes())
    doc = np.repeat(np.arange(n), np.diff(first))
    order = np.lexsort((h, doc))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    echo = np.zeros(len(h), bool)
    echo[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    return arrow_rows(
        _SCHEMA, doc_id=batch.column("doc_id"), n_words=np.diff(first), word_chars=kinds.sum(1) - kinds[:, _INSIDE] - kinds[:, _BLANK], n_symbols=kinds[:, _SYMBOL], n_dup_lines=lines[:, 1], n_repeat_words=_repeated(h, first, RUN),
        n_lines=lines[:, 0], n_upper=kinds[:, _UPPER], n_calls=kinds[:, _CALL], n_echoes=np.bincount(doc[echo], minlength=n), n_distinct=np.bincount(doc[order[new]], minlength=n), n_other=kinds[:, _OTHER],
    )


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of each whole text; all are 0 for a null or empty one. Code points count as characters, words are runs of other bytes than U+0020 and U+0009 to U+000D."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(over_texts(_stats), ", ".join(f"{c} long" for c in _SCHEMA.names))


def rate(name: str, column=F.col) -> Column:
    """A rate as an expression over the counts; 0 where its divisor is 0."""
    top, below = RATES[name]
    return column(top).cast("double") if below is None else F.when(column(below) > 0, column(top) / column(below)).otherwise(F.lit(0.0))


@dataclass(frozen=True)
class Rule:
    """All of the conditions (rate, whether it must be above, threshold) give the verdict."""

    conditions: tuple[tuple[str, bool, float], ...]
    verdict: float

    def expression(self) -> Column:
        out = F.lit(True)
        for name, above, bound in self.conditions:
            out &= (rate(name) > bound) if above else (rate(name) <= bound)
        return out

    def __str__(self) -> str:
        return " and ".join(f"{name} {'>' if above else '<='} {bound:.6g}" for name, above, bound in self.conditions) + f": {self.verdict:g}"


@dataclass(frozen=True)
class DecisionList:
    """The first rule that holds decides, else the default."""

    rules: tuple[Rule, ...]
    default: float

    def number(self) -> Column:
        """The deciding rule's number from 1; 0 for the default."""
        return self._case([F.lit(k + 1) for k in range(len(self.rules))], F.lit(0))

    def verdict(self) -> Column:
        return self._case([F.lit(float(r.verdict)) for r in self.rules], F.lit(float(self.default)))

    def _case(self, values: list[Column], otherwise: Column) -> Column:
        if not self.rules:
            return otherwise
        out = F.when(self.rules[0].expression(), values[0])
        for rule, value in zip(self.rules[1:], values[1:], strict=True):
            out = out.when(rule.expression(), value)
        return out.otherwise(otherwise)


def _holds(x: np.ndarray, conditions: list[tuple[int, bool, float]]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for k, above, bound in conditions:
        out &= (x[:, k] > bound) == above
    return out


def _best_condition(x: np.ndarray, y: np.ndarray) -> tuple[float, tuple[int, bool, float] | None]:
    """The condition of highest information gain over rows that the rule covers so far; bounds lie halfway between neighbouring values."""
    p, n = int(y.sum()), len(y)
    base = np.log2(p / n)
    best, found = 1e-9, None
    for k in range(x.shape[1]):
        order = np.argsort(x[:, k], kind="stable")
        v, hit = x[order, k], np.cumsum(y[order])
        cut = np.flatnonzero(v[1:] > v[:-1])
        if not len(cut):
            continue
        low_p, low_n = hit[cut], cut + 1
        for above, pos, size in ((False, low_p, low_n), (True, p - low_p, n - low_n)):
            gain = pos * (np.log2(np.maximum(pos, 1e-12) / size) - base)
            i = int(np.argmax(gain))
            if gain[i] > best:
                best, found = float(gain[i]), (k, above, float((v[cut[i]] + v[cut[i] + 1]) / 2))
    return best, found


def grow(x: np.ndarray, y: np.ndarray) -> list[tuple[int, bool, float]]:
    """Add the best condition until the rule covers rows of its class only, or none is better."""
    conditions: list[tuple[int, bool, float]] = []
    while y.any() and not y.all():
        _, condition = _best_condition(x, y)
        if condition is None:
            break
        conditions.append(condition)
        inside = _holds(x, [condition])
        x, y = x[inside], y[inside]
    return conditions


def prune(conditions: list, x: np.ndarray, y: np.ndarray) -> tuple[list, float]:
    """The beginning of the rule that is worth most, (p - n) / (p + n), on rows it was not grown from, the shortest of equals; and its precision there."""
    best, worth, precision = conditions, -2.0, 0.0
    for size in range(1, len(conditions) + 1):
        inside = _holds(x, conditions[:size])
        p, n = int(y[inside].sum()), int(inside.sum())
        value = (2 * p - n) / n if n else -1.0
        if value > worth:
            best, worth, precision = conditions[:size], value, p / n if n else 0.0
    return best, precision


def learn(x: np.ndarray, y: np.ndarray, names: list[str], least_precision: float = 0.9, least_rows: int = 5, most_rules: int = 64) -> DecisionList:
    """Cover the classes one after another, the rarest first; the most frequent one is the default.

    A rule grows on two of three of the rows left and is pruned on the third; it stays if at least `least_precision` of the rows that it covers there, and `least_rows` of all, are of
    its class. Rows that it covers go. x: (rows, rates) in a fixed order, which decides which rows prune.
    """
    classes, counts = np.unique(y, return_counts=True)
    if not len(classes):
        return DecisionList((), 1.0)
    order = classes[np.lexsort((-classes, counts))]
    rules: list[Rule] = []
    for c in order[:-1]:
        while len(rules) < most_rules and (y == c).any():
            third = np.arange(len(y)) % 3 == 2
            hit = y == c
            grown = grow(x[~third], hit[~third])
            if not grown:
                break
            kept, precision = prune(grown, x[third], hit[third])
            inside = _holds(x, kept)
            if precision < least_precision or hit[inside].sum() < max(least_rows, least_precision * inside.sum()):
                break
            rules.append(Rule(tuple((names[k], above, bound) for k, above, bound in kept), float(c)))
            x, y = x[~inside], y[~inside]
    return DecisionList(tuple(rules), float(order[-1]))


def fit(stats: DataFrame, rated: DataFrame, sample_rows: int = 20_000, seed: int = 9, **options) -> DecisionList:
    """Learn from rated rows (doc_id, grade). At most about `sample_rows` rows of statistics, shared by the grades, go to the driver; which ones a hash of id and counts decides.

    Rows without a grade or without a word teach nothing. Without any rated row all verdicts are 1.
    """
    grade = F.col("grade").cast("double")
    known = stats.filter("n_words > 0").join(rated.filter(grade.isNotNull() & ~F.isnan(grade)).select("doc_id", grade.alias("grade")), "doc_id").withColumn("h", F.xxhash64("doc_id", *COUNTS, F.lit(seed)))
    sizes = known.groupBy("grade").count().orderBy("grade").limit(257).collect()
    if len(sizes) > 256:
        raise ValueError("more than 256 different grades: bin them first")
    chosen = F.lit(False)
    for r in sizes:
        chosen |= (F.col("grade") == r["grade"]) & (F.col("h") <= hash_bound(r["count"], sample_rows // len(sizes)))
    rows = known.filter(chosen).dropDuplicates(["h"]).select("h", "grade", *(rate(name).alias(name) for name in RATES)).toPandas().sort_values("h", kind="stable")
    return learn(rows[list(RATES)].to_numpy(float), rows["grade"].to_numpy(float), list(RATES), **options)


def judged(docs: DataFrame, labels: DataFrame, grade_col: str = "quality", at_least: float = 1.0, least_words: int = 10, most_repeats: int = 20, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Statistics of every document, whether it fails the base rules, the number of the learned rule that decides (0: the default), and whether it is kept.

    Base rules: fewer than `least_words` words, or more than `most_repeats` of 100 words in repeated windows of five. Other documents are kept if the decision list's verdict is `at_least`.
    Learned from labels of documents that pass the base rules and whose id's crc32 modulo 5 is not 0 (`held_out` marks the others); of several labels of an id, the highest.
    A null, empty or blank text has no words and fails. Rows without an id are judged like others and teach nothing; repeated rows are each returned; an empty table gives no rows; other
    columns play no part. A rate equal to a bound is not above it. A very long text is worked through in blocks; what stays in memory are its words' hashes and its distinct lines.
    """
    stats = checkpointed(statistics(docs, id_col, text_col))
    rated = labels.filter(F.col(grade_col).isNotNull() & (remainder(F.col("doc_id"), 5) != 0)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(grade_col).alias("grade"))
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeats * F.col("n_words"))
    rules = fit(stats.filter(~failed), rated, **options)
    return stats.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (rules.verdict() >= at_least)).alias("kept"),
        rules.number().alias("rule"), F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"),
    )
