"""Quality grading by ordinal cumulative-link regression on hashed text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, in_pieces, text_bytes, words_of
from .langid import remainder
from .sampling import by_class

HASHED, SHAPES = 1 << 12, 5
WIDTH = HASHED + SHAPES
RESULT = "doc_id long, held_out boolean, expected_grade double, tail_probability double, selected boolean"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("expected_grade", pa.float64()), ("tail_probability", pa.float64()), ("selected", pa.bool_())])


@dataclass(frozen=True)
class Model:
    """P(grade > grades[k]) = logistic(weights . x - cuts[k]), cuts ascending."""

    weights: np.ndarray
    cuts: np.ndarray
    grades: list[float]


#: Bytes of text that are hashed at a time.
BLOCK = 1 << 20


def _three(data: np.ndarray) -> np.ndarray:
    """Buckets of all three bytes in a row."""
    low = data.astype(np.uint32)
    three = low[:-2] * np.uint32(0x9E3779B1) + low[1:-1] * np.uint32(0x85EBCA6B) + low[2:] * np.uint32(0xC2B2AE35)
    three ^= three >> np.uint32(15)
    three *= np.uint32(0x2C1B3C6D)
    return (three >> np.uint32(20)).astype(np.int64)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, WIDTH): hashed three-byte counts (logarithms, unit length) and a few shapes of the whole text. Long texts are read a block at a time."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    counts, capitals, marks = np.zeros((n, HASHED)), np.zeros(n), np.zeros(n)
    for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        for at in range(a, b, BLOCK):
            part = data[at : min(b, at + BLOCK + 2)]
            counts[k] += np.bincount(_three(part), minlength=HASHED)
            own = part[:BLOCK]
            capitals[k] += np.count_nonzero((own >= 65) & (own <= 90))
            marks[k] += np.count_nonzero((own >= 33) & (own <= 47))
    counts[:, 0] += np.minimum(size, 2)  # the last two bytes begin no three
    x = np.zeros((n, WIDTH), np.float32)
    x[:, :HASHED] = np.log1p(counts)
    x[:, :HASHED] /= np.maximum(np.linalg.norm(x[:, :HASHED], axis=1, keepdims=True), 1e-6)
    _, _, word, first = words_of(data, offsets, lower=True)
    words = np.diff(first)
    owner = np.repeat(np.arange(n), words)
    size = np.maximum(size, 1)
    share = lambda flags, of, total: np.bincount(of, weights=flags, minlength=n) / np.maximum(total, 1)
    again = np.zeros(len(word), bool)
    again[1:] = (word[1:] == word[:-1]) & (owner[1:] == owner[:-1])
    order = np.lexsort((word, owner))
    new = np.ones(len(word), bool)
    new[1:] = (word[order][1:] != word[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    x[:, HASHED] = share(again, owner, words)
    x[:, HASHED + 1] = np.bincount(owner[order[new]], minlength=n) / np.sqrt(np.maximum(words, 1)) / 10
    x[:, HASHED + 2] = capitals / size
    x[:, HASHED + 3] = marks / size
    x[:, HASHED + 4] = np.log1p(words) / 10
    return x


def tails(model: Model, x: np.ndarray) -> np.ndarray:
    """(texts, grades - 1): probability of a grade above each but the last."""
    z = (x @ model.weights)[:, None] - model.cuts[None, :]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, grades: int, rounds: int = 400, rate: float = 0.05, ridge: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending cuts by gradient steps on the likelihood of the observed grade; the gaps between cuts are exponentials, so they stay ordered."""
    w, a = np.zeros(x.shape[1], np.float32), np.zeros(grades - 1)
    share = np.array([(y > k).mean() for k in range(grades - 1)]).clip(1e-3, 1 - 1e-3)
    start = -np.log(share / (1 - share))
    a[0] = start[0]
    a[1:] = np.log(np.maximum(np.diff(start), 1e-2))
    mw, vw, ma, va = np.zeros_like(w), np.zeros_like(w), np.zeros_like(a), np.zeros_like(a)
    rows = np.arange(len(y))
    for t in range(1, rounds + 1):
        cuts = np.cumsum(np.concatenate([a[:1], np.exp(a[1:])]))
        above = 1 / (1 + np.exp(-np.clip((x @ w)[:, None] - cuts, -30, 30)))
        full = np.concatenate([np.ones((len(y), 1)), above, np.zeros((len(y), 1))], axis=1)
        p = np.maximum(full[rows, y] - full[rows, y + 1], 1e-9)
        slope = np.concatenate([np.zeros((len(y), 1)), above * (1 - above), np.zeros((len(y), 1))], axis=1)
        dz = -(slope[rows, y] - slope[rows, y + 1]) / p
        gw = (x.T @ dz.astype(np.float32)) / len(y) + ridge * w
        dc = np.zeros((len(y), grades + 1))
        dc[rows, y] += slope[rows, y] / p
        dc[rows, y + 1] -= slope[rows, y + 1] / p
        gc = dc[:, 1:-1].mean(0)
        later = np.cumsum(gc[::-1])[::-1]
        ga = np.concatenate([later[:1], later[1:] * np.exp(a[1:])])
        for g, m, v, target in ((gw, mw, vw, w), (ga, ma, va, a)):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            target -= (rate * (1 - 0.8 * t / rounds)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-7)
    return w, np.cumsum(np.concatenate([a[:1], np.exp(a[1:])]))


def fit(docs: DataFrame, grades: DataFrame, sample_rows: int = 2000, sample_bytes: int = 1 << 15) -> Model:
    """Fit on a bounded sample of docs (doc_id, text) with grades (doc_id, grade; one row an id): about `sample_rows` in all, as the grades are distributed but 100 of each, of at most `sample_bytes` characters each."""
    got = by_class(docs, lambda _, share, __: max(100, round(sample_rows * share)), sample_bytes, "doc_id", "text", "grade", grades.select("doc_id", F.col("grade").cast("double").alias("grade")))
    grades = sorted({float(g) for g in got["label"]})
    if len(grades) < 2:
        return Model(np.zeros(WIDTH, np.float32), np.zeros(0), grades or [0.0])
    x = np.concatenate([features(*text_bytes(pa.array(got["text"][i : i + 200], pa.string()))) for i in range(0, len(got), 200)])
    w, cuts = train(x, np.array([grades.index(float(g)) for g in got["label"]]), len(grades))
    return Model(w, cuts, grades)


def grade(docs: DataFrame, model: Model, at_least: float | None = None, chance: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Expected grade of each whole text, the probability of a grade of `at_least` (the best one by default), and whether that reaches `chance`.

    A null or empty text is graded as an empty one. With fewer than two grades to learn from, all texts have that grade. Repeated rows are each returned;
    an empty table gives no rows; other columns play no part.
    """
    target = model.grades[-1] if at_least is None else at_least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in in_pieces(batch, "text", 1 << 20):
                for i in range(0, part.num_rows, 256):
                    rows = part.slice(i, 256)
                    above = tails(model, features(*text_bytes(rows.column("text"))))
                    full = np.concatenate([np.ones((len(above), 1)), above], axis=1)
                    expected = model.grades[0] + above @ np.diff(model.grades)
                    k = int(np.searchsorted(model.grades, target, "left"))
                    tail = full[:, k] if k < len(model.grades) else np.zeros(len(full))
                    yield arrow_rows(_SCHEMA, doc_id=rows.column("doc_id"), held_out=rows.column("held_out"), expected_grade=expected, tail_probability=tail, selected=tail >= chance)

    held = F.coalesce(remainder(F.col(id_col), 5) == 0, F.lit(False))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"), F.col(text_col).alias("text")).mapInArrow(run, RESULT)


def select(docs: DataFrame, labels: DataFrame, grade_col: str = "quality", **options) -> DataFrame:
    """Fit on rated rows whose id's crc32 modulo 5 is not 0, then grade every document."""
    rated = labels.filter(F.col(grade_col).isNotNull() & (remainder(F.col("doc_id"), 5) != 0)).groupBy("doc_id").agg(F.max(grade_col).alias("grade"))
    return grade(docs, fit(docs, rated), **options)
