"""Language identification: a bidirectional gated recurrent network over bytes labels every position of a text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bigru import Adam, Params, both, both_back, recurrent, scattered, softmax, walk
from .common import arrow_rows, in_pieces, text_bytes
from .sampling import by_class

#: Input symbol of positions past the end of a text.
PAD = 256
RESULT = "doc_id long, held_out boolean, lang_pred string, score double"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])


@dataclass(frozen=True)
class Model:
    params: Params
    classes: list[str]
    window: int


def remainder(id_col: Column, of: int) -> Column:
    """crc32 of the id's decimal text, modulo `of`."""
    return F.crc32(id_col.cast("string").cast("binary")) % of


def windows_of(data: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cut texts into windows: (text of each window, its start, its length). Every byte is in exactly one."""
    sizes = np.diff(offsets)
    counts = -(-sizes // window)
    owner = np.repeat(np.arange(len(sizes)), counts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = offsets[owner] + nth * window
    return owner, start, np.minimum(window, offsets[owner + 1] - start)


def symbols(data: np.ndarray, start: np.ndarray, length: np.ndarray, window: int) -> np.ndarray:
    """(window, n) input symbols, PAD past a window's end."""
    at = start[None, :] + np.arange(window)[:, None]
    if length.min(initial=window) == window:
        return data[at].astype(np.intp)
    return np.where(np.arange(window)[:, None] < length[None, :], data[np.minimum(at, len(data) - 1)], np.intp(PAD))


def projected(table: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """(steps, rows of table, n) from a table with one column for each symbol."""
    return np.ascontiguousarray(np.take(table, ids, axis=1).transpose(1, 0, 2))


def position_probabilities(p: Params, ids: np.ndarray):
    """Class probabilities (classes, n) of each position, from the last one to the first."""
    h = len(p["uf"]) // 3
    ahead = np.empty((len(ids), len(p["wo"]), ids.shape[1]), np.float32)
    for t, state in enumerate(walk(p["ef"], p["uf"], ids)):
        np.matmul(p["wo"][:, :h], state, out=ahead[t])
    bias = p["bo"][:, None]
    for t, state in zip(range(len(ids) - 1, -1, -1), walk(p["eb"], p["ub"], ids[::-1]), strict=True):
        q = p["wo"][:, h:] @ state
        q += ahead[t]
        q += bias
        np.minimum(q, np.float32(80), out=q)
        np.exp(q, out=q)
        q /= q.sum(0)
        yield t, q


def train(windows: np.ndarray, labels: np.ndarray, classes: int, hidden: int, steps: int, batch: int, rate: float, seed: int) -> Params:
    """Fit by backpropagation through time. windows: (length, n) symbols; each position of a window has its text's label."""
    rng = np.random.default_rng(seed)
    p: Params = {
        "ef": rng.normal(0, 0.3, (3 * hidden, PAD + 1)).astype(np.float32), "eb": rng.normal(0, 0.3, (3 * hidden, PAD + 1)).astype(np.float32),
        "uf": recurrent(rng, hidden), "ub": recurrent(rng, hidden),
        "wo": rng.normal(0, 0.3, (classes, 2 * hidden)).astype(np.float32), "bo": np.zeros(classes, np.float32),
    }
    if classes < 2 or not windows.shape[1]:
        return p
    # each class as often as another
    of = [np.flatnonzero(labels == k) for k in range(classes)]
    of = [x for x in of if len(x)]
    opt = Adam(p, rate)
    for i in range(steps):
        pick = np.concatenate([rng.choice(x, batch // len(of) + 1) for x in of])
        ids, y = windows[:, pick], labels[pick]
        states, saved = both(projected(p["ef"], ids), projected(p["eb"], ids), p, keep=True)
        t, w, n = states.shape
        flat = states.transpose(1, 0, 2).reshape(w, t * n)
        inside = (ids != PAD).ravel().astype(np.float32)
        d = softmax(p["wo"] @ flat + p["bo"][:, None])
        d[np.tile(y, t), np.arange(t * n)] -= 1
        d *= inside / max(inside.sum(), 1)
        d_states = np.ascontiguousarray((p["wo"].T @ d).reshape(w, t, n).transpose(1, 0, 2))
        df, db, grads = both_back(d_states, saved, p)
        grads |= {"wo": d @ flat.T, "bo": d.sum(1)}
        for k, g in (("ef", df), ("eb", db)):
            grads[k] = scattered(ids.ravel(), g.transpose(1, 0, 2).reshape(g.shape[1], -1), PAD + 1)
        opt.step(grads, 1 - 0.9 * i / steps)
    return p


def fit(
    rows: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample_rows: int = 600, least_rows: int = 40, sample_bytes: int = 1 << 15,
    windows: int = 40, window: int = 64, hidden: int = 8, steps: int = 260, batch: int = 160, rate: float = 0.02, seed: int = 1,
) -> Model:
    """Fit on a bounded sample of labelled rows: about `sample_rows` in all, shared evenly by the languages, but `least_rows` of each.

    Of a row count at most `sample_bytes` characters and, of those, at most `windows` windows.
    """
    got = by_class(rows, lambda _, _share, languages: max(least_rows, sample_rows // languages), sample_bytes, id_col, text_col, lang_col)
    classes = sorted(set(got["label"]))
    rng = np.random.default_rng(seed)
    xs, ys = [], []
    for text, lang in zip(got["text"], got["label"], strict=True):
        data, offsets = text_bytes(pa.array([text]))
        _, start, length = windows_of(data, offsets, window)
        if len(start) > windows:
            keep = np.sort(rng.choice(len(start), windows, replace=False))
            start, length = start[keep], length[keep]
        xs.append(symbols(data, start, length, window))
        ys.append(np.full(len(start), classes.index(lang)))
    x = np.concatenate(xs, axis=1) if xs else np.zeros((window, 0), np.int64)
    y = np.concatenate(ys) if ys else np.zeros(0, np.int64)
    return Model(train(x, y, len(classes), hidden, steps, batch, rate, seed), classes, window)


def pooled(model: Model, data: np.ndarray, offsets: np.ndarray, batch: int = 4096) -> np.ndarray:
    """(texts, classes): mean over a text's positions of the position's class probabilities; zeros for an empty text."""
    owner, start, length = windows_of(data, offsets, model.window)
    sums = np.zeros((len(model.classes), len(offsets) - 1))
    for i in range(0, len(owner), batch):
        s, n = start[i : i + batch], length[i : i + batch]
        by_window = np.zeros((len(model.classes), len(s)), np.float32)
        whole = n.min() == model.window
        for t, q in position_probabilities(model.params, symbols(data, s, n, model.window)):
            by_window += q if whole else q * (n > t)
        for k in range(len(model.classes)):
            sums[k] += np.bincount(owner[i : i + batch], weights=by_window[k], minlength=sums.shape[1])
    return (sums / np.maximum(np.diff(offsets), 1)).T


def judged(model: Model, text: pa.Array, letter: np.ndarray) -> tuple[list[str], np.ndarray]:
    """(language, score) of each text; `und` and 0 for one without a letter, or from a model without classes."""
    if not model.classes:
        return ["und"] * len(text), np.zeros(len(text))
    q = pooled(model, *text_bytes(text))
    best = q.argmax(1)
    score = np.where(letter, np.clip(q[np.arange(len(q)), best], 0, 1), 0.0)
    return [model.classes[k] if ok else "und" for k, ok in zip(best, letter, strict=True)], score


def has_letter(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Predict each whole text's language.

    Every byte position gets class probabilities from the window it lies in; a text's are their mean, score the largest.
    A null text, or one without a letter, is `und` with score 0, as is every text when the model has no class. Repeated rows are each
    returned; an empty table gives no rows; other columns play no part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in in_pieces(batch, "text", 2 << 20):
                names, score = judged(model, part.column("text"), part.column("letter").to_numpy(zero_copy_only=False).astype(bool))
                yield arrow_rows(_SCHEMA, doc_id=part.column("doc_id"), held_out=part.column("held_out"), lang_pred=names, score=score)

    held = F.coalesce(remainder(F.col(id_col), 3) == 1, F.lit(False))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"), F.col(text_col).alias("text"), has_letter(text_col).alias("letter")).mapInArrow(run, RESULT)


def recognised(docs: DataFrame, model: Model, least: float, text_col: str = "text") -> DataFrame:
    """The rows, in the input's columns, whose text has a language with a score of `least` or more; each row is judged by its own text where it lies, so none moves.

    A null text, or one without a letter, has none. Repeated rows stay or go alike; an empty table gives no rows.
    """
    at, own = docs.columns.index(text_col), docs.schema
    letter = next(n for n in ("_letter" + "_" * k for k in range(len(docs.columns) + 1)) if n not in docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).astype(bool)
            start = 0
            for part in in_pieces(batch, batch.schema.names[at], 2 << 20):
                names, score = judged(model, part.column(at), known[start : start + part.num_rows])
                start += part.num_rows
                keep = [n != "und" and s >= least for n, s in zip(names, score, strict=True)]
                yield pa.RecordBatch.from_arrays(part.columns[:-1], schema=pa.schema(list(part.schema)[:-1])).filter(pa.array(keep, pa.bool_()))

    return docs.select("*", has_letter(text_col).alias(letter)).mapInArrow(run, own)


def detect(docs: DataFrame, **fit_options) -> DataFrame:
    """Fit on the rows whose id's crc32 modulo 3 is not 1, then label every row."""
    return identify(docs, fit(docs.filter(remainder(F.col("doc_id"), 3) != 1), **fit_options))
