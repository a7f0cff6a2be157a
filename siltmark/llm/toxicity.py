"""Toxicity: a bidirectional gated recurrent network with attention pooling over word and character inputs, scoring overlapping windows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bigru import Adam, Params, both, both_back, recurrent, scattered, sigmoid, softmax
from .common import _LOWER, _SPACE, arrow_rows, in_pieces, mix, text_bytes, words_of
from .langid import remainder
from .sampling import by_class

WORDS, CHARS, LONG, WIDTH = 1 << 15, 1 << 12, 1 << 17, 4
#: Inputs of a word: its own row, the mean row of its characters, and the largest odds of six bytes that begin in it or just before it.
INPUTS = 2 * WIDTH + 1
RESULT = "doc_id long, held_out boolean, score double, predicted int"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


@dataclass(frozen=True)
class Model:
    params: Params
    window: int
    slope: float
    shift: float
    empty: float


@dataclass
class Texts:
    """Words of some texts: their buckets, spans, and the buckets of the three characters around each byte and of the six from the one before it."""

    word: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    chars: np.ndarray
    long: np.ndarray


def read(data: np.ndarray, offsets: np.ndarray) -> Texts:
    start, end, hashes, first = words_of(data, offsets, lower=True)
    n = len(data)
    low = np.full(n + 6, 32, np.uint32)
    low[1 : n + 1] = _LOWER[data]
    low[1 : n + 1][_SPACE[data]] = 32
    # around a text there are blanks, whatever lies beside it in the batch
    left = (np.repeat(offsets[1:], np.diff(offsets)) - np.arange(n)).astype(np.int32)
    before = low[:n].copy()
    before[offsets[:-1][offsets[:-1] < n]] = 32
    at = lambda k: low[1 : n + 1] if k == 0 else np.where(left > k, low[1 + k : n + 1 + k], np.uint32(32))
    three = before * np.uint32(0x9E3779B1) + at(0) * np.uint32(0x85EBCA6B) + at(1) * np.uint32(0xC2B2AE35)
    three ^= three >> np.uint32(15)
    three *= np.uint32(0x2C1B3C6D)
    six = before
    for k in range(5):
        six *= np.uint32(0x01000193)
        six ^= at(k)
    six ^= six >> np.uint32(16)
    six *= np.uint32(0x7FEB352D)
    return Texts((mix(hashes, 5) % np.uint64(WORDS)).astype(np.int32), start, end, first, (three >> np.uint32(20)).astype(np.int16), (six >> np.uint32(15)).astype(np.int32))


def inputs(p: Params, t: Texts) -> np.ndarray:
    """(2 * WIDTH, words): the word's own row and the mean row of its characters."""
    if not len(t.word):
        return np.zeros((INPUTS, 0), np.float32)
    bounds = np.empty(2 * len(t.start), np.int64)
    bounds[0::2], bounds[1::2] = t.start, t.end
    out = np.empty((INPUTS, len(t.word)), np.float32)
    size = (t.end - t.start).astype(np.float32)
    for k in range(WIDTH):
        out[k] = p["words"][k][t.word]
        row = np.append(p["chars"][k][t.chars], np.float32(0))
        out[WIDTH + k] = np.add.reduceat(row, bounds)[0::2] / size
    out[2 * WIDTH] = np.maximum.reduceat(np.append(p["long"][t.long], np.float32(0)), bounds)[0::2]
    return out


def windows_of(first: np.ndarray, window: int, step: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of so many words that begin at every step-th word, the last one reaching the text's end: (text, first word, number of words). A text without words has none."""
    n = np.diff(first)
    counts = np.where(n > 0, 1 + np.maximum(0, -(-(n - window) // step)), 0)
    owner = np.repeat(np.arange(len(n)), counts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = first[owner] + nth * step
    return owner, at, np.minimum(window, first[owner + 1] - at)


def _steps(u: np.ndarray, columns: Iterator[np.ndarray], heads: np.ndarray) -> Iterator[np.ndarray]:
    """What heads (k, hidden) say of the state after each step, for projected inputs (3 * hidden, n). Gates divide by 1 + exp(-x), and tanh(x) is 1 - 2 / (1 + exp(2 x)): signs and factors are in the weights."""
    h = u.shape[1]
    u = np.concatenate([-u[: 2 * h], np.float32(2) * u[2 * h :], heads])
    one, two = np.float32(1), np.float32(-2)
    state = None
    with np.errstate(over="ignore"):  # an infinite divisor is right
        for a in columns:
            if state is None:
                n = a.shape[1]
                state, m, zr, g = np.zeros((h, n), np.float32), *(np.empty((k, n), np.float32) for k in (h, 2 * h, len(u)))
                g[:] = 0
            else:
                np.matmul(u, state, out=g)
                yield g[3 * h :]
            np.add(a[: 2 * h], g[: 2 * h], out=zr)
            np.exp(zr, out=zr)
            zr += one
            np.divide(g[2 * h : 3 * h], zr[h:], out=m)
            m += a[2 * h :]
            np.exp(m, out=m)
            m += one
            np.divide(two, m, out=m)
            m += one
            state -= m
            state /= zr[:h]
            state += m
    yield heads @ state


def project(p: Params, x: np.ndarray, which: str) -> np.ndarray:
    """What _steps takes, of each word; the last column is that of no word."""
    w, b = p["i" + which].copy(), p["b" + which].copy()
    for part in (w, b):
        part[: 2 * len(b) // 3] *= np.float32(-1)
        part[2 * len(b) // 3 :] *= np.float32(2)
    return w @ np.concatenate([x, np.zeros((len(x), 1), np.float32)], axis=1) + b[:, None]


def window_logits(p: Params, x: np.ndarray, at: np.ndarray, size: np.ndarray, window: int, batch: int = 4096) -> np.ndarray:
    """One logit for each window: attention over its positions, then a linear unit."""
    out = np.empty(len(at), np.float32)
    for some in (np.flatnonzero(size == window), np.flatnonzero(size != window)):
        for i in range(0, len(some), batch):
            k = some[i : i + batch]
            out[k] = _logits(p, x, at[k], size[k], window)
    return out


def _logits(p: Params, x: np.ndarray, at: np.ndarray, size: np.ndarray, window: int) -> np.ndarray:
    """Of windows in the order of their words. Where most words begin a window, each step takes a slice of the words as it lies, and what begins elsewhere is left out at the end."""
    h = p["uf"].shape[1]
    heads = np.stack([p["attend"], p["out"]])
    whole, n = bool((size == window).all()), int(at[-1] - at[0]) + 1
    if whole and n <= 1.5 * len(at):
        words = slice(int(at[0]), int(at[-1]) + window)
        column = lambda of, k: of[:, k : k + n]
    else:  # only words of these windows, wherever they lie
        n, steps = len(at), np.arange(window)[:, None]
        words, ids = np.unique(np.where(steps < size, at + steps, at), return_inverse=True)
        ids = np.where(steps < size, ids.reshape(window, n), len(words))
        column = lambda of, k: np.take(of, ids[k], axis=1, mode="clip")
    forward, backward = project(p, x[:, words], "f"), project(p, x[:, words], "b")
    ahead = np.empty((window, 2, n), np.float32)
    for k, e in enumerate(_steps(p["uf"], (column(forward, k) for k in range(window)), heads[:, :h])):
        ahead[k] = e
    top, below = np.zeros(n, np.float32), np.zeros(n, np.float32)
    for k, e in zip(range(window - 1, -1, -1), _steps(p["ub"], (column(backward, k) for k in range(window - 1, -1, -1)), heads[:, h:]), strict=True):
        e = e + ahead[k]
        w = np.exp(np.clip(e[0], -30, 30))
        if not whole:
            w *= size > k
        top += w * e[1]
        below += w
    logits = top / below + p["bias"][0]
    return logits if n == len(at) else logits[at - at[0]]


def _learn(p: Params, opt: Adam, t: Texts, at: np.ndarray, size: np.ndarray, y: np.ndarray, window: int, scale: float) -> None:
    """One step of Adam on some windows, by backpropagation through time."""
    steps = np.arange(window)[:, None]
    inside = steps < size
    ids = np.where(inside, at + steps, 0)
    flat = ids.ravel()
    used, back = np.unique(flat, return_inverse=True)
    part = Texts(t.word[used], t.start[used], t.end[used], t.first, t.chars, t.long)
    x = inputs(p, part)[:, back].reshape(INPUTS, window, -1) * inside
    x = x.transpose(1, 0, 2)
    states, saved = both(p["if"] @ x + p["bf"][:, None], p["ib"] @ x + p["bb"][:, None], p, keep=True)
    e = np.einsum("h,thn->tn", p["attend"], states)
    e = np.where(inside, e, np.float32(-30))
    alpha = softmax(e)
    s = np.einsum("h,thn->tn", p["out"], states)
    logit = (alpha * s).sum(0) + p["bias"][0]
    d = (sigmoid(logit) - y) / len(y)
    d_s, d_e = alpha * d, alpha * (s - (alpha * s).sum(0)) * d
    d_e = np.where(inside, d_e, 0).astype(np.float32)
    d_states = p["out"][None, :, None] * d_s[:, None] + p["attend"][None, :, None] * d_e[:, None]
    df, db, grads = both_back(d_states.astype(np.float32), saved, p)
    grads |= {"out": np.einsum("thn,tn->h", states, d_s), "attend": np.einsum("thn,tn->h", states, d_e), "bias": np.array([d.sum()], np.float32)}
    dx = p["if"].T @ df + p["ib"].T @ db
    for k, g in (("f", df), ("b", db)):
        grads["i" + k] = np.einsum("tgn,txn->gx", g, x, optimize=True)
        grads["b" + k] = g.sum((0, 2))
    dx = (dx * inside[:, None]).transpose(1, 0, 2).reshape(INPUTS, -1)
    grads["words"] = scattered(t.word[flat], dx[:WIDTH], WORDS)
    by_word = scattered(back.ravel(), dx[WIDTH : 2 * WIDTH], len(used))
    n = part.end - part.start
    which = np.repeat(np.arange(len(used)), n)
    byte = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + part.start[which]
    grads["chars"] = scattered(t.chars[byte], (by_word / n)[:, which], CHARS)
    opt.step({k: v.astype(np.float32) for k, v in grads.items()}, scale, {"words": 0.1, "chars": 0.3})


def _log_odds(ids: np.ndarray, owner: np.ndarray, y: np.ndarray, size: int) -> np.ndarray:
    """Smoothed log odds of label 1 by how many texts of each label hold an id."""
    pairs = np.unique(ids.astype(np.int64) * len(y) + owner.astype(np.int32))
    held = np.bincount(pairs // len(y), minlength=size)
    toxic = np.bincount(pairs // len(y), weights=y[pairs % len(y)], minlength=size)
    a, b = y.sum(), len(y) - y.sum()
    odds = np.log((toxic + 0.5) / (a + 1)) - np.log((held - toxic + 0.5) / (b + 1))
    return (odds * held / (held + 10)).clip(-3, 3).astype(np.float32)


def fit(
    docs: DataFrame, labels: DataFrame, toxic_rows: int = 900, clean_rows: int = 1100, sample_bytes: int = 1 << 15,
    window: int = 16, hidden: int = 8, rounds: int = 8, rate: float = 0.01, seed: int = 3,
) -> Model:
    """Fit on a bounded sample of docs (doc_id, text) with labels (doc_id, toxic; one row an id): about so many toxic and clean ones, of at most `sample_bytes` characters each.

    Each round picks the most suspicious window of each text (for a clean one also a random one) from those that overlap by half and learns from those; how suspicious a text has to be is set
    by all windows, as they are scored, of every fifth text, from which nothing else is learned.
    """
    marked = labels.select("doc_id", (F.col("toxic") == 1).cast("int").alias("toxic"))
    got = by_class(docs, lambda label, *_: toxic_rows if label else clean_rows, sample_bytes, "doc_id", "text", "toxic", marked)
    rng = np.random.default_rng(seed)
    h = hidden
    p: Params = {"words": rng.normal(0, 0.05, (WIDTH, WORDS)), "chars": rng.normal(0, 0.05, (WIDTH, CHARS)), "uf": recurrent(rng, h), "ub": recurrent(rng, h), "attend": rng.normal(0, 0.3, 2 * h), "out": rng.normal(0, 0.3, 2 * h), "bias": np.zeros(1), "long": np.zeros(LONG)}
    p |= {k: rng.normal(0, 0.5, (3 * h, INPUTS)) for k in ("if", "ib")} | {k: np.zeros(3 * h) for k in ("bf", "bb")}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    y = got["label"].to_numpy(np.float32)
    data, offsets = text_bytes(pa.array(got["text"], pa.string()))
    t = read(data, offsets)
    owner, at, size = windows_of(t.first, window, window // 2)
    if not len(owner) or y.min() == y.max():
        return Model(p, window, 0.0, -4.0 if not len(y) or y.max() == 0 else 4.0, 0.02)
    # every fifth text sets the threshold and teaches nothing else; rows are in the order of their labels
    aside = np.arange(len(y)) % 5 == 4
    if not all((y[~aside] == k).any() and (y[aside] == k).any() for k in (0, 1)):
        aside[:] = False
    word_owner, byte_owner = np.repeat(np.arange(len(y)), np.diff(t.first)), np.repeat(np.arange(len(y)), np.diff(offsets))
    odds = lambda ids, of, size: _log_odds(ids[~aside[of]], np.cumsum(~aside)[of[~aside[of]]] - 1, y[~aside], size)
    p["words"][0] = odds(t.word, word_owner, WORDS)
    p["chars"][0] = 0.5 * odds(t.chars, byte_owner, CHARS)
    p["long"] = odds(t.long, byte_owner, LONG)
    keep = ~aside[owner]
    owner, at, size = owner[keep], at[keep], size[keep]
    opt = Adam({k: v for k, v in p.items() if k != "long"}, rate)
    x = inputs(p, t)
    lead = x[0] + x[2 * WIDTH]
    suspicion = np.array([lead[a : a + n].max() for a, n in zip(at, size, strict=True)])
    texts = np.unique(owner)

    def worst(score: np.ndarray) -> np.ndarray:
        order = np.lexsort((score, owner))
        return order[np.searchsorted(owner[order], texts, "right") - 1]

    lo, hi = np.searchsorted(owner, texts, "left"), np.searchsorted(owner, texts, "right")
    for r in range(rounds):
        top = worst(suspicion)
        other = rng.integers(lo, hi)
        pick = np.concatenate([top, other[y[texts] == 0]])
        rng.shuffle(pick)
        for i in range(0, len(pick), 128):
            k = pick[i : i + 128]
            _learn(p, opt, t, at[k], size[k], y[owner[k]], window, 1 - 0.9 * r / rounds)
        suspicion = window_logits(p, inputs(p, t), at, size, window)
    owner, at, size = windows_of(t.first, window)
    best = np.full(len(y), -np.inf)
    np.maximum.at(best, owner, window_logits(p, inputs(p, t), at, size, window))
    judge = np.isfinite(best) & (aside if aside.any() else True)
    best, yy = best[judge].astype(float), y[judge].astype(float)
    # one logistic unit turns a text's largest logit into a probability, clean texts weighing 17 to 3 as they are more frequent than in the sample
    weight = np.where(yy > 0, 0.15 / max(yy.sum(), 1), 0.85 / max((1 - yy).sum(), 1))
    slope, shift = 1.0, 0.0
    for _ in range(200):
        q = 1 / (1 + np.exp(-np.clip(slope * best + shift, -30, 30)))
        g = weight * (q - yy)
        v = weight * q * (1 - q)
        hess = np.array([[(v * best * best).sum() + 1e-3, (v * best).sum()], [(v * best).sum(), v.sum() + 1e-4]])
        step = np.linalg.solve(hess, [(g * best).sum() + 1e-3 * slope, g.sum()])
        slope, shift = slope - 0.5 * step[0], shift - 0.5 * step[1]
    return Model(p, window, float(max(slope, 0.0)), float(shift), float(min(0.4, yy.mean())))


#: Bytes of a text beyond which it is read in parts.
PART = 1 << 21


def parts_of(text: np.ndarray, window: int, most: int = PART) -> Iterator[tuple[int, int]]:
    """Ranges of bytes, cut at spaces, that together hold every window of words; each begins window + 1 words before the end of the one before, as the last word's inputs reach beyond a cut."""
    start = 0
    while True:
        end = start + most
        while end < len(text) and not _SPACE[text[end]]:
            end += 1
        if end >= len(text):
            yield start, len(text)
            return
        yield start, end
        back, words, inside = end, 0, False
        while back > start and words <= window:  # to the space before so many words
            back -= 1
            blank = bool(_SPACE[text[back]])
            words += inside and blank
            inside = not blank
        if back <= start:  # so few words in so many bytes: the range grows
            most *= 2
        start = back


def window_scores(model: Model, data: np.ndarray, offsets: np.ndarray, last: bool = True) -> np.ndarray:
    """The largest logit of each text's windows, -inf for a text without words. last=False leaves out windows that hold a text's last word."""
    t = read(data, offsets)
    owner, at, size = windows_of(t.first, model.window)
    if not last:
        keep = at + size < t.first[owner + 1]
        owner, at, size = owner[keep], at[keep], size[keep]
    best = np.full(len(offsets) - 1, -np.inf)
    if len(owner):
        np.maximum.at(best, owner, window_logits(model.params, inputs(model.params, t), at, size, model.window))
    return best


def text_scores(model: Model, data: np.ndarray, offsets: np.ndarray, most: int = PART) -> np.ndarray:
    """Probability of each text: that of its most suspicious window, of all that there are. A long text is read in parts that overlap, with the same result; a word is never cut, so memory follows the longest word (about 40 bytes for each of its own)."""
    sizes = np.diff(offsets)
    if sizes.max(initial=0) <= most:
        best = window_scores(model, data, offsets)
    else:
        best = np.full(len(sizes), -np.inf)
        for k, (lo, hi) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            text = data[lo:hi]
            for a, b in parts_of(text, model.window, most):
                best[k] = max(best[k], window_scores(model, text[a:b], np.array([0, b - a]), b == len(text))[0])
    z = 1 / (1 + np.exp(-np.clip(model.slope * np.where(np.isfinite(best), best, 0) + model.shift, -30, 30)))
    return np.where(np.isfinite(best), z, model.empty)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every whole text by all its overlapping windows, one from each word.

    A null text, or one without words, gets a fixed low score. Repeated rows are each returned; an empty table gives no rows; other columns play no part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in in_pieces(batch, "text", 1 << 20):
                s = text_scores(model, *text_bytes(part.column("text")))
                yield arrow_rows(_SCHEMA, doc_id=part.column("doc_id"), held_out=part.column("held_out"), score=s, predicted=(s >= 0.5).astype(np.int32))

    held = F.coalesce(remainder(F.col(id_col), 5) == 0, F.lit(False))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"), F.col(text_col).alias("text")).mapInArrow(run, RESULT)


def detect(docs: DataFrame, labels: DataFrame, **fit_options) -> DataFrame:
    """Fit on labelled rows whose id's crc32 modulo 5 is not 0, then score every document."""
    marked = labels.filter(F.col("toxic").isNotNull() & (remainder(F.col("doc_id"), 5) != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return score(docs, fit(docs, marked, **fit_options))
