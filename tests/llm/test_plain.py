"""The scoring operators against plain loops, a position, a window and a text at a time."""

import math

import numpy as np
import pyarrow as pa
from siltmark.llm import jaccard, langid, quality, toxicity
from siltmark.llm.common import text_bytes

TEXTS = ["", "a", "The quick brown fox jumps over it. " * 7, "x" * 65, "é ü 中文 straße", "one two\tthree\n" * 40, "Stop it, you fool! " * 3]


def gru(inputs, u):
    """States of one direction: inputs is a list of 3h vectors."""
    h = u.shape[1]
    at, out = np.zeros(h), []
    for a in inputs:
        g = u @ at
        z, r = (1 / (1 + np.exp(-(a[k * h : (k + 1) * h] + g[k * h : (k + 1) * h]))) for k in (0, 1))
        n = np.tanh(a[2 * h :] + r * g[2 * h :])
        at = z * at + (1 - z) * n
        out.append(at)
    return out


def test_language_probabilities_match_a_loop_over_positions():
    p = langid.train(np.zeros((16, 0), np.int64), np.zeros(0, np.int64), 3, 8, 1, 8, 0.1, 5)
    model = langid.Model(p, ["a", "b", "c"], 16)
    got = langid.pooled(model, *text_bytes(pa.array(TEXTS)), batch=7)
    for text, row in zip(TEXTS, got, strict=True):
        raw, sums = text.encode(), np.zeros(3)
        for i in range(0, len(raw), 16):
            part = list(raw[i : i + 16])
            ids = part + [langid.PAD] * (16 - len(part))
            ahead = gru([p["ef"][:, k].astype(float) for k in ids], p["uf"])
            back = gru([p["eb"][:, k].astype(float) for k in reversed(ids)], p["ub"])[::-1]
            for t in range(len(part)):
                q = np.exp(p["wo"] @ np.concatenate([ahead[t], back[t]]) + p["bo"])
                sums += q / q.sum()
        assert np.allclose(row, sums / max(len(raw), 1), atol=2e-5)


def test_toxicity_scores_match_a_loop_over_windows():
    rng = np.random.default_rng(1)
    h, window = 4, 6
    shapes = {"words": (toxicity.WIDTH, toxicity.WORDS), "chars": (toxicity.WIDTH, toxicity.CHARS), "long": (toxicity.LONG,), "if": (3 * h, toxicity.INPUTS), "ib": (3 * h, toxicity.INPUTS), "bf": (3 * h,), "bb": (3 * h,), "uf": (3 * h, h), "ub": (3 * h, h), "attend": (2 * h,), "out": (2 * h,), "bias": (1,)}
    p = {k: rng.normal(0, 0.4, s).astype(np.float32) for k, s in shapes.items()}
    model = toxicity.Model(p, window, 1.5, -0.2, 0.03)
    got = toxicity.text_scores(model, *text_bytes(pa.array(TEXTS)))
    for text, score in zip(TEXTS, got, strict=True):
        t = toxicity.read(*text_bytes(pa.array([text])))
        x = toxicity.inputs(p, t).astype(float)
        n = len(t.word)
        assert n == len(text.split())
        logits = []
        for at in range(max(n - window, 0) + 1) if n else []:
            cols = [x[:, k] if k < n else np.zeros(toxicity.INPUTS) for k in range(at, at + window)]
            ahead = gru([p["if"] @ c + p["bf"] for c in cols], p["uf"])
            back = gru([p["ib"] @ c + p["bb"] for c in reversed(cols)], p["ub"])[::-1]
            both = [np.concatenate(s) for s in zip(ahead, back, strict=True)][: n - at]
            w = np.exp([p["attend"] @ s for s in both])
            logits.append(float((w * [p["out"] @ s for s in both]).sum() / w.sum() + p["bias"][0]))
        want = 1 / (1 + math.exp(-(1.5 * max(logits) - 0.2))) if logits else 0.03
        assert abs(score - want) < 1e-4, (text, score, want)


def test_quality_features_and_tails_match_a_loop_over_texts():
    x = quality.features(*text_bytes(pa.array(TEXTS)))
    model = quality.Model(np.random.default_rng(2).normal(size=quality.WIDTH).astype(np.float32), np.array([-0.3, 0.4]), [0.0, 1.0, 2.0])
    above = quality.tails(model, x)
    for k, text in enumerate(TEXTS):
        raw, words = text.encode(), [w.lower() for w in text.split()]
        counts = {}
        for i in range(len(raw)):
            three = raw[i : i + 3]
            v = (three[0] * 0x9E3779B1 + three[1] * 0x85EBCA6B + three[2] * 0xC2B2AE35) % 2**32 if len(three) == 3 else 0
            v ^= v >> 15
            v = v * 0x2C1B3C6D % 2**32
            counts[v >> 20] = counts.get(v >> 20, 0) + 1
        row = np.zeros(quality.WIDTH)
        for b, c in counts.items():
            row[b] = math.log1p(c)
        row /= max(np.linalg.norm(row), 1e-6)
        row[quality.HASHED] = sum(a == b for a, b in zip(words, words[1:], strict=False)) / max(len(words), 1)
        row[quality.HASHED + 1] = len(set(words)) / math.sqrt(max(len(words), 1)) / 10
        row[quality.HASHED + 2] = sum(65 <= b <= 90 for b in raw) / max(len(raw), 1)
        row[quality.HASHED + 3] = sum(33 <= b <= 47 for b in raw) / max(len(raw), 1)
        row[quality.HASHED + 4] = math.log1p(len(words)) / 10
        assert np.allclose(x[k], row, atol=1e-5), text
        z = row @ model.weights - model.cuts
        assert np.allclose(above[k], 1 / (1 + np.exp(-z)), atol=1e-5)


def test_documents_that_share_a_frequent_template_make_few_candidates(spark):
    template = " ".join(f"t{k}" for k in range(88))
    rows = [(k, template + " " + " ".join(f"u{k}x{j}" for j in range(26))) for k in range(400)]
    rows += [(1000 + k, " ".join(f"n{k // 2}y{j}" for j in range(60)) + f" end{k}") for k in range(40)]  # pairs that do link
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen = []
    whole = jaccard._candidates

    def counted(lists, percent):
        out = whole(lists, percent)
        seen.append(out.count())
        return out

    jaccard._candidates = counted
    try:
        got = {r.doc_id: r.component_id for r in jaccard.join(docs, rounds=()).collect()}
    finally:
        jaccard._candidates = whole
    assert all(got[k] == k for k in range(400)) and all(got[1000 + k] == 1000 + k - k % 2 for k in range(40))
    assert seen and sum(seen) < 20 * len(rows)
