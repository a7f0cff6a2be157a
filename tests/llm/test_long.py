"""Very long texts: every scoring operator in bounded memory, with the results of the whole text."""

import subprocess
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from siltmark.llm import quality, toxicity
from siltmark.llm.common import text_bytes

ROOT = Path(__file__).resolve().parents[2]


def test_quality_features_do_not_hang_on_blocks(monkeypatch):
    texts = ["", "a", "ab", "abc", "The QUICK brown, fox! " * 50, "é" * 333]
    want = quality.features(*text_bytes(pa.array(texts)))
    for block in (1, 2, 3, 7, 64):
        monkeypatch.setattr(quality, "BLOCK", block)
        assert np.array_equal(quality.features(*text_bytes(pa.array(texts))), want)


def test_toxicity_of_parts_is_that_of_the_whole():
    rng = np.random.default_rng(1)
    h, window = 4, 6
    shapes = {"words": (toxicity.WIDTH, toxicity.WORDS), "chars": (toxicity.WIDTH, toxicity.CHARS), "long": (toxicity.LONG,), "if": (3 * h, toxicity.INPUTS), "ib": (3 * h, toxicity.INPUTS), "bf": (3 * h,), "bb": (3 * h,), "uf": (3 * h, h), "ub": (3 * h, h), "attend": (2 * h,), "out": (2 * h,), "bias": (1,)}
    model = toxicity.Model({k: rng.normal(0, 0.4, s).astype(np.float32) for k, s in shapes.items()}, window, 1.5, -0.2, 0.03)
    words = ["w%d" % rng.integers(50) for _ in range(900)]
    texts = [" ".join(words), "  ".join(words[:300]) + "\n", "x" * 700 + " " + " ".join(words[:40]), "y" * 2000, " " * 500, "", "a b", " ".join(words[:7])]
    want = toxicity.text_scores(model, *text_bytes(pa.array(texts)))
    for most in (40, 200, 333, 1024):
        assert np.allclose(toxicity.text_scores(model, *text_bytes(pa.array(texts)), most), want, atol=1e-6), most


@pytest.mark.parametrize("what", ["toxicity", "quality", "decision", "importance"])
def test_a_text_of_64_mb_fits_an_executor(what):
    """In a process of its own: words, one word (of 16 MB for toxicity, which holds the longest word), and blanks, within 2 GB."""
    code = f"""
import resource, sys
sys.path.insert(0, {str(ROOT)!r})
import numpy as np, pyarrow as pa
from siltmark.llm import decision, importance, quality, toxicity
from siltmark.llm.common import text_bytes
rng = np.random.default_rng(1)
h, window = 2, 4
shapes = {{"words": (toxicity.WIDTH, toxicity.WORDS), "chars": (toxicity.WIDTH, toxicity.CHARS), "long": (toxicity.LONG,), "if": (3 * h, toxicity.INPUTS), "ib": (3 * h, toxicity.INPUTS), "bf": (3 * h,), "bb": (3 * h,), "uf": (3 * h, h), "ub": (3 * h, h), "attend": (2 * h,), "out": (2 * h,), "bias": (1,)}}
model = toxicity.Model({{k: rng.normal(0, 0.4, s).astype(np.float32) for k, s in shapes.items()}}, window, 1.5, -0.2, 0.03)
n = 64 << 20
for text in ("some words of a text\\n" * (n // 21), "x" * (n // (4 if {what!r} == "toxicity" else 1)), " " * n):
    data, offsets = text_bytes(pa.array([text]))
    if {what!r} == "toxicity":
        toxicity.text_scores(model, data[: len(data) // (4 if "some" in text else 1)], np.array([0, len(data) // (4 if "some" in text else 1)]))  # a quarter, for time
    elif {what!r} == "quality":
        quality.features(data, offsets)
    elif {what!r} == "decision":
        decision._stats(pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], names=["doc_id", "text"]))
    else:
        sum(len(x) for x in importance.features(data.tobytes(), 2))
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=600)
    assert out.returncode == 0, out.stderr[-1500:]
    assert int(out.stdout.split()[-1]) < 2500, out.stdout


def test_hashes_of_long_words_are_those_of_the_whole():
    from siltmark.llm.common import words_of

    texts = ["a b " + "Xyz" * 400 + " tail", "q" * 999, "xyz" * 400]
    data, offsets = text_bytes(pa.array(texts))
    for lower in (True, False):
        whole = words_of(data, offsets, lower)
        for block in (4, 60, 200):
            got = words_of(data, offsets, lower, block=block)
            assert all(np.array_equal(x, y) for x, y in zip(whole, got, strict=True)), block
    assert words_of(data, offsets, True)[2][2] == words_of(data, offsets, True)[2][-1]
