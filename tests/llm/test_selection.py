"""Importance resampling, quality rules and tokenizer alignment against plain versions, and on odd inputs."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import compare
import numpy as np
import pytest

from siltmark.llm import align, decision, importance, packing
from siltmark.llm.common import words_of
from siltmark.llm.queries import QUERIES, SQL, tokenizer_files
from siltmark.session import table

SF = "/root/testdata/sf0.001"
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, score double, rank string, weight int, pairs string, chunk int"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def odd_texts():
    rng = random.Random(7)
    vocab = ["The", "élan", "Über", "a1", "it's", "x" * 40, "ı", "日本語", "data-set", "ＡＢ", "#", "$$", "A", "é"]
    texts = [None, "", " ", "\n\t", "one", "One one ONE", "a b c d e a b c d e", "a a a a a a", "x\ny\nx\n\n \nx", "<|endoftext|> <s> </s> <0x0A>", "▁a ▁▁ b", "tab\tnul\x00 end", " a b", "z" * 3000 + " y"]
    texts += [" ".join(rng.choice(vocab) for _ in range(n)) for n in (5, 19, 20, 21, 60, 400, 400)]
    texts += ["  ".join(rng.choice(vocab) + rng.choice(["", "\n", ".", "!!"]) for _ in range(300)), "word " * 40_000, "é" * 5000]
    return texts


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts; repeated rows, one id with two texts, rows without an id; extra columns whose names clash."""
    rows = [(k, t) for k, t in enumerate(odd_texts())]
    rows += [rows[19], rows[19], (20, "another text under one id " * 9), (None, "no id " * 30), (None, "no id " * 30), (None, None)]
    return spark.createDataFrame([(k, t, 0.5, "r", 3, "p", 1) for k, t in rows], DOCS).repartition(5)


def plain_draw(docs, target, runs, buckets, share, least, seed):
    def grams(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))
        return len(w), [" ".join(w[i : i + n]) for n in range(1, runs + 1) for i in range(len(w) - n + 1)]

    place = lambda x: zlib.crc32(x.encode()) % buckets
    s, t = Counter(), Counter()
    for texts, into in (([x for _, x in docs], s), (target, t)):
        for x in texts:
            into.update(map(place, grams(x)[1]))
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (total_s + buckets) / ((s[b] + 1) * (total_t + buckets))))
    rows = []
    for k, x in docs:
        n, g = grams(x)
        weight = sum(gain(place(f)) for f in g)
        h = None if k is None else int(hashlib.sha256(f"{seed}:{k}".encode()).hexdigest()[:8], 16)
        rows.append([k, len(g), weight, None if k is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    can = sorted((r for r in rows if r[5] >= least and r[0] is not None), key=lambda r: (-r[3], r[0], -r[2], -r[1]))
    for i, r in enumerate(can[: len(can) * share[0] // share[1]]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


def test_importance_query_gives_the_rows_of_its_sql(spark):
    assert compare.differences(QUERIES["op11_importance"](spark, SF), SQL["op11_importance"], compare.connection(SF)) == ""


@pytest.mark.parametrize("runs", [1, 2, 4])
def test_importance_matches_a_plain_draw(spark, odd, runs):
    target = ["The élan", "data set a1 a1", None, ""]
    got = importance.resample(odd, spark.createDataFrame([(x,) for x in target], "text string"), runs=runs, buckets=97, share=(50, 100), seed=5)
    want = plain_draw([(r.doc_id, r.text) for r in odd.collect()], target, runs, 97, (50, 100), 20, 5)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want


def test_ring_reads_words_in_blocks():
    text = ("Ab,c " * 50 + "q" * 90 + " tail\x00é").encode()
    whole = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text.decode()).encode())
    for block in (1, 7, 64, 1 << 20):
        assert [w for part in importance.words(text, block) for w in part] == whole
    for runs in (1, 2, 5):
        want = Counter(zlib.crc32(b" ".join(whole[i : i + n])) for n in range(1, runs + 1) for i in range(len(whole) - n + 1))
        got = [c for part in importance.features(text, runs) for c in part.tolist()]
        assert Counter(got) == want and importance.words_in(len(got), runs) == len(whole)
    assert all(importance.words_in(sum(max(n - k, 0) for k in range(r)), r) == n for n in range(12) for r in (1, 2, 3, 6))


def test_importance_of_empty_tables(spark, odd):
    empty = odd.limit(0)
    assert importance.resample(empty, odd).collect() == []
    assert {r["rank"] for r in importance.resample(odd, empty.select("text")).collect()} >= {None, 1}


def plain_stats(text):
    text = text or ""
    w = SPACED.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if SPACED.search(line):
            dup += line in seen
            seen.add(line)
    runs = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    inside = {k for i in range(len(w) - 4) if runs[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


def test_quality_statistics_match_plain_counts(spark, odd):
    texts = Counter((r.doc_id, plain_stats(r.text)) for r in odd.collect())
    got = Counter((r.doc_id, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)) for r in decision.statistics(odd).collect())
    assert got == texts
    docs = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    rows = QUERIES["op12_quality_rules"](spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        s = plain_stats(docs[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == s
        assert r.base_failed == (s[0] < 10 or 100 * s[4] > 20 * s[0]) and not (r.base_failed and r.kept)


def test_quality_rules_hold_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    quality = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect()}
    rows = [r for r in QUERIES["op12_quality_rules"](spark, sf).collect() if r.held_out and not r.base_failed and quality.get(r.doc_id) is not None]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    good = [r.kept for r in rows if quality[r.doc_id] == 1]
    poor = [r.kept for r in rows if quality[r.doc_id] == 0]
    assert sum(good) >= 0.99 * len(good) and sum(poor) <= 0.1 * len(poor)


def test_covering_finds_planted_conjunctions_and_prunes_noise():
    rng = np.random.default_rng(3)
    x = rng.random((4000, 6))
    y = np.where((x[:, 1] > 0.7) & (x[:, 4] <= 0.3), 0.0, np.where(x[:, 2] > 0.95, 2.0, 1.0))
    flip = rng.random(4000) < 0.01
    rules = decision.learn(x, np.where(flip, 1.0, y), list("abcdef"), least_precision=0.85)
    assert rules.default == 1.0 and len(rules.rules) <= 6
    assert {n for r in rules.rules for n, *_ in r.conditions} == set("bce") and {r.verdict for r in rules.rules} == {0.0, 2.0}
    verdict = np.full(4000, rules.default)
    for r in reversed(rules.rules):
        verdict[decision._holds(x, [("abcdef".index(n), above, b) for n, above, b in r.conditions])] = r.verdict
    assert (verdict == y).mean() > 0.98


def test_decision_list_expression_is_ordered(spark):
    rules = decision.DecisionList((decision.Rule((("words", False, 20.0),), 3.0), decision.Rule((("words", False, 30.0), ("capitals", True, 0.5)), 2.0)), 1.0)
    rows = spark.createDataFrame([(20, 100, 90), (21, 100, 51), (21, 100, 50), (30, 0, 0), (40, 9, 9)], "n_words long, word_chars long, n_upper long")
    assert [tuple(r) for r in rows.select(rules.verdict(), rules.number()).collect()] == [(3.0, 1), (2.0, 2), (1.0, 0), (1.0, 0), (1.0, 0)]
    assert str(rules.rules[1]) == "words <= 30 and capitals > 0.5: 2"


def test_quality_rules_without_labels_or_rows(spark, odd):
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    rows = decision.judged(odd, labels).collect()
    assert len(rows) == odd.count() and all(r.kept != r.base_failed for r in rows)
    assert decision.judged(odd.limit(0), labels).collect() == []


def test_words_of_cuts_long_texts_at_spaces():
    texts = ["a  b " * 500, "", "q" * 900 + " r", "", "x y"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    want = [SPACED.findall(t) for t in texts]
    for block in (3, 64, 1 << 18):
        s, e, _, first = words_of(data, offsets, lower=False, block=block)
        assert [[bytes(data[s[i] : e[i]]).decode() for i in range(first[k], first[k + 1])] for k in range(len(texts))] == want


def plain_alignment(rows, a, b):
    """Expected rows of the alignment, token by token."""
    per, count = [], Counter()
    for k, text in rows:
        ia, ib = (a.encode(text), b.encode(text)) if text else ([], [])
        if not text or any(b"".join(side.table[i] for i in ids) != (" " + text).encode() for side, ids in ((a, ia), (b, ib))):
            per.append((k, 0, 0, [], [], ""))
            continue
        ends = [np.cumsum([len(side.table[i]) for i in ids]).tolist() for side, ids in ((a, ia), (b, ib))]
        groups, links, x, y = [], [], 0, 0
        for c in sorted(set(ends[0]) & set(ends[1])):
            p, q = [], []
            while x < len(ia) and ends[0][x] <= c:
                p.append(ia[x])
                x += 1
            while y < len(ib) and ends[1][y] <= c:
                q.append(ib[y])
                y += 1
            groups.append(",".join(map(str, p)) + "|" + ",".join(map(str, q)))
            links.append((p[-1], q[-1]))
        count.update(links)
        per.append((k, len(ia), len(ib), groups, links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = defaultdict(int)
    for (_, q), n in count.items():
        best[q] = max(best[q], n)
    return sorted(((k, n_a, n_b, len(g), len(li), sum(count[x] == best[x[1]] for x in li), sum(count[x] for x in li), sha) for k, n_a, n_b, g, li, sha in per), key=str)


@pytest.mark.parametrize("span", [16, 1 << 16])
def test_alignment_matches_a_plain_sweep(spark, odd, span):
    sides = align.public_sides()
    got = sorted((tuple(r) for r in align.align(odd, *sides, span=span).collect()), key=str)
    want = plain_alignment([(r.doc_id, r.text) for r in odd.collect()], sides[0](), sides[1]())
    assert got == want
    assert sum(w[1] == 0 for w in want) >= 4  # null, empty, and texts that hold the piece model's space mark


def test_alignment_query_matches_a_plain_sweep(spark):
    sides = align.public_sides()
    got = sorted((tuple(r) for r in QUERIES["op13_alignment"](spark, SF).collect()), key=str)
    assert got == plain_alignment([(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()], sides[0](), sides[1]())


def test_alignment_of_an_empty_table(spark, odd):
    assert align.align(odd.limit(0), *align.public_sides()).collect() == []


def test_sweep_keeps_its_pairs_when_they_are_many(monkeypatch):
    monkeypatch.setattr(align, "HELD", 10)
    s = align.Sweep((np.array([1, 2]), np.array([1, 2])), align.marked(2))
    for k in range(50):
        s.take(0, 2 * k, np.array([0, 0]))
        s.take(1, 2 * k, np.array([1]) if k % 2 else np.array([0, 0]))
    assert s.groups == 75 and [x.tolist() for x in s.pairs()] == [[0, 1], [50, 25]]


@pytest.mark.parametrize("text", [" " * 2_000_000, "\t" * 1_200_000, "\n" * 1_200_000, "a" * 1_000_000, "ab " * 400_000, "a  b\n" * 100_000], ids=["blanks", "tabs", "lines", "letters", "words", "gaps"])
def test_very_long_texts_have_the_ids_of_the_tokenizer(text):
    from tokenizers import Tokenizer

    files = tokenizer_files()
    want = Tokenizer.from_file(files[0]).encode(text, add_special_tokens=False).ids
    assert packing.token_ids(packing.encoder(*files), text).tolist() == want


def test_segments_give_the_tokens_of_the_text():
    a, b = (s() for s in align.public_sides())
    for text in filter(None, odd_texts()):
        for most in (3, 50):
            parts = list(packing.segments(text, most))
            assert " ".join(parts) == text
            if "▁" not in text:
                assert [i for p in parts for i in b.encode(p)] == b.encode(text)
            assert [i for p in parts for i in a.encode(p)] == a.encode(text)
