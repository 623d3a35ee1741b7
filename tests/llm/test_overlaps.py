"""Problem 2: the index against plain search, and overlaps against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tinctura.llm import overlaps
from tinctura.llm.fmindex import FMIndex
from tinctura.llm.overlaps import Shard, index_texts, matched, overlap_report, overlap_spans, probes, routes, split_overlaps

text = st.text(alphabet="abcé火", min_size=1, max_size=9)


def distance(a, b):
    d = {(i, j): max(i, j) for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def slip(a, b):
    return matched(a, b) >= 0


@given(text, text)
@settings(max_examples=300, deadline=None)
def test_slip(a, b):
    assert slip(a, b) == (distance(a, b) <= 1)
    if slip(a, b):
        assert len(b) - 1 <= matched(a, b) <= len(b)


@given(st.lists(text, max_size=20), text)
@settings(max_examples=150, deadline=None)
def test_search_and_locate(texts, pattern):
    index = FMIndex(texts)
    low, high = index.search([pattern, "z"])
    found = sorted(index.locate(np.arange(low[0], high[0])).tolist())
    assert found == sorted(i for i, t in enumerate(texts) for k in range(len(t)) if t.startswith(pattern, k)) and low[1] == high[1]


def test_index_of_repeats_and_scripts():
    """Long repeats beyond the letters sorted at once, equal texts, and more scripts than one byte holds."""
    texts = ["ab" * 60, "ab" * 61 + "c", "ab" * 60, "b" * 200] + [chr(0x4E00 + i) + chr(0x430 + i % 30) for i in range(500)]
    index = FMIndex(texts)
    for pattern in ("ab" * 59, "abc", "b" * 150, "baba", texts[77], "中"):
        low, high = index.search([pattern])
        want = sorted(i for i, t in enumerate(texts) for k in range(len(t)) if t.startswith(pattern, k))
        assert sorted(index.locate(np.arange(low[0], high[0])).tolist()) == want


@given(text, text, text, text)
@settings(max_examples=500, deadline=None)
def test_some_probe_is_in_the_texts_of_every_agreeing_pair(a, b, x, y):
    if (slip(a, x) and slip(b, y)) or (slip(a, y) and slip(b, x)):
        assert any(p in t for p in probes(a, b) for t in index_texts(x, y))


def test_hits_of_short_names_do_not_grow():
    """Names of two letters hit only what agrees with them, however many pairs there are."""
    r = random.Random(9)
    name = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    asked = [(name(2), name(2)) for _ in range(50)]
    for n in (2000, 8000):
        pairs = list({(name(2), name(8)) for _ in range(n)})
        shard = Shard(pairs)
        low, high = shard.index.search([p for q in asked for p in probes(*q)])
        assert (high - low).sum() == 0 and not shard.search(*zip(*asked))


def test_routes():
    got = routes({3: 10, 4: 80, 9: 250, 12: 20, 13: 90}, 100)
    assert got == {3: (0, 1), 4: (0, 1), 9: (1, 3), 12: (4, 1), 13: (5, 1)}


EVAL = "eval_id long, input_a string, input_b string, known_outputs array<string>, split string, source string, a int"
CANON = "row_id long, input_a string, input_b string, known_outputs array<string>, split string, outs int"


def worlds(seed, n, m):
    r = random.Random(seed)
    words = ["".join(r.choice("ab1é") for _ in range(r.randint(1, 6))) for _ in range(25)] + [None, "", " - "]
    outs = lambda: r.choice([None, [], [None, ""], [r.choice(words)], [r.choice(words), r.choice(words)]])
    evals = [(i, r.choice(words), r.choice(words), outs(), "dev", "s", 0) for i in range(n)]
    return evals + [(1000 + i, *x[1:]) for i, x in enumerate(evals[:20])], [(i, r.choice(words), r.choice(words), outs(), r.choice(["train", "test"]), 0) for i in range(m)]


@pytest.mark.parametrize(("chars", "least", "task", "parts"), [(10_000_000, 500_000, 250_000, 1000), (300, 1, 20, 1000), (2000, 1, 1000, 20)])
def test_overlaps_match_brute_force(spark, rows, monkeypatch, chars, least, task, parts):
    """In one shard and in many, rows in several parts, frequent pairs split."""
    monkeypatch.setattr(overlaps, "LEAST_CHARS", least)
    monkeypatch.setattr(overlaps, "HOT_PARTS", parts)
    evals, canon = worlds(4, 150, 300)
    evals += [(2000 + i, *evals[5][1:]) for i in range(100)]
    canon += [(1000 + i, "abab1", "b1é", ["ab", "x"], "train", 0) for i in range(60)] + [(2000 + i, *evals[5][1:4], "train", 0) for i in range(40)]
    k = lambda s: "".join(c for c in (s or "").lower() if c.isalnum())
    want = []
    for e in evals:
        for c in canon:
            a, b, x, y = k(e[1]), k(e[2]), k(c[1]), k(c[2])
            if c[4] == "train" and all((a, b, x, y)) and ((slip(a, x) and slip(b, y)) or (slip(a, y) and slip(b, x))):
                if any(k(o) and k(p) and slip(k(o), k(p)) for o in e[3] or [] for p in c[3] or []):
                    want.append((e[0], c[0]))
    got = split_overlaps(spark.createDataFrame(evals, EVAL), spark.createDataFrame(canon, CANON), shard_chars=chars, task_rows=task)
    assert sorted(rows(got)) == sorted(want) and len(want) > 20


def test_long_and_empty(spark, rows):
    long = "".join(random.Random(1).choice("abcdefgh") for _ in range(5000))
    evals = spark.createDataFrame([(1, long, "b", ["c"], "dev", "s", 0)], EVAL)
    canon = spark.createDataFrame([(7, "B", long[:2000] + long[2001:], ["C!"], "train", 0)], CANON)
    assert rows(split_overlaps(evals, canon)) == [(1, 7)]
    assert split_overlaps(evals.limit(0), canon).count() == split_overlaps(evals, canon.limit(0)).count() == 0
    assert Shard([("a", "b")]).search([], []) == [] and Shard([("a", "b")]).search(["b"], ["c"]) == [(0, 0, 1)]
    spans = overlap_spans(evals, canon).first()
    assert (spans.matched, spans.letters) == (5000, 5001)
    report = overlap_report(evals, canon).first()
    assert (report.eval_rows, report.overlapping_rows, report.pairs) == (1, 1, 1)
