"""Problem 3: counts against plain counting, by every way through the operator."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from tinctura.llm import terms


def data(n=400):
    r = random.Random(2)
    vocab = ["fire", "Water", "café", "café", "x1", "火", "İ"] + [f"t{i}" for i in range(5000)]
    say = lambda: r.choice([None, "", "  ", " ".join(r.choice(vocab[:7] if r.random() < 0.6 else vocab) for _ in range(r.randint(1, 6)))])
    return [(i, say(), say(), "clash") for i in range(n)] + [(n, "long " * 20000, None, "clash")]


@pytest.mark.parametrize("bound", [1 << 30, 0])
@pytest.mark.parametrize("held", [512, 1])
def test_counts(spark, monkeypatch, bound, held):
    monkeypatch.setattr(terms, "HELD", held)
    lines = data()
    df = spark.createDataFrame(lines, "obs_id long, output string, input_a string, term string").repartition(3)
    got = {(r.field_name, r.term): (r.occurrences, r.records, r.mark) for r in terms.marked_terms(df, ["output", "input_a"], broadcast_bytes=bound).collect()}
    n, docs = Counter(), Counter()
    import regex

    for _, o, a, _ in lines:
        for f, v in (("output", o), ("input_a", a)):
            found = regex.findall(r"[\p{L}\p{M}\p{N}]+", (v or "").lower())
            n.update((f, t) for t in found)
            docs.update({(f, t) for t in found})
    mark = lambda d: "rare" if d < 3 else "common" if d * 100 > len(lines) else None
    assert got == {k: (n[k], docs[k], mark(docs[k])) for k in n}
    assert got["output", "long"][0] == 20000 and re.fullmatch("rare", got["output", "long"][2])


def test_dictionary_has_no_gaps(spark):
    df = spark.createDataFrame([(f"w{i}",) for i in range(1000)] * 2, "term string").repartition(5)
    got = terms.dictionary(df).orderBy("id").collect()
    assert [r.id for r in got] == list(range(1000)) and [r.term for r in got] == sorted(r.term for r in got)


def test_empty(spark):
    assert terms.marked_terms(spark.createDataFrame([], "output string, input_a string"), ["output", "input_a"]).count() == 0
