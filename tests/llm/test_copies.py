"""Problems 1 and 4: copies and survivors, against brute force."""

from __future__ import annotations

import datetime
import random
import re
from collections import defaultdict

import pytest

from tinctura.llm import copies, survivors

OBS = "obs_id long, input_a string, input_b string, output string, emoji_output string, source string, observed_at timestamp_ntz, h1 string, k_out int"
TRUST = "source string, trust int"
EMOJI = "emoji string, is_placeholder boolean"


def at(day):
    return day and datetime.datetime(2024, 1, day)


def obs(spark, *lines):
    return spark.createDataFrame([(*x, "clash", 1) for x in lines], OBS)


def fuzz(n, seed=3):
    r = random.Random(seed)
    words = ["fire", "Water", "café", "mud", "Ｗater", None, "", " ", "?!", "x" * 3000]
    shape = [str, str.upper, lambda s: f" {s}. ", lambda s: "-".join(s)]
    pick = lambda: (w := r.choice(words)) and r.choice(shape)(w)
    return [(i, pick(), pick(), pick(), r.choice(["🔥", "🔥️", "⚪", None, "x"]), r.choice(["a", "b", "zz", None]), at(r.choice([None, 1, 2, 3]))) for i in range(n)]


def key(s):
    return re.sub(r"[\W_]", "", (s or "").lower())


def groups(lines):
    out = defaultdict(list)
    for x in lines:
        k = (key(x[3]), *sorted((key(x[1]), key(x[2]))))
        if all(k):
            out[k].append(x)
    return [g for g in out.values() if len(g) > 1]


@pytest.mark.parametrize("bits", [128, 3])
def test_copies_match_brute_force(spark, rows, bits):
    lines = fuzz(800)
    want = sorted((min(x[0] for x in g), y[0]) for g in groups(lines) for y in g if y[0] != min(x[0] for x in g))
    got = rows(copies.hidden_copies(obs(spark, *lines), hash_bits=bits))
    assert sorted(got) == want and len(want) > 50


def test_collapsed_counts_every_row(spark):
    lines = fuzz(500)
    got = copies.collapsed(obs(spark, *lines)).collect()
    assert sum(r.n_copies for r in got) == sum(all((key(x[1]), key(x[2]), key(x[3]))) for x in lines)


def test_empty_table(spark):
    empty = obs(spark)
    trust, emoji = spark.createDataFrame([], TRUST), spark.createDataFrame([], EMOJI)
    assert copies.hidden_copies(empty).count() == copies.collapsed(empty).count() == 0
    assert survivors.best_rows(empty, trust, emoji).count() == survivors.voted_values(empty, trust, emoji).count() == 0


@pytest.mark.parametrize(("digits", "factor", "shift"), [(38, 1, 0), (3, 1, 0), (38, -1, 5), (38, 1 << 52, 0)])
def test_survivors_match_brute_force(spark, rows, digits, factor, shift):
    """With votes as numbers and as structs; obs_id negative, and so far apart that only structs hold them."""
    lines, trusted = [(x[0] * factor - shift, *x[1:]) for x in fuzz(800, 5)], {"a": 2, "b": -1}
    never = datetime.datetime(1, 1, 1)
    want = []
    for g in groups(lines):
        t = lambda x: trusted.get(x[5], 0)
        seen = lambda x: x[6] or never
        out = min(g, key=lambda x: (-(seen(x) - never).total_seconds(), -t(x), x[0]))
        shown = [x for x in g if x[4] in ("🔥", "🔥️")]
        emoji = min(shown, key=lambda x: (-t(x), -(seen(x) - never).total_seconds(), x[0]))[0] if shown else 0
        source = min(g, key=lambda x: (-t(x), x[6] is None, seen(x), x[0]))
        want.append((min(x[0] for x in g), out[0], emoji, source[0]))
    got = survivors.best_rows(obs(spark, *lines), spark.createDataFrame([("a", 2), ("b", -1), (None, 9)], TRUST), spark.createDataFrame([("🔥", False), ("⚪", True)], EMOJI), vote_digits=digits)
    assert rows(got) == sorted(want, key=repr)


def test_votes(spark):
    lines = [(1, "a1", "b1", "Steam", None, "low", at(2)), (2, "b1", "a1", "steam", None, "low", at(2)), (3, "a1", "b1", "STEAM ", "🔥", "high", at(1)), (4, "q", "r", "s", None, None, None)]
    got = {r.first_obs_id: r for r in survivors.voted_values(obs(spark, *lines), spark.createDataFrame([("high", 5)], TRUST), spark.createDataFrame([("🔥", False)], EMOJI)).collect()}
    assert (got[1].n_copies, got[1].source, got[1].emoji_output) == (3, "high", "🔥") and got[4].source is None
