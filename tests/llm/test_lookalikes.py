"""Problem 5: look-alike characters and emoji."""

from __future__ import annotations

import pytest

from tinctura.llm import lookalikes as L

WORDS = ["water", "planet", "soufflé", "jalapeño", "echo", "silence", "bridge", "of", "frozen", "улитка", "вода", "снежинка", "θάλασσα"]


@pytest.fixture(scope="module")
def reader():
    counts: dict[tuple[str, str, str], int] = {}
    for w in WORDS:
        s, x = L.script(w[0]), f"^{w}$"
        for a, b in zip(x, x[1:]):
            counts[s, a, b] = counts.get((s, a, b), 0) + 5
    return L.Reader(counts)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("wаtеr", "water"), ("Ρⅼɑnеt", "Planet"), ("ѕοufflé", "soufflé"), ("Ｗater", "Water"), ("wa​ter", "water"), ("wa­ter﻿", "water"), ("water of", "water of"),
        ("brіԁɡе", "bridge"), ("wаtеr Ꮲꓡаnеt", "water PLanet"), ("siӏеnсе", "silence"), ("ﬁre", "fire"), ("　", " "), ("", ""),
    ],
)
def test_canonical(reader, text, want):
    assert reader.canonical(text) == want


@pytest.mark.parametrize("text", ["water", "jalapeño", "Café", "улитка", "θάλασσα", "оса", "火山", "сок water", "water сор", "frozen есһо", "two\twords\nhere", "a-b_c!", "雪だるま", "نمی‌خواهم"])
def test_ordinary_text_stays(reader, text):
    assert reader.canonical(text) == text


def test_words_meant(reader):
    assert reader.canonical("Frozen Есһо", {"есһо"}) == "Frozen Echo" and reader.doubtful("frozen Есһо улитка") == [("есһо", "echo")] and reader.doubtful("есһо") == []


@pytest.mark.parametrize("bound", [1 << 24, 0])
def test_words_of_another_script(spark, rows, bound):
    """Read as Latin only where the Latin word is attested and the word itself isn't."""
    lines = ["echo", "frozen echo", "frozen есһо", "cop car", "сор", "water сор", "сок water", "water", "ісе", "ice", None]
    obs = spark.createDataFrame(list(enumerate(lines)), "obs_id long, output string")
    got = {r.output: r.canonical for r in L.canonical_values(obs, "output", bound=bound).collect()}
    assert got["frozen есһо"] == "frozen echo" and {k for k, v in got.items() if k != v} == {"frozen есһо"}


def test_found(spark, rows):
    lines = [
        (1, "water", "🔥"), (2, "wаter", "🏝"), (3, "soufflé", "🏝️"), (4, None, None), (5, "", ""), (6, " ", "​🔥"), (7, "улитка", "🔥‍"), (8, "x" * 9000 + "​", "?"),
        (9, "​", "👨🚀"), (10, "wаter", "👨‍🚀️"), (11, "water\t", "⚪ "), (12, "echo", "🚀"), (2, "wаter", None),
    ]
    obs = spark.createDataFrame([(*x, "clash") for x in lines], "obs_id long, output string, emoji_output string, canonical string")
    ref = spark.createDataFrame([("🔥", False), ("🏝️", False), ("👨‍🚀", False), ("⚪", True)], "emoji string, is_placeholder boolean")
    got = rows(L.lookalikes(obs, ref))
    assert sorted(got) == sorted([(2, "output"), (2, "output"), (8, "output"), (9, "output"), (10, "output"), (2, "emoji_output"), (6, "emoji_output"), (7, "emoji_output"), (10, "emoji_output"), (11, "emoji_output")])
    forms = {r.obs_id: (r.output, r.emoji_output) for r in L.one_form(obs, ref).collect()}
    assert forms[10] == ("water", "👨‍🚀") and forms[4] == (None, None) and forms[6] == (" ", "🔥") and forms[12] == ("echo", "🚀")
    assert L.lookalikes(obs.limit(0), ref).count() == 0
