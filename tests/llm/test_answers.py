"""Problem 6: defects of predictions."""

from __future__ import annotations

import pytest

from tinctura.llm import answers
from tinctura.llm.answers import English, defect, defects

A, B = "frozen windmill", "smoky river of glass"


@pytest.fixture(scope="module")
def english():
    return English([A, B, "ancient turquoise planet", "café of mustard", "jalapeño", "water", "bridge", "lantern of chocolate", "burning sapphire", "gigantic orchestra", "silver mountain", "rain", "stone"])


@pytest.mark.parametrize(
    ("answer", "want"),
    [
        (None, "empty"), ("", "empty"), (" ​\n", "empty"), ("--", "empty"), ("N/A", "empty"), ("null", "empty"), ("{}", "empty"), ("[]", "empty"), ('{"result": ""}', "empty"), ('""', "empty"), ('{"result": null}', "empty"),
        ("I'm sorry, but I can't combine these.", "refusal"), ("I really cannot help with that", "refusal"), ("Request declined.", "refusal"), ('{"result": "As an AI, I must decline."}', "refusal"), ("i cant do this", "refusal"),
        (A, "copy"), (A.upper() + "!", "copy"), (f"{B} + {A} = ?", "copy"), ("frozen-windmill with smoky-river-of-glass", "copy"), (f"What do you get when you combine {A} and {B}?", "copy"), ("frozenwindmill", "copy"),
        ('{"result": "frozen windmill"}', "copy"), (f"Concept A: {A}\nConcept B: {B}", "copy"),
        ("I do not believe I can respond to that.", "refusal"), ("That request falls outside what I do", "refusal"), ("It would be inappropriate for me to combine them.", "refusal"), ("My instructions forbid it.", "refusal"), ("There is no answer I can give.", "refusal"), ("No comment.", "refusal"), ("I will not.", "refusal"),
        ("No Comment", None), ("Against My Better Judgement", None), ("Sorry But True", None), ("Request Denied", None), ("water. Nothing else could do it.", None),
        (f"{A}, smoky glass of river", "copy"), ("smoky glass river", None), ("the windmill, frozen", None), ("river, smoky", None), (f"smoky ... river of ... glass and {A}", "copy"),
        ("{'result': '', 'why': '" + "x" * 20_000 + "'}", "empty"), ("{'result': 'Frozen Windmill', 'why': '" + "x" * 20_000 + "', 'ok': True}", "copy"), ("{'result': 'it\\'s a \"river\"',}", None),
        ('{"a": ' * 40 + '"frozen windmill"' + "}" * 40, "copy"), ('[[[[[["water"]]]]]]', None), ('[[[[[[""]]]]]]', "empty"),
        ("火の鳥", "other_language"), ("старый корабль", "other_language"), ("la réponse est miroir", "other_language"), ("Das Ergebnis ist Dampf.", "other_language"), ("chuva de pedras", "other_language"),
        ("zimowy ogień", "other_language"), ('{"result": "una corona di cenere"}', "other_language"),
        (f"The result of {A} and {B} is", "truncated"), ("water. Heat and then", "truncated"), ('{"result": "wat', "truncated"), ('{"result": "water"', "truncated"), ("water (made when the", "truncated"),
        ("When two rivers meet, people think of wa", "truncated"), (f"Heat from {A} works on", "truncated"), ("Frozen windm", "truncated"), (f"{A} hol", "truncated"), ("It cannot burn...", "truncated"), ("water...", None),
        ("water", None), ("  Ancient Planet\n", None), ("Answer: water", None), ("water (my first guess)", None), ("water. It cannot burn, so they simply turn to water.", None), ('{"result": "water", "emoji": "💧"}', None),
        ("A player sorry to lose rain still gains stone!", None), ("jalapeño", None), ("café of mustard", None), ("burning frozen windmill", None), ("windmill", None), ("stone of rain", None),
    ],
)
def test_defect(english, answer, want):
    assert defect(answer, A, B, english) == want


def test_no_inputs(english):
    assert defect("water", None, None, english) is None and defect("water", "", " ", english) is None


def test_table(spark, rows):
    lines = [(1, None, A, B), (2, "water", A, B), (3, A, A, B), (3, A, A, B), (4, "water " * 50_000, A, None), (5, "[" * 5000, A, B)]
    df = spark.createDataFrame([(*x, "clash") for x in lines], "prediction_id long, prediction string, input_a string, input_b string, defect string").drop("defect")
    got = rows(defects(df))
    assert (1, "empty") in got and got.count((3, "copy")) == 2 and 2 not in [g[0] for g in got]
    assert defects(df.limit(0)).count() == 0


@pytest.mark.parametrize("bound", [1 << 24, 0])
def test_words_of_all_prompts_are_known(spark, rows, bound):
    """Whatever row the letter model is fitted on, the words of the others aren't taken for broken ones."""
    lines = [(1, "stone lantern", "stone", "rain"), (2, "stone rain", "stone", "lantern"), (5, "stone turq", "stone", "rain"), (5, None, "stone", "rain")]
    df = spark.createDataFrame(lines, "prediction_id long, prediction string, input_a string, input_b string")
    assert rows(defects(df, fit_rows=1, bound=bound)) == rows(defects(df, bound=bound)) == [(5, "empty"), (5, "truncated")]


@pytest.mark.parametrize("bound", [1 << 24, 0])
def test_prompts_of_all_rows_are_fitted(spark, rows, bound):
    """Words that stand in the prompt of one row among many look English, wherever that row stands; others don't."""
    mine = ["zimowy ogień", "stary młyn", "zielony chleb", "cichy dzwon", "biały księżyc", "czarny węgiel"]
    lines = [(9000 + i, w, "stone", "rain") for i, w in enumerate([*mine, "żółty liść"])] + [(9100 + i, "lantern", w, "rain") for i, w in enumerate(mine)]
    many = spark.range(9000).selectExpr("id as prediction_id", "'lantern' as prediction", "'stone lantern' as input_a", "'rain' as input_b")
    df = many.unionByName(spark.createDataFrame(lines, "prediction_id long, prediction string, input_a string, input_b string"))
    assert rows(defects(df, bound=bound)) == [(9006, "other_language")]


def test_joined_scores_are_the_models(spark):
    """The scores of the joined way equal those of the model on the workers, for words of many scripts."""
    prompts = [(1, None, A, B), (2, None, "jalapeño stone", "火の鳥 stone"), (3, None, "stone 12", None)]
    df = spark.createDataFrame(prompts, "prediction_id long, prediction string, input_a string, input_b string")
    words = answers._fitted_words(df)
    asked = ["stone", "stony", "火の山", "é", "zimowy", "the", "smokywind"]
    english = English([x for p in prompts for x in p[2:] if x])
    held = spark.createDataFrame([(w,) for w in asked], "word string")
    for bound in (1 << 24, 0):
        got = {r.word: r.score for r in answers._scores(held, words, answers._trigrams(words), bound).collect()}
        assert got == {w: pytest.approx(english.score(w), abs=1e-6) for w in asked}
    counted = English.counted([r.word for r in words.collect()], {r.gram: r.n for r in answers._trigrams(words).collect()})
    assert counted.fitted == english.fitted and all(counted.score(w) == pytest.approx(english.score(w), abs=1e-6) for w in asked)
