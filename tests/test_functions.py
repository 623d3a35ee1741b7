"""Text, quality, hash and vector functions against hand-computed values and small Python models."""

from __future__ import annotations

import hashlib
import json
import math

import pytest
from pyspark.sql import functions as F

from tinctura.functions import concepts as C, hashing as H, text as X, vectors as V
from tinctura.plans import texts, training


def one(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(column).first()[0]


@pytest.mark.parametrize(
    ("text", "want"),
    [("  Lava \t SHARK\n", "lava shark"), ("a  b", "a b"), ("", ""), (None, None)],
)
def test_concept(spark, text, want):
    assert one(spark, X.concept(F.col("x").cast("string")), x=text) == want
    assert one(spark, X.answer(F.col("x").cast("string")), x=text) == (want or "")


def test_words_and_forms(spark):
    assert one(spark, X.word_count("x"), x=" two  words ") == 2
    assert one(spark, X.word_count("x"), x="  ") == 0
    assert one(spark, X.compact("x"), x="Jack-o' Lantern") == "jackolantern"
    assert one(spark, X.slug("x"), x=" Big 20K!") == "big_20k"
    assert one(spark, X.storage_segment(F.lit(None).cast("string"))) == "anonymous"
    assert one(spark, X.reject_reason("x"), x="Too Vague") == "too_vague"
    assert one(spark, X.human_duration("x"), x=3723) == "1h02m03s"
    assert [one(spark, X.human_duration("x"), x=v) for v in (-3.0, 0.5, 1.5, 59.6, 3599.5)] == ["0s", "0s", "2s", "1m00s", "1h00m00s"]
    assert [one(spark, X.human_size("x"), x=v) for v in (2000, 1_000_000, 999, 1500, 0)] == ["2k", "1000k", "999", "1500", "0"]
    assert one(spark, X.generated_concept("x", 0), x="a b c d e") == "a b c d e"


def test_prompts(spark):
    """Spans cut exactly the concept and the rationale out of the text, whatever the order."""
    for why, first in ((None, False), ("", True), ("they mix 火", False), ("they mix 火", True)):
        r = one(spark, X.prompt_spans("a", "b", "o", F.col("w").cast("string"), rationale_first=first), a="fire", b="wåter", o="steam", w=why)
        assert r.text[r.start : r.end] == "steam" and r.text[r.rationale_start : r.rationale_end] == (why or "")
        assert r.text.startswith("Input A: fire\nInput B: wåter\n" + ("Rationale: " if why and first else "Final concept: "))
    assert one(spark, X.chat_prompt("a", "b"), a="x", b="y").endswith("Concept A: x\nConcept B: y\n\nReturn only the resulting concept.")


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Poisoned animal model with a long tail", "Poisoned animal model"), ("poisoned animal model for lead poisoning animal model.\nRationale: because...", "poisoned animal model"),
        ("clockwork watch with clockwork timer or", "clockwork watch"), ("of mice", ""), ("fire-and-ice", "fire"), ("fire - water", "fire water"), ("a, b, c", "a b c"), ("Sand (wet)", "Sand"), ("candy forest", "candy forest"), ("_x_ -y-", "x y"),
        ("clockwork watch. It ticks", "clockwork watch"),
        ("**steam** and more", "steam"),
        (None, ""),
        ("-_ fog, ", "fog"),
    ],
)
def test_generated_concept(spark, text, want):
    assert one(spark, X.generated_concept(F.col("x").cast("string")), x=text) == want


def test_replies(spark):
    cases = {
        '<think>hm</think>\n<|im_start|>\n"Concept: Steam"\nextra': "steam", "'\nResulting  concept :\n Big  Fog ": "big fog", "<think>open\nx": "<think>open", "concept:": "", "`Concept: a`": "a", 'Concept: "Steam"': '"steam',
        "“Fog”": "“fog”", "<THINK>a\nb</Think> Ice": "ice",
    }
    for reply, want in cases.items():
        assert one(spark, X.model_concept("x"), x=reply) == want
    assert one(spark, X.without_fence("x"), x='```json\n{"a": 1}\n```') == '{"a": 1}'
    assert one(spark, X.outer_object("x"), x='so {"a": {"b": 1}} ok') == '{"a": {"b": 1}}'
    assert one(spark, X.outer_object("x"), x="none") is None
    assert one(spark, X.without_thoughts("x"), x="<think>open") == ""


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("bricknado", "suspicious_suffix"), ("werewolf surfing", "gerund_phrase"), ("Titanic 3: Wipeout", "title_or_sentence_like"), ("F0I", "has_digit"), ("a", "short_token"),
        ("undefined dead lifeform", "placeholder_token"), ("lava shark", None), ("messi", None), ("star wars", None), ("usa", None), ("", "empty"), (None, "empty"), ("x" * 40, "too_long"),
        ("a#b", "hard_symbol"), ("12.5%", "numeric"), ("fire fire", "repeated_token"), ("one two three four", "too_many_words"), ("!", "title_or_sentence_like"), ("—", "no_word_tokens"),
        ("fish with legs", "sentence_like"), ("brrr zzzz", "vowelless_token"),
    ],
)
def test_concept_defect(spark, text, want):
    assert one(spark, C.concept_defect(F.col("x").cast("string")), x=text) == want


def test_recipe_defect(spark):
    assert one(spark, C.recipe_defect("a", "b", "c"), a="fire", b="water", c="fire") == "identity"
    assert one(spark, C.recipe_defect("a", "b", "c"), a="fire", b="wat3r", c="steam") == "input_b:has_digit"
    assert one(spark, C.recipe_defect("a", "b", "c"), a="fire", b="water", c="steam") is None


@pytest.mark.parametrize(("text", "want"), [("fire", False), ("0x", True), ("404", True), ("1,000", True), ("?", True), ("a+b", True), ("", True), (None, True), ("é", False)])
def test_garbage(spark, text, want):
    assert one(spark, C.is_garbage(F.col("x").cast("string")), x=text) is want


def test_split_and_ids(spark):
    digest = hashlib.sha256(b"fire+water").hexdigest()
    assert one(spark, H.stable_bucket("x"), x="fire+water") == int(digest[:12], 16) % 10_000 == 8606
    assert one(spark, H.split_of("a", "b"), a="fire", b="water") == "dev"
    assert one(spark, H.canonical_pair_id("a", "b"), a="wåter", b="fire") == hashlib.sha256(json.dumps(["fire", "wåter"], ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


@pytest.mark.parametrize("text", ["", "fire", "jalapeño", "🌋 lava"])
def test_fnv(spark, text):
    h = 2166136261
    data = text.encode("utf-16-be")
    for i in range(0, len(data), 2):
        h = ((h ^ int.from_bytes(data[i : i + 2])) * 16777619) % 2**32
    assert one(spark, H.fnv1a("x"), x=text) == h
    assert one(spark, H.lcg(H.fnv1a("x")), x=text) == (h * 1664525 + 1013904223) % 2**32


@pytest.mark.parametrize("n", [0, 1, 63, 64, 4095, 123456789])
def test_packed_ids(spark, n):
    code = one(spark, H.packed_id(F.col("x").cast("long")), x=n)
    assert one(spark, H.unpacked_id("x"), x=code) == n
    assert len(code) == max(1, math.ceil(math.log(n + 1, 64)))


def test_creativity(spark):
    two = lambda *v: F.array(*[F.array(*map(F.lit, x)) for x in v])
    got = one(spark, V.creativity(two((1.0, 0.0), (1.0, 1.0)), two((1.0, 0.0), (0.0, 1.0)), F.array(F.lit(0.2), F.lit(0.8))))
    want = {"plausibility_distance": 0.146446615, "plausibility_score": 0.926776707, "novelty": 0.5, "diversity_distance": 0.292893231, "diversity_score": 0.146446615}
    assert {k: pytest.approx(v, abs=1e-6) for k, v in want.items()} == {k: got[k] for k in want}
    novelty = one(spark, V.mean_distances(two((1.0, 0.0), (1.0, 1.0)), two((1.0, 0.0), (0.0, 1.0))))
    assert novelty == [pytest.approx(0.25), pytest.approx(0.14644662)]
    assert one(spark, V.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0.0
    assert one(spark, V.cosine_matrix(two((1.0, 0.0), (0.0, 0.0)), two((1.0, 0.0), (0.0, 1.0)))) == [[1.0, 0.0], [0.0, 0.0]]
    assert one(spark, V.distance_matrix(two((1.0, 0.0)), two((2.0, 0.0), (0.0, 1.0), (0.0, 0.0)))) == [[0.0, 1.0, 1.0]]
    assert one(spark, V.min_distances(two((1.0, 0.0), (1.0, 1.0)), two((1.0, 0.0), (0.0, 1.0)))) == [0.0, pytest.approx(0.29289322)]
    assert one(spark, V.mean_pairwise_distance(two((1.0, 0.0)))) == 0.0


def test_whole_titles(spark, tmp_path):
    """Rules that hold only beyond the fourth word."""
    titles = {1: "one more day at the harbour with old friends", 2: "a b c d; e", 3: "who is in the: end", 4: "a b c d e", 5: "misty lake", 6: None}
    spark.createDataFrame(list(titles.items()), "doc_id long, title string").write.parquet(str(tmp_path / "documents.parquet"))
    want = {1: "too_long", 2: "hard_symbol", 3: "title_or_sentence_like", 4: "too_many_words", 5: None, 6: "empty"}
    assert {r.doc_id: r.reason for r in texts.title_quality(spark, str(tmp_path)).collect()} == want


def test_words_use_all_embeddings(spark, tmp_path):
    words = [f"w{i}" for i in range(20)]
    spark.createDataFrame([(i, [float(i)] * 64) for i in range(1000)], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    spark.createDataFrame([(w, None, None) for w in words], "prediction string, sampled_outputs array<string>, known_outputs array<string>").write.parquet(str(tmp_path / "predictions.parquet"))
    want = {w: float(int(hashlib.sha256(w.encode()).hexdigest()[:8], 16) % 1000) for w in words}
    assert {r.text: r.vector[0] for r in training._embedded(spark, str(tmp_path)).collect()} == want and max(want.values()) >= 500
