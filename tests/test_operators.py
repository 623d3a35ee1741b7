"""Relational operators against hand-computed results."""

from __future__ import annotations

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from tinctura.operators import arena as A, canonical as S, enrich as N, evaluate as E, graph as G, skew, weights as W
from tinctura.plans import arena, graphs

OBS = "obs_id long, input_a string, input_b string, output string, emoji_a string, emoji_b string, emoji_output string, source string"


def obs(spark, *lines):
    return spark.createDataFrame([(i, *x) for i, x in enumerate(lines)], OBS)


def test_canonical_pairs_mode_and_ties(spark):
    df = obs(
        spark,
        ("Water", "fire", "Steam", None, "🔥", "⚪", "a"), ("fire", "water", "mist", "🔥", None, "🌫️", "b"), ("fire", "water ", "steam", "🕯️", None, "💨", ""),
        ("fire", "water", "fog", None, None, None, None), (None, "x", "y", None, None, None, "a"), ("fire", "water", "fire", None, None, None, "a"),
    )
    got = S.canonical_pairs(df).collect()
    assert len(got) == 1
    r = got[0]
    assert (r.input_a, r.input_b, r.known_outputs, r.observation_counts, r.canonical_output) == ("fire", "water", ["fog", "mist", "steam"], [1, 1, 2], "steam")
    assert (r.emoji_a, r.known_emojis, r.sources, r.split, r.status, r.is_conflicting_pair) == ("🔥", ["⚪", "🌫️", "💨"], ["a", "b"], "dev", "keep", True)
    loose = S.canonical_pairs(df, S.Cleaning(quality=None)).first()
    assert "fire" in loose.known_outputs


def test_first_output_to_arrive_wins_a_tie(spark):
    df = obs(spark, ("a1x", "b", "zebra", None, None, None, "s"), ("a1x", "b", "ape", None, None, None, "s"))
    assert S.canonical_pairs(df, S.Cleaning(garbage=False, quality=None)).first().canonical_output == "zebra"
    same = obs(spark, ("water", "fire", "water", None, None, None, "s"))
    assert S.canonical_pairs(same, S.Cleaning(quality=None)).first().status == "review_identity"


def test_untrusted_vocabulary(spark):
    df = obs(spark, ("fire", "water", "steam", None, None, None, "good"), ("fire", "water", "steam", None, None, None, "bad"), ("fire", "water", "fog", None, None, None, "bad"))
    c = S.Cleaning(untrusted=("bad",), trusted=("good",))
    assert {(r.pos, r.reason) for r in S.judged(df, c).collect()} == {(0, None), (1, None), (2, "untrusted_source_vocab")}


def test_empty_observations(spark):
    empty = obs(spark)
    assert S.canonical_pairs(empty).count() == 0
    assert S.validation_report(empty).first().num_observations == 0


def test_shares_and_merging(spark):
    one = spark.createDataFrame([("r", 0, "steam", 1, None), ("r", 1, "mist", 2, None)], "k string, position int, output string, rank int, weight double")
    assert {r.output: r.share for r in W.normalized(one, ["k"]).collect()} == {"steam": pytest.approx(2 / 3), "mist": pytest.approx(1 / 3)}
    two = spark.createDataFrame([("r", 0, "steam", 1, 0.6), ("r", 1, "vapor", 2, 0.4), ("r", 2, "steam", 1, 0.2), ("r", 3, "mist", 2, 0.8)], one.schema)
    assert {r.output: r.share for r in W.merged(two, ["k"]).collect()} == {"steam": pytest.approx(0.4), "vapor": pytest.approx(0.2), "mist": pytest.approx(0.4)}
    bad = spark.createDataFrame([("r", 0, "x", 1, -1.0)], one.schema)
    assert W.normalized(bad, ["k"]).first().share is None


def test_losses(spark):
    df = spark.createDataFrame([(0, -1.0, 0.9), (0, -2.0, 0.1), (1, -0.5, 1.0)], "g int, lp double, w double")
    loss = lambda uniform, lse, d=df: d.transform(lambda x: W.group_losses(x, "g", "lp", "w", uniform=uniform, logsumexp=lse)).agg(F.avg("loss")).first()[0]
    assert loss(True, False) == pytest.approx(1.0)
    three = spark.createDataFrame([(0, -1.0, 3.0), (0, -2.0, 1.0), (1, -0.5, 1.0)], df.schema)
    assert loss(False, False, three) == pytest.approx(0.875)
    assert loss(True, True) == pytest.approx((-math.log((math.exp(-1) + math.exp(-2)) / 2) + 0.5) / 2)
    pair = spark.createDataFrame([(-2.0, -5.0, -3.0, -3.0)], "policy_chosen double, policy_rejected double, reference_chosen double, reference_rejected double")
    got = W.preference_loss(pair).first()
    assert got.loss == pytest.approx(-math.log(1 / (1 + math.exp(-0.3)))) and got.reward_accuracy == 1.0


PREF = "input_a string, input_b string, known_outputs array<string>, sampled_outputs array<string>, candidate_outputs array<struct<output:string,source:string,rank:int>>"


@pytest.mark.parametrize(
    ("samples", "known", "candidates", "want"),
    [
        (["steam", "steam", "a hot cloud of water vapor", "steam vapor rising slowly"], ["steam"], [], ("steam", "steam vapor rising slowly", "on_policy", "on_policy_verbose")),
        (["mud"], ["steam"], [("long steam cloud thing", "observed", 1), ("steam", "teacher", 2), ("fog", "observed", 3)], ("fog", "mud", "dataset_candidate", "on_policy_invalid")),
        (["steam"], ["steam"], [], None),
        (["", None], ["steam"], [], None),
        (None, None, [], None),
    ],
)
def test_preference_pairs(spark, samples, known, candidates, want):
    got = W.preference_pairs(spark.createDataFrame([("fire", "water", known, samples, candidates)], PREF)).collect()
    assert [(r.chosen, r.rejected, r.chosen_source, r.rejected_source) for r in got] == ([want] if want else [])


PRED = "id long, prediction string, canonical_output string, known_outputs array<string>, sampled_outputs array<string>"


def test_coverage(spark):
    df = spark.createDataFrame([(0, None, "steam", ["steam", "vapor"], ["Steam ", "x"]), (1, None, None, ["mud"], ["clay", "MUD"]), (2, "", "ice", None, None)], PRED)
    got = E.coverage(df, "id").first()
    assert (got.n, got.top1_known_match, got.anyk_known_match, got.top1_canonical_match, got.empty_top1_rate) == (3, pytest.approx(1 / 3), pytest.approx(2 / 3), pytest.approx(1 / 3), pytest.approx(1 / 3))
    assert E.coverage(df.limit(0), "id").first().top1_known_match == 0.0


def test_semantic_coverage(spark):
    df = spark.createDataFrame([(0, None, "vapor", ["vapor"], ["steam"]), (1, None, "vapor", ["vapor"], ["banana"]), (2, None, "x", [], ["steam"])], PRED)
    vectors = spark.createDataFrame([("vapor", [1.0, 0.0]), ("steam", [0.98, 0.199]), ("banana", [0.0, 1.0])], "text string, vector array<double>")
    got = E.semantic(df, "id", vectors, 0.9).first()
    assert (got.n, got.top1_semantic_match, got.anyk_semantic_match) == (2, 0.5, 0.5)


def test_text_vectors(spark):
    words = spark.createDataFrame([("fire", [1.0, 0.0]), ("water", [0.0, 1.0])], "word string, vector array<double>")
    texts = spark.createDataFrame([("Fire water",), ("unknown",), ("",)], "text string")
    assert {r.text: r.vector for r in E.text_vectors(texts, words, 2).collect()} == {"Fire water": [0.5, 0.5], "unknown": [0.0, 0.0], "": [0.0, 0.0]}


def test_verdicts(spark):
    """Truth by JSON type, numbers from texts, defaults, clamping; too few results or other items are no verdicts."""
    values = ['"false"', "false", "0", "0.0", '""', "[]", "{}", "null", "1", '"x"', "[0]", '{"a": 0}', "-0.5"]
    many = '{"results": [' + ",".join(f'{{"plausible": {v}}}' for v in values) + "]}"
    scores = ["3", "-1", '"0.5"', '" 0.25 "', '"high"', "null", "[1]", "true", "1e-1"]
    rated = '{"results": [' + ",".join(f'{{"plausible": true, "plausibility": {v}, "reason": {w}}}' for v, w in zip(scores, ['"r"', "null", "3", '""', '"a"', '"b"', '"c"', '"d"', '"e"'], strict=True)) + "]}"
    rows = [(many, len(values)), (rated, 9), ('{"results": []}', 1), ('x {"results": [{}, {}]} y', 1), ('{"results": [3]}', 1), ("none", 1), (None, 1), ('{"results": {}}', 1)]
    got = [r.verdicts for r in E.parsed_verdicts(spark.createDataFrame(rows, "reply string, n int"), F.col("n")).collect()]
    assert [v.plausible for v in got[0]] == [True] + [False] * 7 + [True] * 5 and [v.plausibility for v in got[0]] == [1.0] + [0.0] * 7 + [1.0] * 5
    assert [v.plausibility for v in got[1]] == [1.0, 0.0, 0.5, 0.25, 1.0, 1.0, 1.0, 1.0, 0.1] and [v.reason for v in got[1]][:4] == ["r", "None", "3", ""]
    assert [None if v is None else len(v) for v in got[2:]] == [None, 1, None, None, None, None]


def test_novelties(spark):
    """The JSON's score, else the first number from 0 to 1 anywhere."""
    cases = ['ok {"novelty_score": 0.4, "reason": "1 of 2"}', '{"novelty_score": "7"}', '{"novelty": 0.4}', "I say 0.75 of 1", "none at all", None, '{"novelty_score": "x", "reason": "0.5"}', '{"novelty_score": -3}']
    got = [r.x for r in spark.createDataFrame([(c,) for c in cases], "t string").select(E.novelty_of(F.col("t")).alias("x")).collect()]
    assert [x and x.novelty for x in got] == [0.4, 1.0, 0.4, 0.75, None, None, 0.5, 0.0] and got[0].reason == "1 of 2" and got[3].reason == "I say 0.75 of 1"
    batch = ['{"results": [{"novelty_score": 0.1}, {"novelty_score": 2, "reason": "r"}, {}]}', '{"results": [{"novelty_score": 0.1}]}', '{"results": [{"novelty_score": 0.1}, {"novelty_score": null}]}']
    got = [r.x for r in spark.createDataFrame([(c,) for c in batch], "t string").select(E.novelties_of(F.col("t"), F.lit(2)).alias("x")).collect()]
    assert [tuple(v) for v in got[0]] == [(0.1, ""), (1.0, "r")] and got[1] is None and got[2] is None


def test_judged_samples(spark):
    """An implausible sample keeps its plausibility, an empty or unjudged one has none."""
    rows = spark.createDataFrame([(1, ["Fog", " ", "mud", "ice"], None, ["fog"], None)], "id int, sampled_outputs array<string>, prediction string, known_outputs array<string>, canonical_output string")
    said = spark.createDataFrame([("Fog", True, 0.9), ("mud", False, 0.2), (" ", True, 1.0)], "output string, plausible boolean, plausibility double")
    got = [(r.output, r.plausible, r.plausibility, r.in_dataset, r.bucket) for r in E.judged(rows, "id", said).orderBy("at").collect()]
    assert got == [("Fog", True, 0.9, True, "valid_known"), (" ", False, 0.0, False, "invalid"), ("mud", False, 0.2, False, "invalid"), ("ice", False, 0.0, False, "invalid")]


def test_eval_items(spark):
    lines = [("a", "b", ["x", " ", None], None, None), ("a", "b", None, "c", "p"), ("a", "b", [], "c", None), ("", "b", ["x"], "c", None), ("a", "b", [" "], None, None), ("a", "b", ["x"], "", "")]
    df = spark.createDataFrame(lines, "input_a string, input_b string, known_outputs array<string>, canonical_output string, pair_id string")
    got = [(r.pair_id, r.known_outputs, r.canonical_output) for r in E.eval_items(df).collect()]
    assert got == [("a+b", ["x"], "x"), ("p", ["c"], "c"), ("a+b", ["x"], "x")]
    ranked = spark.createDataFrame([("a", "b", [("x",), ("",)], None)], "input_a string, input_b string, candidate_outputs array<struct<output:string>>, canonical_output string")
    assert E.eval_items(ranked).first().known_outputs == ["x"]


def test_options_and_picks(spark):
    """The stored first, then generated ones, then other stored ones. J16: each id once."""
    kind = "input_a string, input_b string, output string, rank int"
    stored, made = spark.createDataFrame([("a", "b", "top", 1), ("a", "b", "other", 2), ("c", "d", "one", 1)], kind), spark.createDataFrame([("a", "b", "Top ", 7), ("a", "b", "new", 8), ("e", "f", "x", 1), ("e", "f", "y", 2)], kind)
    assert {r.input_a: r.options for r in A.options(stored, made).collect()} == {"a": ["top", "new", "other"], "e": ["x", "y"]}
    asked = spark.createDataFrame([(1, [3, 5, 3, 9, 4, 5])], "owner int, ids array<int>")
    owned = spark.createDataFrame([(1, i) for i in (3, 4, 5)], "owner int, id int")
    assert A.picked(asked, owned, 3).first().ids == [3, 5, 4]


def test_options_of_large_ids(spark, tmp_path):
    """Predictions with ids beyond 21 million keep their order."""
    kind = "row_id long, pair_id string, input_a string, input_b string, known_outputs array<string>"
    spark.createDataFrame([(1, "p", "a", "b", ["top"])], kind).write.parquet(f"{tmp_path}/recipe_canonical_v0.parquet")
    made = [(5 * 10**9, "a", "b", ["late"]), (30_000_000, "a", "b", ["Top", "soon"])]
    spark.createDataFrame(made, "prediction_id long, input_a string, input_b string, sampled_outputs array<string>").write.parquet(f"{tmp_path}/predictions.parquet")
    assert arena.blind_options(spark, str(tmp_path)).first().options == ["top", "soon", "late"]


def test_efficiency(spark):
    df = spark.createDataFrame([("m", 3, 2.26), ("n", 0, None)], "model string, wins long, avg_combinations double")
    assert [tuple(r) for r in A.efficiency(df).collect()] == [("m", 2.3, 3)]


def test_boards(spark):
    df = spark.createDataFrame([("m", "d1", 4, 4, 1.0, 2.0), ("m", "d2", 1, 0, 0.0, None)], "model string, day string, runs long, wins long, win_rate double, avg_combinations double")
    got = A.overall(df).first()
    assert (got.score, got.days, got.runs, got.wins, got.avg_combinations) == (0.5, 2, 5, 4, 2.0)
    more = spark.createDataFrame([("m", "d1", 2, 2, 1.0, 4.0), ("m", "d2", 1, 1, 1.0, 10.0), ("m", "d3", 1, 0, 0.0, None)], df.schema)
    assert A.overall(more).first().avg_combinations == 6.0
    scores = spark.createDataFrame([("g", "u", 5, 1, 0), ("g", "u", 2, 3, 1), ("g", "u", 2, 2, 2), ("g", "v", 4, 1, 3)], "goal string, user string, score int, at int, id int")
    assert sorted((r.user, r.score, r.at) for r in A.best_scores(scores, ["goal", "user"], "score", "at", "id").collect()) == [("u", 2, 2), ("v", 4, 1)]


def test_limits_include_the_limit(spark):
    hits = spark.createDataFrame([(i, "k", f"2024-01-01 00:00:{i:02d}") for i in range(4)] + [(9, "k", "2024-01-01 00:01:00")], "event_id long, key string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = {r.event_id: (r.nth, r.allowed, r.retry_after) for r in A.limited(hits, ["key"], "ts", 60, 3).collect()}
    assert got[2] == (3, True, None) and got[3] == (4, False, 57) and got[9] == (1, True, None)


def test_graph(spark):
    edges = spark.createDataFrame([("water", "fire", "steam"), ("earth", "water", "mud"), ("steam", "mud", "geyser"), ("gone", "water", "never")], "a string, b string, c string")
    starters = spark.createDataFrame([(s, 0) for s in ("water", "fire", "earth")], "node string, cost long")
    assert {r.node: r.cost for r in G.levels(edges, starters).collect()} == {"water": 0, "fire": 0, "earth": 0, "steam": 1, "mud": 1, "geyser": 2}
    ones = starters.withColumn("cost", F.lit(1))
    assert {r.node: r.cost for r in G.levels(edges, ones, cost="sum").collect()}["geyser"] == 4
    paths = G.witness_paths([tuple(r) for r in edges.collect()], ["water", "fire", "earth"], 3)
    assert [p[2] for p in paths["geyser"]] == ["steam", "mud", "geyser"] and G.replays(paths["geyser"], ["water", "fire", "earth"], "geyser")
    assert "geyser" not in G.witness_paths([tuple(r) for r in edges.collect()], ["water", "fire", "earth"], 2)
    assert G.witnesses(edges.limit(0), starters, 3).count() == 0


def test_levels_deeper_than_64(spark):
    """A chain of 66 recipes, and a node whose cheaper sum comes only from the end of the chain."""
    chain = [(f"n{i}", "n0", f"n{i + 1}") for i in range(66)]
    starters = spark.createDataFrame([("n0", 0)], "node string, cost long")
    edges = spark.createDataFrame(chain, "a string, b string, c string")
    dear = [("n0", "n0", "d1"), *((f"d{i}", f"d{i}", f"d{i + 1}") for i in range(1, 8)), ("d8", "n0", "end"), ("n66", "n0", "end")]
    got = {r.node: r.cost for r in G.levels(spark.createDataFrame(chain + dear, edges.schema), starters.withColumn("cost", F.lit(1)), cost="sum").collect()}
    assert {n: c for n, c in got.items() if n[0] == "n"} == {f"n{i}": i + 1 for i in range(67)}
    assert (got["d8"], got["end"]) == (256, 68)
    with pytest.raises(ValueError, match="negative"):
        G.levels(edges, starters.withColumn("cost", F.lit(-1)), cost="sum")


def test_whole_graph(spark, tmp_path, rows):
    """Against brute force, with cycles and recipes out of reach."""
    rng = random.Random(5)
    made = [(f"e{rng.randrange(i)}", f"e{rng.randrange(i)}", f"e{i}") for i in range(8, 120) for _ in range(2)] + [(f"e{rng.randrange(8, 120)}", f"e{rng.randrange(120)}", f"e{rng.randrange(8, 120)}") for _ in range(60)]
    lines = [*made, ("e0", "x", "y"), ("y", "e1", "x"), ("e2", "e3", "e2"), ("e0", "e1", None)]
    spark.createDataFrame(lines, "input_a string, input_b string, canonical_output string").write.parquet(str(tmp_path / "recipe_canonical_v0.parquet"))
    edges = {(min(a, b), max(a, b), c) for a, b, c in lines if c and c not in (a, b)}
    starters = {x for a, b, _ in edges for x in (a, b)} - {c for *_, c in edges}

    def levels(start, plus):
        known, was = dict.fromkeys(starters, start), None
        while was != known:
            was = dict(known)
            for a, b, c in edges:
                if a in known and b in known:
                    known[c] = min(known.get(c, 1 << 60), plus(known[a], known[b]))
        return known

    d = str(tmp_path)
    depth, costs = levels(0, lambda x, y: max(x, y) + 1), levels(1, lambda x, y: x + y)
    assert len(depth) > 60 and "x" not in depth
    assert set(rows(graphs.recipe_edges(spark, d))) == edges
    assert dict(rows(graphs.depths(spark, d))) == depth and dict(rows(graphs.sum_costs(spark, d))) == costs
    assert set(rows(graphs.priced_recipes(spark, d))) == {(a, b, c, costs.get(a), costs.get(b), costs.get(c)) for a, b, c in edges if costs.get(c, 0) <= 100}
    assert {e: (i, o) for e, i, o in rows(graphs.element_uses(spark, d))} == {e: (sum(e in x[:2] for x in edges), sum(e == x[2] for x in edges)) for x in edges for e in x}
    assert graphs.element_links(spark, d).count() == sum(2 + (a != b) for a, b, _ in edges) and graphs.packed_recipes(spark, d).distinct().count() == len(edges)
    goal = graphs.daily_goal(spark, d).first()
    assert depth[goal.node] == goal.cost
    # Witness paths: rounds that all use the round before; of a round's paths the shortest, of equals the first.
    paths = {x: [] for x in starters}
    for _ in range(graphs.STEPS):
        new = {}
        for a, b, c in edges:
            if a in paths and b in paths and c not in starters:
                union = {t[2]: t for t in reversed([*paths[a], *paths[b], (a, b, c)])}
                path = sorted(union.values(), key=[*paths[a], *paths[b], (a, b, c)].index)
                if len(path) <= graphs.STEPS and (c not in new or (len(path), path) < (len(new[c]), new[c])):
                    new[c] = path
        better = {c: p for c, p in new.items() if c not in paths or len(p) < len(paths[c])}
        if not better:
            break
        paths |= better
    e = graphs._edges(spark, d)
    got = {r.node: [tuple(x) for x in r.path] for r in G.witnesses(e, graphs._unmade(e, 0), graphs.STEPS).collect()}
    assert got == {c: p for c, p in paths.items() if p} and len(got) > 30
    assert all(G.replays(p, list(starters), c) for c, p in got.items())
    asked = {x: sum(x in t[:2] for t in edges) for t in edges for x in t[:2]}
    most = sorted(asked, key=lambda x: (-asked[x], x))[: graphs.ASKED]
    pairs = {(min(x, y), max(x, y)) for x in most for y in asked} - {t[:2] for t in edges}
    assert rows(graphs.untried_pairs(spark, d)) == sorted(pairs, key=repr)


RECIPES = "id int, input_a string, input_b string, outputs array<string>, reply struct<keep_recipe:boolean,reject_reason:string,candidates:array<struct<output:string,source:string,rationale:string>>>"


def test_teacher_outputs(spark):
    """What stays of a reply, and the first reason against a recipe."""
    said = [("steam", "teacher", "hot  water "), ("Fog", "observed", "x"), ("mist", "teacher", "y"), ("m-ist", "teacher", "z"), ("fire", "teacher", "f"), ("wet running", "teacher", "w"), ("rain", "teacher", " "), (None, "teacher", "n")]
    lines = [
        (1, " Fire", "water", ["Steam", "steam "], (True, None, said)), (2, "fire", "", ["steam"], (True, None, said)), (3, "fire", "water", ["fire", "x#y", None], (False, "no", said)), (4, "fire", "water", None, None),
        (5, "fire", "water", ["steam"], None), (6, "fire", "water", ["steam"], (False, "Too  Vague", said)), (7, "fire", "water", ["steam"], (False, None, said)), (8, "fire", "water", ["steam"], (True, None, [("fire", "teacher", "x")])), (9, "fire", "water", ["steam"], (True, None, None)),
    ]
    got = {r.id: r for r in N.enriched(spark.createDataFrame(lines, RECIPES), 3).collect()}
    assert [tuple(c) for c in got[1].candidate_outputs] == [("steam", "observed", "hot water", 1), ("mist", "teacher", "y", 2), ("wet running", "teacher", "w", 3)]
    assert (got[1].input_a, got[1].outputs, got[1].reject_reason) == ("fire", ["steam"], None)
    reasons = {2: "no_valid_observed_outputs", 3: "no_valid_observed_outputs", 4: "no_valid_observed_outputs", 5: "teacher_response_error", 6: "too_vague", 7: "teacher_rejected_recipe", 8: "no_valid_teacher_candidates", 9: "no_valid_teacher_candidates"}
    assert {k: r.reject_reason for k, r in got.items() if k > 1} == reasons and all(r.candidate_outputs is None for k, r in got.items() if k > 1)
    assert N.enriched(spark.createDataFrame([], RECIPES)).count() == 0


def test_imported_replies(spark):
    """The first outcome that holds, and what was written by an earlier line."""
    def line(n, said, status=None, who="a", **more):
        ask = {"contents": [{"parts": [{"text": "Teach."}, {"text": f"Dataset record id:  {who}\nrest"}]}]}
        return (n, json.dumps({"request": ask, "response": {"candidates": [{"content": {"parts": [{"text": ""}, {"text": said}]}}]}, "status": status, **more}))

    good = json.dumps({"keep_recipe": True, "candidate_outputs": [{"output": "Steam", "rationale": "x", "source": "observed"}, {"output": "fog", "rationale": "y", "source": "teacher"}]})
    bad = [json.dumps(x) for x in ({"keep_recipe": "yes"}, {"candidate_outputs": []}, {"keep_recipe": True, "candidate_outputs": None}, {"keep_recipe": True, "candidate_outputs": [{"output": "x", "rationale": "y", "source": "else"}]}, {"keep_recipe": True, "reject_reason": 3}, [1])]
    lines = [(0, "{broken"), line(1, good, who="nobody"), line(2, good, who="old"), line(3, good, "failed"), line(4, "no json"), line(5, json.dumps({"keep_recipe": False})), line(6, good), line(7, good), line(8, good, "failed"), line(9, good, who="b"), line(20, good, who="nobody")]
    lines += [line(10 + i, b, who="c") for i, b in enumerate(bad)] + [(30, json.dumps({"request": {}, "response": {}}))]
    index = spark.createDataFrame([("a", "train", "Fire", "water", ["steam"]), ("b", "dev", "fire", "water", ["steam"]), ("c", "dev", "x", "y", ["z1"]), ("old", "train", "mud", "sand", ["clay"])], "record_id string, split string, input_a string, input_b string, outputs array<string>")
    done = spark.createDataFrame([("train", "MUD", " sand"), (None, "fire", "water")], "split string, input_a string, input_b string")
    got = {r.position: r for r in N.imported(spark.createDataFrame(lines, "position long, line string"), index, done).collect()}
    want = {0: "parse_error", 1: "missing_batch_record_id", 2: "skipped_existing", 3: "batch_row_error", 4: "batch_response_parse_error", 5: "teacher_rejected_recipe", 6: "written", 7: "skipped_existing", 8: "skipped_existing", 9: "written", 20: "missing_batch_record_id", 30: "missing_batch_record_id"}
    assert {k: r.outcome for k, r in got.items()} == want | {10 + i: "batch_response_parse_error" for i in range(len(bad))}
    assert [tuple(c) for c in got[6].candidate_outputs] == [("steam", "observed", "x", 1), ("fog", "teacher", "y", 2)] and got[7].candidate_outputs is None


def test_completed(spark):
    lines = [("fire", "water", ["Steam", "fire", "bad#"], ["steam", "fog", "mist", "rain"]), ("fire", "water", ["a1"], None), ("fire", "water", None, []), ("fire", "water", ["one", "two", "three", "four"], ["five"])]
    df = spark.createDataFrame(lines, "input_a string, input_b string, observed array<string>, taught array<string>")
    got = [([tuple(c) for c in r.candidate_outputs], r.quality_status) for r in N.completed(df, 3).collect()]
    assert got == [
        ([("steam", "observed"), ("fog", "teacher"), ("mist", "teacher")], "complete"), ([], "failed_enrichment"), ([], "failed_enrichment"), ([("one", "observed"), ("two", "observed"), ("three", "observed")], "complete"),
    ]


def test_rationales(spark):
    """Faultless replies fill in and replace; a fault is named and changes nothing."""
    cand = lambda *x: [(o, "observed", r) for o, r in x]
    say = lambda *x: json.dumps({"rationales": [{"output": o, "rationale": r} for o, r in x]})
    two = cand(("a", "old"), ("b", None))
    cases = {
        1: (two, f"```json\n{say(('a', 'new  one'), ('b', 'x'))}\n```"), 2: (two, say(("b", "x"), ("a", "y"))), 3: (two, say(("a", "x"), ("a", "y"))), 4: (two, say(("c", "x"))), 5: (two, '{"rationales": [3]}'), 6: (two, '{"rationales": 3}'), 7: (two, "nope"),
        8: (two, None), 9: (cand(("a", "k")), "nope"), 10: ([], say()), 11: (cand(("a", None)), "nope"), 12: (cand(("a", None)), say(("a", " "))), 13: (two, '{"rationales": [{"output": "a", "rationale": 1}]}'), 14: (two, say(("a", ""))),
    }
    df = spark.createDataFrame([(k, *v) for k, v in cases.items()], "id int, candidate_outputs array<struct<output:string,source:string,rationale:string>>, reply string")
    got = {r.id: r for r in N.with_rationales(df).collect()}
    assert [c.rationale for c in got[1].candidate_outputs] == ["new one", "x"] and got[1].quality_status == "complete" and got[1].reason is None
    assert {k: got[k].error for k in range(2, 9)} == {2: "reordered", 3: "duplicate", 4: "unexpected", 5: "not_an_object", 6: "not_a_list", 7: "not_json", 8: "not_json"} and got[13].error == "not_texts"
    assert all(([c.rationale for c in got[k].candidate_outputs], got[k].quality_status, got[k].reason, got[k].missing_outputs) == (["old", None], "partial_rationale", "missing_rationales", ["b"]) for k in (2, 3, 4, 5, 6, 7, 8, 13, 14))
    assert (got[9].quality_status, got[9].error) == ("complete", None) and (got[10].quality_status, got[10].reason) == ("failed_rationale", "teacher_response_error")
    assert (got[11].quality_status, got[12].quality_status) == ("failed_rationale", "partial_rationale") and got[12].reason == "teacher_response_error"


def test_hot_keys_are_salted(spark, monkeypatch):
    """A key with a third of the rows is split, whatever the size of the table."""
    monkeypatch.setattr(skew, "HOT_PARTS", 10)
    left = spark.range(5000).select(F.col("id"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"))
    groups = left.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    got = skew.salted_join(left, groups, ["k"], "n", F.col("id"))
    want = left.join(groups, "k")
    assert got.count() == want.count() == 5000 and got.columns == want.columns
    assert got.filter("k = 7").count() == want.filter("k = 7").count()
    assert "_salt" in got._jdf.queryExecution().toString()


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
@pytest.mark.parametrize("share", [10, 1000])
def test_lookup_without_broadcast(spark, monkeypatch, rows, how, share):
    """A third of the rows ask for one key, some for none, some for one that isn't there; columns clash with nothing."""
    monkeypatch.setattr(skew, "HOT_PARTS", share)
    key = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 40)
    left = spark.range(1200).select(F.col("id"), key.alias("k"), F.lit("l").alias("w"))
    small = spark.range(25).select(F.col("id").alias("k"), F.concat(F.lit("v"), "id").alias("v"), F.when(F.col("id") > 9, F.col("id")).alias("n"))
    got, want = skew.lookup(left, small, ["k"], bound=0, how=how), left.join(small, ["k"], how)
    assert got.columns == want.columns and rows(got) == rows(want) == rows(skew.lookup(left, small, ["k"], how=how))


def test_measured_bytes(spark):
    from tinctura.storage import measured, scope

    with scope():
        df, size = measured(spark.createDataFrame([("abc", [1, 2], None), (None, None, "é")], "a string, b array<int>, c string"), "m")
        assert df.count() == 2 and 100 < size < 300 and measured(df.limit(0), "none")[1] == 0
        place = df.inputFiles()[0]
    with pytest.raises(Exception, match="(?i)exist|not found"):
        spark.read.parquet(place).count()
