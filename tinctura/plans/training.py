"""Queries over candidates, weights, losses, preference pairs, enrichment and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tinctura.functions import vectors as V
from tinctura.operators import enrich as N, evaluate as E, weights as W
from tinctura.plans.base import Plans, concept, defect, words
from tinctura.storage import table

plans = Plans()
queries, oracle_sql = plans.queries, plans.oracle_sql

_CAND = """cand AS (SELECT row_id, input_a, input_b, o AS output, CAST(i AS INTEGER) AS rank, CAST(i - 1 AS INTEGER) AS position, CASE WHEN row_id % 2 = 0 THEN CAST(observation_counts[i] AS DOUBLE) END AS weight
    FROM (SELECT *, unnest(known_outputs) AS o, unnest(range(1, len(known_outputs) + 1)) AS i FROM recipe_canonical_v0))"""


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of the canonical pairs; every other pair has its counts as weights."""
    c = table(spark, d, "recipe_canonical_v0")
    full = F.transform("known_outputs", lambda o, i: F.struct(o.alias("output"), (i + 1).cast("int").alias("rank"), F.when(F.col("row_id") % 2 == 0, F.get("observation_counts", i)).cast("double").alias("weight")))
    return W.candidates(c.select("row_id", "input_a", "input_b", full.alias("candidate_outputs")), "row_id", "input_a", "input_b")


_SHARE = f"""{_CAND}, sh AS (SELECT *, raw / sum(raw) OVER (PARTITION BY row_id) AS share FROM (SELECT *, CASE WHEN count(weight) OVER (PARTITION BY row_id) = count(*) OVER (PARTITION BY row_id) THEN weight ELSE 1.0 / rank END AS raw FROM cand))"""


@plans.add(f"WITH {_SHARE} SELECT row_id, output, rank, share FROM sh", fractions="share")
def candidate_shares(spark: SparkSession, d: str) -> DataFrame:
    """A17, S7."""
    return W.normalized(_candidates(spark, d), ["row_id"]).select("row_id", "output", "rank", "share")


@plans.add(f"""WITH {_CAND}, x AS (SELECT least(input_a, input_b) AS a, split_part(output, ' ', 1) AS output, weight, rank, row_number() OVER (PARTITION BY least(input_a, input_b) ORDER BY row_id, position) - 1 AS position FROM cand),
    s AS (SELECT *, raw / sum(raw) OVER (PARTITION BY a) AS share FROM (SELECT *, CASE WHEN count(weight) OVER (PARTITION BY a) = count(*) OVER (PARTITION BY a) THEN weight ELSE 1.0 / rank END AS raw FROM x))
    SELECT a, output, sum(share) AS share FROM s GROUP BY 1, 2""", fractions="share")
def merged_shares(spark: SparkSession, d: str) -> DataFrame:
    """All recipes of one first input as one, outputs by their first word."""
    rows = _candidates(spark, d).withColumn("position", F.col("row_id") * 10_000 + F.col("position"))
    rows = rows.select(F.col("input_a").alias("a"), F.split_part("output", F.lit(" "), F.lit(1)).alias("output"), "weight", "rank", "position")
    return W.merged(rows, ["a"]).select("a", "output", "share")


_LOGP = f"{_SHARE}, lp AS (SELECT row_id, share, -(length(output) + rank) / 7.0 AS logprob FROM sh)"


@plans.add(f"WITH {_LOGP} SELECT row_id, -sum(share * logprob) AS loss FROM lp GROUP BY 1", fractions="loss")
def expected_losses(spark: SparkSession, d: str) -> DataFrame:
    """A19."""
    rows = W.normalized(_candidates(spark, d), ["row_id"]).withColumn("logprob", -(F.length("output") + F.col("rank")) / 7.0)
    return W.group_losses(rows, "row_id", "logprob", "share", uniform=False, logsumexp=False)


@plans.add(f"WITH {_LOGP} SELECT row_id, -ln(avg(exp(logprob))) AS loss FROM lp GROUP BY 1", fractions="loss")
def logsumexp_losses(spark: SparkSession, d: str) -> DataFrame:
    """Uniform weights."""
    rows = _candidates(spark, d).withColumn("logprob", -(F.length("output") + F.col("rank")) / 7.0)
    return W.group_losses(rows, "row_id", "logprob", "weight", uniform=True, logsumexp=True)


@plans.add("""SELECT vec_id, list_sum(list_transform(range(2, 65), lambda i: CASE WHEN i % 3 = 0 THEN CAST(embedding[i] AS DOUBLE) ELSE 0 END)) AS total, list_sum(list_transform(range(2, 65), lambda i: CASE WHEN i % 3 = 0 THEN CAST(embedding[i] AS DOUBLE) ELSE 0 END)) / 21 AS mean FROM embeddings""", fractions="total mean")
def masked_logprobs(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings stand for token logprobs, every third one is masked in."""
    e = table(spark, d, "embeddings")
    p, m = V.doubles(F.col("embedding")), F.transform("embedding", lambda _, i: (i + 1) % 3 == 0)
    return e.select("vec_id", W.masked_logprob(p, m).alias("total"), W.masked_logprob(p, m, True).alias("mean"))


@plans.add("""WITH p AS (SELECT -l_quantity / 10 AS pc, -l_extendedprice / 10000 AS pr, -l_discount * 30 AS rc, -l_tax * 40 AS rr FROM lineitem), z AS (SELECT *, 0.1 * ((pc - pr) - (rc - rr)) AS z FROM p)
    SELECT avg(-(0.9 * (least(z, 0) - ln(1 + exp(-abs(z)))) + 0.1 * (least(-z, 0) - ln(1 + exp(-abs(z)))))) AS loss, avg(0.1 * (pc - rc)) AS chosen_reward, avg(0.1 * (pr - rr)) AS rejected_reward, avg(0.1 * (pc - rc)) - avg(0.1 * (pr - rr)) AS reward_margin,
    avg(CASE WHEN z > 0 THEN 1.0 ELSE 0.0 END) AS reward_accuracy, avg(pc) AS chosen_logp, avg(pr) AS rejected_logp FROM z""", fractions="loss chosen_reward rejected_reward reward_margin reward_accuracy chosen_logp rejected_logp")
def preference_loss(spark: SparkSession, d: str) -> DataFrame:
    """A21, J14."""
    li = table(spark, d, "lineitem").select((-F.col("l_quantity") / 10).alias("policy_chosen"), (-F.col("l_extendedprice") / 10000).alias("policy_rejected"), (-F.col("l_discount") * 30).alias("reference_chosen"), (-F.col("l_tax") * 40).alias("reference_rejected"))
    return W.preference_loss(li, smoothing=0.1)


@plans.add("SELECT l_returnflag, sum(l_extendedprice * l_quantity) / greatest(sum(l_quantity), 1) AS mean FROM lineitem GROUP BY 1", fractions="mean")
def weighted_means(spark: SparkSession, d: str) -> DataFrame:
    """A22."""
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(W.weighted_mean("l_extendedprice", "l_quantity").alias("mean"))


_N = concept("coalesce(x, '')")
_PREF = f"""s AS (SELECT prediction_id, x AS raw, {_N} AS norm, nth, list_contains(list_transform(coalesce(known_outputs, []), lambda x: {_N}), {_N}) AND {_N} <> '' AS valid FROM (SELECT prediction_id, known_outputs, unnest(sampled_outputs) AS x, unnest(range(len(sampled_outputs))) AS nth FROM predictions) WHERE x IS NOT NULL),
    w AS (SELECT *, CASE WHEN norm = '' THEN 0 ELSE len(string_split(norm, ' ')) END AS wc FROM s),
    good AS (SELECT prediction_id, norm, count(*) AS n, min(nth) AS nth, arg_min(raw, nth) AS raw FROM w WHERE valid AND wc BETWEEN 1 AND 2 GROUP BY 1, 2),
    best AS (SELECT prediction_id, raw FROM good QUALIFY row_number() OVER (PARTITION BY prediction_id ORDER BY n DESC, length(norm), nth) = 1),
    cd AS (SELECT prediction_id, x, nth FROM (SELECT prediction_id, unnest(known_outputs) AS x, unnest(range(len(known_outputs))) AS nth FROM predictions) WHERE {_N} <> '' AND len(string_split({_N}, ' ')) <= 2),
    spare AS (SELECT prediction_id, arg_min(x, nth) AS raw FROM cd GROUP BY 1),
    ch AS (SELECT prediction_id, p.input_a, p.input_b, coalesce(best.raw, spare.raw) AS x, best.raw IS NOT NULL AS own FROM predictions p LEFT JOIN best USING (prediction_id) LEFT JOIN spare USING (prediction_id)),
    cn AS (SELECT *, {_N} AS cnorm FROM ch WHERE {_N} <> ''),
    bad AS (SELECT w.*, cn.input_a, cn.input_b, cn.x AS chosen, own, cnorm, count(*) OVER (PARTITION BY prediction_id, norm) AS n, min(nth) OVER (PARTITION BY prediction_id, norm) AS first_nth, nth = (SELECT min(nth) FROM w v WHERE v.prediction_id = w.prediction_id) AS top
        FROM w JOIN cn USING (prediction_id) WHERE norm <> '' AND norm <> cnorm AND (NOT valid OR wc >= 3)),
    rj AS (SELECT * FROM bad QUALIFY row_number() OVER (PARTITION BY prediction_id ORDER BY top DESC, n DESC, length(norm), first_nth, nth) = 1)"""


@plans.add(f"""WITH {_PREF} SELECT input_a || '+' || input_b AS pair_id, input_a, input_b, chosen, raw AS rejected, CASE WHEN own THEN 'on_policy' ELSE 'dataset_candidate' END AS chosen_source, CASE WHEN wc >= 3 THEN 'on_policy_verbose' ELSE 'on_policy_invalid' END AS rejected_source,
    CAST(len(string_split(cnorm, ' ')) AS INTEGER) AS chosen_len, CAST(wc AS INTEGER) AS rejected_len, valid AS rejected_valid FROM rj""")
def preference_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Samples of the predictions, candidates of the known outputs."""
    p = table(spark, d, "predictions")
    cands = F.transform(F.coalesce("known_outputs", F.array().cast("array<string>")), lambda o, i: F.struct(o.alias("output"), F.when(i == 0, "observed").otherwise("teacher").alias("source"), (i + 1).cast("int").alias("rank")))
    return W.preference_pairs(p.withColumn("candidate_outputs", cands))


def _valid(name: str, rows: str, limit: int) -> str:
    """SQL of the valid outputs of ``rows`` (prediction_id, a, b, xs), in order, as ``name`` (prediction_id, os)."""
    return f"""{name}_1 AS (SELECT prediction_id, a, b, {_N} AS o, nth FROM (SELECT prediction_id, a, b, unnest(xs) AS x, unnest(range(len(xs))) AS nth FROM {rows})),
    {name}_2 AS (SELECT prediction_id, o, min(nth) AS nth FROM {name}_1 WHERE o <> a AND o <> b AND {defect('o', gerunds=True)} IS NULL GROUP BY 1, 2), {name} AS (SELECT prediction_id, list(o ORDER BY nth)[1:{limit}] AS os FROM {name}_2 GROUP BY 1)"""


_A, _B = concept("coalesce(input_a, '')"), concept("coalesce(input_b, '')")
def _teach(failed: str, told: str) -> str:
    """SQL of the outcomes ``en`` (prediction_id, a, b, outs, sources, reason) of teacher replies; failed, told: conditions."""
    return f"""kn AS (SELECT prediction_id, {_A} AS a, {_B} AS b, known_outputs AS xs, sampled_outputs, model FROM predictions), {_valid('sn', 'kn', 5)},
    pp AS (SELECT prediction_id, a, b, coalesce(os, []) AS seen, {_N} AS o, nth FROM (SELECT prediction_id, a, b, unnest(sampled_outputs) AS x, unnest(range(len(sampled_outputs))) AS nth FROM kn) LEFT JOIN sn USING (prediction_id)),
    pu AS (SELECT *, row_number() OVER (PARTITION BY prediction_id, translate(o, ' -''', '') ORDER BY nth) AS f FROM pp WHERE nth % 5 < 4 AND o <> a AND o <> b AND (list_contains(seen, o) OR nth % 2 = 1) AND {defect('o', gerunds=True)} IS NULL),
    pc AS (SELECT prediction_id, list(o ORDER BY nth)[1:5] AS outs, list(CASE WHEN list_contains(seen, o) THEN 'observed' ELSE 'teacher' END ORDER BY nth)[1:5] AS sources FROM pu WHERE f = 1 GROUP BY 1),
    en AS (SELECT prediction_id, a, b, outs, sources, CASE WHEN a = '' OR b = '' OR os IS NULL THEN 'no_valid_observed_outputs' WHEN {failed} THEN 'teacher_response_error' WHEN {told} THEN CASE WHEN prediction_id % 2 = 0 THEN 'teacher_rejected_recipe' ELSE substr('too_vague_' || replace({concept('model')}, ' ', '_'), 1, 80) END
        WHEN outs IS NULL THEN 'no_valid_teacher_candidates' END AS reason FROM kn LEFT JOIN sn USING (prediction_id) LEFT JOIN pc USING (prediction_id))"""


_TEACH = _teach("prediction_id % 9 = 0", "prediction_id % 7 = 0")


def _enriched(spark: SparkSession, d: str) -> DataFrame:
    """Predictions as recipes, their samples as proposals: every other one said to be observed, every fifth without a
    rationale; some replies are missing or reject the recipe."""
    n = F.col("prediction_id")
    said = F.transform("sampled_outputs", lambda o, i: F.struct(o.alias("output"), F.when(i % 2 == 0, "observed").otherwise("teacher").alias("source"), F.when(i % 5 < 4, " it \n follows").otherwise(" ").alias("rationale")))
    reply = F.struct((n % 7 != 0).alias("keep_recipe"), F.when(n % 2 != 0, F.concat(F.lit("Too  vague "), "model")).alias("reject_reason"), said.alias("candidates"))
    rows = table(spark, d, "predictions").select("prediction_id", "input_a", "input_b", F.col("known_outputs").alias("outputs"), F.when(n % 9 != 0, reply).alias("reply"))
    return N.enriched(rows)


@plans.add(f"WITH {_TEACH} SELECT prediction_id, unnest(outs) AS output, unnest(sources) AS source, 'it follows' AS rationale, CAST(unnest(range(1, len(outs) + 1)) AS INTEGER) AS rank FROM en WHERE reason IS NULL")
def merged_candidates(spark: SparkSession, d: str) -> DataFrame:
    """D5, O9, F7, P6, P7."""
    return _enriched(spark, d).select("prediction_id", F.explode("candidate_outputs").alias("c")).select("prediction_id", "c.*")


@plans.add(f"WITH {_TEACH} SELECT prediction_id, a AS input_a, b AS input_b, reason AS reject_reason FROM en WHERE reason IS NOT NULL")
def rejected_recipes(spark: SparkSession, d: str) -> DataFrame:
    """D6, P8."""
    return _enriched(spark, d).filter("reject_reason is not null").select("prediction_id", "input_a", "input_b", "reject_reason")


@plans.add(f"""WITH kn AS (SELECT prediction_id, {_A} AS a, {_B} AS b, known_outputs AS xs FROM predictions), {_valid('ob', 'kn', 3)}, tk AS (SELECT prediction_id, {_A} AS a, {_B} AS b, sampled_outputs AS xs FROM predictions), {_valid('tg', 'tk', 1_000_000)},
    al AS (SELECT prediction_id, coalesce(ob.os, []) AS o, list_filter(coalesce(tg.os, []), lambda x: NOT list_contains(coalesce(ob.os, []), x))[1:3 - len(coalesce(ob.os, []))] AS t FROM predictions LEFT JOIN ob USING (prediction_id) LEFT JOIN tg USING (prediction_id))
    SELECT prediction_id, o AS observed, CASE WHEN len(o) >= 3 THEN [] ELSE t END AS taught, CASE WHEN len(o) >= 3 OR len(o) + len(t) >= 3 THEN 'complete' WHEN len(o) + len(t) > 0 THEN 'partial_enrichment' ELSE 'failed_enrichment' END AS quality_status FROM al""")
def completed_outputs(spark: SparkSession, d: str) -> DataFrame:
    """D7, A25, F7."""
    done = N.completed(table(spark, d, "predictions").select("prediction_id", "input_a", "input_b", F.col("known_outputs").alias("observed"), F.col("sampled_outputs").alias("taught")), 3)
    of = lambda source: F.transform(F.filter("candidate_outputs", lambda c: c["source"] == source), lambda c: c["output"])
    return done.select("prediction_id", of("observed").alias("observed"), of("teacher").alias("taught"), "quality_status")


@plans.add("""WITH c AS (SELECT row_id AS n, list_distinct(known_outputs) AS d, known_outputs AS o FROM recipe_canonical_v0), k AS (SELECT *, len(o) AS m, CASE WHEN n % 8 = 7 THEN NULL WHEN n % 8 = 1 THEN 'not_json' WHEN n % 8 = 2 THEN 'not_a_list' WHEN n % 8 = 3 THEN 'unexpected' WHEN n % 8 = 4 THEN 'duplicate' WHEN n % 8 = 5 AND len(o) > 1 THEN 'reordered' WHEN n % 8 = 6 THEN 'not_texts' END AS error FROM c)
    SELECT n AS row_id, error, CASE WHEN n % 8 = 7 OR error IS NULL THEN 'complete' ELSE CASE WHEN n % 3 = 0 THEN 'partial_rationale' ELSE 'failed_rationale' END END AS quality_status, CASE WHEN n % 8 = 7 OR error IS NULL THEN NULL WHEN n % 3 = 0 AND m > 1 THEN 'missing_rationales' WHEN n % 3 = 0 THEN NULL ELSE 'teacher_response_error' END AS reason,
    CAST(CASE WHEN n % 8 = 7 OR error IS NULL THEN 0 WHEN n % 3 = 0 THEN m - 1 ELSE m END AS INTEGER) AS missing FROM k WHERE NOT (n % 3 = 0 AND m = 1)
    UNION ALL SELECT n, NULL, 'complete', NULL, 0 FROM k WHERE n % 3 = 0 AND m = 1""")
def rationales(spark: SparkSession, d: str) -> DataFrame:
    """Known outputs as candidates, some with rationales, and replies that are right or wrong in every way."""
    c, n = table(spark, d, "recipe_canonical_v0"), F.col("row_id")
    own = F.transform("known_outputs", lambda o, i: F.struct(o.alias("output"), F.lit("observed").alias("source"), F.when((n % 8 == 7) | ((n % 3 == 0) & (i == 0)), "so it is").alias("rationale")))
    good = F.transform("known_outputs", lambda o: F.struct(o.alias("output"), F.concat(F.lit(" why "), o).alias("rationale")))
    as_json = lambda items: F.concat(F.lit("```json\n"), F.to_json(F.struct(items.alias("rationales"))), F.lit("\n```"))
    first = F.get(good, F.lit(0))
    reply = (
        F.when(n % 8 == 1, "{broken").when(n % 8 == 2, '{"rationales": {}}').when(n % 8 == 3, as_json(F.array(F.struct(F.lit("?").alias("output"), F.lit("x").alias("rationale"))))).when(n % 8 == 4, as_json(F.array(first, first)))
        .when(n % 8 == 5, as_json(F.reverse(good))).when(n % 8 == 6, '{"rationales": [{"output": 1, "rationale": "x"}]}').otherwise(as_json(good))
    )
    rows = N.with_rationales(c.select("row_id", own.alias("candidate_outputs"), reply.alias("reply")))
    return rows.select("row_id", "error", "quality_status", "reason", F.size("missing_outputs").alias("missing"))


_JUDGE = """rp AS (SELECT prediction_id AS n, CASE prediction_id % 8 WHEN 0 THEN 'true' WHEN 1 THEN '"false"' WHEN 2 THEN '""' WHEN 3 THEN '0' WHEN 4 THEN '[]' WHEN 5 THEN '2.5' WHEN 6 THEN 'null' ELSE '{"a":1}' END AS v,
    CASE prediction_id % 5 WHEN 0 THEN '1.7' WHEN 1 THEN '"0.25"' WHEN 2 THEN '-3' WHEN 3 THEN '"high"' ELSE 'null' END AS s, CASE WHEN prediction_id % 11 = 0 THEN 2 ELSE 1 END AS wanted FROM predictions)"""


def _judge(spark: SparkSession, d: str) -> DataFrame:
    """Judge replies with values of every JSON type; every eleventh has fewer results than asked for."""
    n = F.col("prediction_id")
    pick = lambda k, *texts: F.element_at(F.array(*map(F.lit, texts)), (n % k + 1).cast("int"))
    plausible, score = pick(8, "true", '"false"', '""', "0", "[]", "2.5", "null", '{"a":1}'), pick(5, "1.7", '"0.25"', "-3", '"high"', "null")
    item = F.concat(F.lit('{"plausible": '), plausible, F.lit(', "plausibility": '), score, F.lit(', "novelty_score": '), score, F.lit(', "reason": "of 3 kinds"}'))
    reply = F.concat(F.lit('Here: {"results": ['), item, F.lit("]} done"))
    return table(spark, d, "predictions").select("prediction_id", reply.alias("reply"), item.alias("item"), F.when(n % 11 == 0, 2).otherwise(1).alias("wanted"))


@plans.add(f"""WITH {_JUDGE}, t AS (SELECT *, v NOT IN ('""', '0', '[]', 'null') AS true_ FROM rp) SELECT n AS prediction_id, CASE WHEN wanted = 1 THEN true_ END AS plausible,
    CASE WHEN wanted = 1 THEN CAST(CASE s WHEN '1.7' THEN 1.0 WHEN '"0.25"' THEN 0.25 WHEN '-3' THEN 0.0 ELSE CAST(true_ AS INTEGER) END AS DOUBLE) END AS plausibility, CASE WHEN wanted = 1 THEN 'of 3 kinds' END AS reason FROM t""", fractions="plausibility")
def parsed_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """D13."""
    rows = E.parsed_verdicts(_judge(spark, d), F.col("wanted")).withColumn("v", F.get("verdicts", F.lit(0)))
    return rows.select("prediction_id", "v.plausible", "v.plausibility", "v.reason")


@plans.add(f"""WITH {_JUDGE}, x AS (SELECT *, CASE s WHEN '1.7' THEN 1.0 WHEN '"0.25"' THEN 0.25 WHEN '-3' THEN 0.0 END AS given,
    TRY_CAST(regexp_extract('{{"plausible": ' || v || ', "plausibility": ' || s || ', "novelty_score": ' || s || ', "reason": "of 3 kinds"}}', '([01](?:\\.\\d+)?)', 1) AS DOUBLE) AS found FROM rp)
    SELECT n AS prediction_id, CAST(coalesce(given, CASE WHEN found > 1 THEN 1 ELSE found END) AS DOUBLE) AS novelty, CASE WHEN given IS NOT NULL THEN 'of 3 kinds' WHEN found IS NOT NULL THEN '{{"plausible": ' || v || ', "plausibility": ' || s || ', "novelty_score": ' || s || ', "reason": "of 3 kinds"}}' END AS reason,
    CASE WHEN wanted = 1 THEN CAST(given AS DOUBLE) END AS batch_novelty FROM x""", fractions="novelty batch_novelty")
def novelties(spark: SparkSession, d: str) -> DataFrame:
    """Of one output, and of all by position."""
    rows = _judge(spark, d).withColumns({"one": E.novelty_of(F.col("item")), "all": E.novelties_of(F.col("reply"), F.col("wanted"))})
    return rows.select("prediction_id", "one.novelty", "one.reason", F.get("all", F.lit(0))["novelty"].alias("batch_novelty"))


@plans.add("SELECT c.row_id FROM recipe_canonical_v0 c WHERE NOT EXISTS (SELECT 1 FROM eval_records e WHERE e.input_a = c.input_a AND e.input_b = c.input_b AND len(e.known_outputs) > 0)")
def remaining_pairs(spark: SparkSession, d: str) -> DataFrame:
    """J8, K3, T5."""
    done = table(spark, d, "eval_records").select("input_a", "input_b", F.col("known_outputs").alias("candidate_outputs"))
    return N.remaining(table(spark, d, "recipe_canonical_v0"), done, ["input_a", "input_b"]).select("row_id")


@plans.add("SELECT row_id, split || ':' || lpad((row_number() OVER (ORDER BY row_id) - 1) || '', 8, '0') AS record_id FROM recipe_canonical_v0")
def record_ids(spark: SparkSession, d: str) -> DataFrame:
    """P25."""
    return N.record_ids(table(spark, d, "recipe_canonical_v0").select("row_id", "split"), "split", "row_id").select("row_id", "record_id")


def _replies(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Batch replies made of predictions: broken lines, unknown records, failed rows, replies that can't be read, and every fifth twice."""
    p, n = table(spark, d, "predictions"), F.col("prediction_id")
    said = F.transform(F.coalesce("sampled_outputs", F.array().cast("array<string>")), lambda o, i: F.struct(F.coalesce(o, F.lit("")).alias("output"), F.when(i % 2 == 0, "observed").otherwise("teacher").alias("source"), F.when(i % 5 < 4, " it \n follows").otherwise(" ").alias("rationale")))
    told = F.when(n % 19 == 0, "no JSON").otherwise(F.to_json(F.struct((n % 5 != 0).alias("keep_recipe"), F.when(n % 2 != 0, F.concat(F.lit("Too  vague "), "model")).alias("reject_reason"), said.alias("candidate_outputs"))))
    ask = lambda text: F.array(F.struct(F.array(F.struct(text.alias("text"))).alias("parts")))
    request = F.struct(ask(F.concat(F.lit("Enrich this.\nDataset record id: r"), n, F.lit("\nInput A: "), "input_a")).alias("contents"))
    response = F.struct(F.array(F.struct(F.struct(F.array(F.struct(F.lit("").alias("text")), F.struct(told.alias("text"))).alias("parts")).alias("content"))).alias("candidates"), F.struct(F.lit(100).alias("promptTokenCount"), F.lit(40).alias("candidatesTokenCount")).alias("usageMetadata"))
    body = F.to_json(F.struct(request.alias("request"), response.alias("response"), F.when(n % 11 == 0, "failed").otherwise("").alias("status")))
    one = p.select(n.alias("position"), F.when(n % 13 == 0, F.substring(body, 1, 40)).otherwise(body).alias("line"))
    twice = one.filter("position % 5 = 0").withColumn("position", F.col("position") + 1_000_000_000)
    recipe = p.select(n, F.concat(F.lit("r"), n).alias("record_id"), F.col("model").alias("split"), "input_a", "input_b", F.col("known_outputs").alias("outputs"))
    return one.unionByName(twice), recipe.filter("prediction_id % 7 <> 0").drop("prediction_id"), recipe.filter("prediction_id % 17 = 0").select("split", "input_a", "input_b")


@plans.add(f"""WITH {_teach('false', 'prediction_id % 5 = 0')}, ix AS (SELECT prediction_id AS n, model AS split, {_A} AS a, {_B} AS b FROM predictions),
    r AS (SELECT n, position, split, a, b, reason FROM (SELECT *, unnest(CASE WHEN n % 5 = 0 THEN [n, n + 1000000000] ELSE [n] END) AS position FROM ix) JOIN (SELECT prediction_id AS n, reason FROM en) USING (n)),
    dn AS (SELECT DISTINCT split, a, b FROM ix WHERE n % 17 = 0),
    o AS (SELECT r.*, CASE WHEN n % 13 = 0 THEN 'parse_error' WHEN n % 7 = 0 THEN 'missing_batch_record_id' WHEN dn.a IS NOT NULL THEN 'skipped_existing' WHEN n % 11 = 0 THEN 'batch_row_error' WHEN n % 19 = 0 THEN 'batch_response_parse_error' ELSE coalesce(reason, 'written') END AS first
        FROM r LEFT JOIN dn ON dn.split IS NOT DISTINCT FROM r.split AND dn.a = r.a AND dn.b = r.b),
    f AS (SELECT *, min(CASE WHEN first = 'written' THEN position END) OVER (PARTITION BY split, a, b) AS done_at FROM o)
    SELECT position, CASE WHEN first NOT IN ('parse_error', 'missing_batch_record_id') AND position > done_at THEN 'skipped_existing' ELSE first END AS outcome FROM f""")
def imported_replies(spark: SparkSession, d: str) -> DataFrame:
    """D9, J9, S12, K4."""
    return N.imported(*_replies(spark, d)).select("position", "outcome")


@plans.add("SELECT CAST(sum(CASE WHEN n % 13 = 0 THEN 0 ELSE 100 END) AS BIGINT) AS input, CAST(sum(CASE WHEN n % 13 = 0 THEN 0 ELSE 40 END) AS BIGINT) AS output, CAST(sum(CASE WHEN n % 13 = 0 THEN 0 ELSE 140 END) AS BIGINT) AS total FROM (SELECT prediction_id AS n, unnest(CASE WHEN prediction_id % 5 = 0 THEN [1, 2] ELSE [1] END) FROM predictions)")
def token_usage(spark: SparkSession, d: str) -> DataFrame:
    """P28, A24."""
    used = _replies(spark, d)[0].select(N.usage(F.col("line")).alias("u"))
    return used.agg(*[F.sum(f"u.{c}").alias(c) for c in ("input", "output", "total")])


_MATCH = f"""it AS (SELECT prediction_id, model, list_transform(CASE WHEN len(coalesce(sampled_outputs, [])) > 0 THEN sampled_outputs ELSE [coalesce(prediction, '')] END, lambda x: {concept("coalesce(x, '')")}) AS s, list_transform(coalesce(known_outputs, []), lambda x: {concept("coalesce(x, '')")}) AS k,
    {concept("coalesce(nullif(canonical_output, ''), known_outputs[1], '')")} AS c FROM predictions),
    fl AS (SELECT prediction_id, model, s[1] <> '' AND list_contains(k, s[1]) AS tk, s[1] <> '' AND s[1] = c AS tc, len(list_filter(s, lambda x: x <> '' AND list_contains(k, x))) > 0 AS ak, len(list_filter(s, lambda x: x <> '' AND x = c)) > 0 AS ac, s[1] = '' AS em,
    CASE WHEN s[1] = '' THEN 0 ELSE len(string_split(s[1], ' ')) END AS w FROM it)"""
_RATES = """count(*) AS n, avg(CAST(tk AS INTEGER)) AS top1_known_match, avg(CAST(tc AS INTEGER)) AS top1_canonical_match, avg(CAST(ak AS INTEGER)) AS anyk_known_match, avg(CAST(ac AS INTEGER)) AS anyk_canonical_match, avg(CAST(em AS INTEGER)) AS empty_top1_rate,
    avg(w) AS mean_top1_words, avg(CASE WHEN w > 0 AND w <= 2 THEN 1.0 ELSE 0.0 END) AS frac_top1_le2_words"""


@plans.add(f"WITH {_MATCH} SELECT {_RATES} FROM fl", fractions="top1_known_match top1_canonical_match anyk_known_match anyk_canonical_match empty_top1_rate mean_top1_words frac_top1_le2_words")
def coverage(spark: SparkSession, d: str) -> DataFrame:
    """A13, A30, J11, S8, P2."""
    return E.coverage(table(spark, d, "predictions"), "prediction_id")


@plans.add(f"WITH {_MATCH} SELECT model, {_RATES} FROM fl GROUP BY model", fractions="top1_known_match top1_canonical_match anyk_known_match anyk_canonical_match empty_top1_rate mean_top1_words frac_top1_le2_words")
def coverage_by_model(spark: SparkSession, d: str) -> DataFrame:
    """A13 by model."""
    return E.coverage(table(spark, d, "predictions"), "prediction_id", "model")


@plans.add("""WITH k AS (SELECT *, list_filter(coalesce(known_outputs, CASE WHEN canonical_output <> '' THEN [canonical_output] END, []), lambda x: regexp_matches(x, '[^\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\p{Z}]')) AS o FROM eval_records)
    SELECT eval_id, coalesce(nullif(pair_id, ''), input_a || '+' || input_b) AS pair_id, coalesce(nullif(canonical_output, ''), o[1]) AS canonical_output, o AS known_outputs FROM k WHERE input_a <> '' AND input_b <> '' AND len(o) > 0""")
def eval_items(spark: SparkSession, d: str) -> DataFrame:
    """S8, F8."""
    return E.eval_items(table(spark, d, "eval_records")).select("eval_id", "pair_id", "canonical_output", "known_outputs")


_VERDICTS = "vd AS (SELECT DISTINCT o AS output, length(o) % 3 <> 0 AS plausible, length(o) % 10 / 10.0 AS plausibility FROM (SELECT unnest(sampled_outputs) AS o FROM predictions UNION ALL SELECT coalesce(prediction, '') FROM predictions) WHERE length(o) % 7 <> 0)"
_JUDGED = f"""{_VERDICTS}, js AS (SELECT prediction_id, unnest(s0) AS output, unnest(range(len(s0))) AS nth, k FROM (SELECT prediction_id, CASE WHEN len(coalesce(sampled_outputs, [])) > 0 THEN sampled_outputs ELSE [coalesce(prediction, '')] END AS s0,
    list_transform(coalesce(known_outputs, []), lambda x: {concept("coalesce(x, '')")}) AS k FROM predictions)),
    jd AS (SELECT js.prediction_id, CAST(js.nth AS INTEGER) AS nth, js.output, coalesce(plausible, false) AND {concept('js.output')} <> '' AS plausible, CASE WHEN {concept('js.output')} <> '' THEN coalesce(plausibility, 0) ELSE 0 END AS plausibility, list_contains(k, {concept('js.output')}) AS in_dataset FROM js LEFT JOIN vd ON vd.output = js.output),
    jb AS (SELECT *, CASE WHEN NOT plausible THEN 'invalid' WHEN in_dataset THEN 'valid_known' ELSE 'valid_novel' END AS bucket FROM jd)"""


def _verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts of distinct outputs by their length, as a judge would have given them; some are missing."""
    p = table(spark, d, "predictions")
    outs = p.select(F.explode("sampled_outputs").alias("output")).unionByName(p.select(F.coalesce("prediction", F.lit("")).alias("output"))).distinct()
    return outs.filter(F.length("output") % 7 != 0).select("output", (F.length("output") % 3 != 0).alias("plausible"), (F.length("output") % 10 / 10.0).alias("plausibility"))


@plans.add(f"WITH {_JUDGED} SELECT prediction_id, nth, output, plausible, plausibility, in_dataset, bucket FROM jb", fractions="plausibility")
def judged_samples(spark: SparkSession, d: str) -> DataFrame:
    """D11, D12, J10."""
    return E.judged(table(spark, d, "predictions"), "prediction_id", _verdicts(spark, d)).withColumnRenamed("at", "nth")


@plans.add(f"""WITH {_JUDGED}, r AS (SELECT prediction_id, bool_or(nth = 0 AND plausible) AS v1, bool_or(nth = 0 AND plausible AND NOT in_dataset) AS c1, bool_or(plausible) AS vk, bool_or(plausible AND NOT in_dataset) AS ck, max(bucket) FILTER (nth = 0) AS b FROM jb GROUP BY 1)
    SELECT count(*) AS n, avg(CAST(v1 AS INTEGER)) AS validity_top1, avg(CAST(c1 AS INTEGER)) AS creativity_top1, avg(CAST(vk AS INTEGER)) AS validity_anyk, avg(CAST(ck AS INTEGER)) AS creativity_anyk,
    avg(CAST(b = 'invalid' AS INTEGER)) AS top1_invalid_rate, avg(CAST(b = 'valid_known' AS INTEGER)) AS top1_valid_known_rate, avg(CAST(b = 'valid_novel' AS INTEGER)) AS top1_valid_novel_rate FROM r""", fractions="validity_top1 creativity_top1 validity_anyk creativity_anyk top1_invalid_rate top1_valid_known_rate top1_valid_novel_rate")
def verdict_rates(spark: SparkSession, d: str) -> DataFrame:
    """A15."""
    return E.verdict_rates(E.judged(table(spark, d, "predictions"), "prediction_id", _verdicts(spark, d)), "prediction_id")


def _embedded(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of all distinct outputs: the mean of their words' vectors, a word's vector chosen by its hash."""
    p = table(spark, d, "predictions")
    none = F.array().cast("array<string>")
    texts = p.select(F.explode(F.concat(F.coalesce("sampled_outputs", none), F.coalesce("known_outputs", none), F.array(F.coalesce("prediction", F.lit(""))))).alias("text")).filter("text is not null").distinct()
    words_ = texts.select(F.explode(F.split(F.lower("text"), r"\s+")).alias("word")).filter("word <> ''").distinct()
    vectors = table(spark, d, "embeddings").select("vec_id", V.doubles(F.col("embedding")).alias("vector"))
    ids = (vectors.agg(F.max("vec_id")).first()[0] or 0) + 1
    coded = words_.withColumn("vec_id", F.conv(F.substring(F.sha2("word", 256), 1, 8), 16, 10).cast("long") % ids).join(vectors, "vec_id").select("word", "vector")
    return E.text_vectors(texts, coded, 64)


# The vector of a text: the mean of its words' vectors, a word's vector chosen by its hash; zeros without words.
_SEM = """tx AS (SELECT DISTINCT x AS text FROM (SELECT unnest(list_concat(coalesce(sampled_outputs, []), coalesce(known_outputs, []), [coalesce(prediction, '')])) AS x FROM predictions) WHERE x IS NOT NULL),
    wd AS (SELECT text, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '')) AS word FROM tx),
    wv AS (SELECT text, embedding FROM wd JOIN embeddings ON vec_id = CAST('0x' || substr(sha256(word), 1, 8) AS BIGINT) % (SELECT max(vec_id) + 1 FROM embeddings)),
    tv AS (SELECT text, list(m ORDER BY i) AS v FROM (SELECT text, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM (SELECT text, embedding, unnest(range(1, 65)) AS i FROM wv) GROUP BY 1, 2) GROUP BY 1),
    sm AS (SELECT prediction_id, unnest(s) AS sample, unnest(range(len(s))) AS nth, known_outputs FROM (SELECT prediction_id, CASE WHEN len(coalesce(sampled_outputs, [])) > 0 THEN sampled_outputs ELSE [coalesce(prediction, '')] END AS s, known_outputs FROM predictions WHERE len(known_outputs) > 0)),
    pr2 AS (SELECT prediction_id, nth, sample, unnest(known_outputs) AS target FROM sm),
    dp AS (SELECT sample, target, list_cosine_similarity(x.v, y.v) >= 0.75 AS near FROM (SELECT DISTINCT sample, target FROM pr2) JOIN tv x ON x.text = sample JOIN tv y ON y.text = target),
    fs AS (SELECT prediction_id, bool_or(coalesce(near, false) AND nth = 0) AS t, bool_or(coalesce(near, false)) AS a FROM pr2 LEFT JOIN dp USING (sample, target) GROUP BY 1)"""


@plans.add(f"WITH {_SEM} SELECT count(*) AS n, coalesce(avg(CAST(t AS INTEGER)), 0) AS top1_semantic_match, coalesce(avg(CAST(a AS INTEGER)), 0) AS anyk_semantic_match FROM fs", fractions="top1_semantic_match anyk_semantic_match")
def semantic_coverage(spark: SparkSession, d: str) -> DataFrame:
    """A14, J12, J13, D28."""
    return E.semantic(table(spark, d, "predictions"), "prediction_id", _embedded(spark, d), 0.75)


@plans.add("""WITH p AS (SELECT a.vec_id AS x, b.vec_id AS y, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS c FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1) SELECT x AS vec_id, c AS cosine, 1 - c AS distance FROM p""", fractions="cosine distance")
def neighbour_cosines(spark: SparkSession, d: str) -> DataFrame:
    """D16."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    c = V.cosine(F.col("embedding"), F.col("other"))
    return e.join(other, "vec_id").select("vec_id", c.alias("cosine"), (1 - c).alias("distance"))


@plans.add("""WITH g AS (SELECT vec_id // 8 AS grp, list(CAST(embedding AS DOUBLE[]) ORDER BY vec_id) AS vs FROM embeddings GROUP BY 1 HAVING count(*) = 8)
    SELECT grp AS "group", list_transform(vs[1:4], lambda s: round(1 - greatest(list_cosine_similarity(s, vs[5]), list_cosine_similarity(s, vs[6])), 6)) AS nearest, list_transform(vs[1:4], lambda s: round((2 - list_cosine_similarity(s, vs[5]) - list_cosine_similarity(s, vs[6])) / 4, 6)) AS mean FROM g""")
def reference_distances(spark: SparkSession, d: str) -> DataFrame:
    """Of each sample the distance to the nearest reference, and half the mean distance to all."""
    rounded = lambda c: F.transform(c, lambda x: F.round(x, 6))
    near, mean = V.min_distances(F.col("samples"), F.col("known")), V.mean_distances(F.col("samples"), F.col("known"))
    return _groups(spark, d).select("group", rounded(near).alias("nearest"), rounded(mean).alias("mean"))


def _groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups of eight vectors: four samples, two known, two inputs."""
    e = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 8).alias("group"), (F.col("vec_id") % 8).alias("i"), V.doubles(F.col("embedding")).alias("v"))
    all_ = e.groupBy("group").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("vs")).filter(F.size("vs") == 8)
    return all_.select("group", F.slice("vs", 1, 4).alias("samples"), F.slice("vs", 5, 2).alias("known"), F.slice("vs", 7, 2).alias("inputs"))


_CCS = """g AS (SELECT vec_id // 8 AS grp, list(CAST(embedding AS DOUBLE[]) ORDER BY vec_id) AS vs FROM embeddings GROUP BY 1 HAVING count(*) = 8), ce AS (SELECT *, list_transform(range(1, 65), lambda i: (vs[5][i] + vs[6][i]) / 2) AS c FROM g),
    sa AS (SELECT grp, 1 - list_cosine_similarity(s, c) AS d, (1 - list_cosine_similarity(s, vs[7]) + 1 - list_cosine_similarity(s, vs[8])) / 4 AS nv FROM (SELECT grp, unnest(vs[1:4]) AS s, c, vs FROM ce)),
    pw AS (SELECT grp, avg(1 - list_cosine_similarity(vs[i], vs[j])) AS dd FROM (SELECT grp, vs, unnest([1, 1, 1, 2, 2, 3]) AS i, unnest([2, 3, 4, 3, 4, 4]) AS j FROM ce) GROUP BY 1),
    cc AS (SELECT grp AS "group", avg(d) AS plausibility_distance, avg(1 - d / 2) AS plausibility_score, avg(nv) AS novelty, any_value(dd) AS diversity_distance, any_value(dd) / 2 AS diversity_score, 0.8 * avg(pow(1 - d / 2, 2) * nv) + 0.2 * any_value(dd) / 2 AS local_creativity FROM sa JOIN pw USING (grp) GROUP BY 1)"""


@plans.add(f"WITH {_CCS} SELECT * FROM cc", fractions="plausibility_distance plausibility_score novelty diversity_distance diversity_score local_creativity")
def creativity(spark: SparkSession, d: str) -> DataFrame:
    """D15, D16."""
    return E.creativity_rows(_groups(spark, d))


@plans.add(f"""WITH {_CCS} SELECT count(*) AS n, avg(plausibility_score) AS mean_plausibility_score, avg(novelty) AS mean_novelty, avg(diversity_score) AS mean_diversity_score, avg(local_creativity) AS mean_local_creativity,
    arg_min("group", local_creativity) AS least, arg_max("group", local_creativity) AS most FROM cc""", fractions="mean_plausibility_score mean_novelty mean_diversity_score mean_local_creativity")
def creativity_summary(spark: SparkSession, d: str) -> DataFrame:
    """A16."""
    return E.creativity_summary(E.creativity_rows(_groups(spark, d)))
