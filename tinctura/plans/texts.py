"""Queries over text normalisers, quality rules, identifiers and hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tinctura.functions import concepts as C, hashing as H, text as X
from tinctura.plans import base as B
from tinctura.plans.base import Plans
from tinctura.storage import table

plans = Plans()
queries, oracle_sql = plans.queries, plans.oracle_sql


@plans.add(f"""SELECT obs_id, {B.concept('output')} AS concept, {B.concept("coalesce(output, '')")} AS answer, {B.key('output')} AS key,
    translate({B.concept('output')}, ' -''', '') AS compact, {B.flat('output')} AS one_line, CAST({B.words('output')} AS INTEGER) AS words FROM recipe_observations""")
def text_forms(spark: SparkSession, d: str) -> DataFrame:
    """P1, P2, P3, P6, P7, P11."""
    obs = table(spark, d, "recipe_observations")
    return obs.select("obs_id", X.concept("output").alias("concept"), X.answer("output").alias("answer"), X.key("output").alias("key"), X.compact("output").alias("compact"), X.one_line("output").alias("one_line"), X.word_count("output").alias("words"))


@plans.add(f"""SELECT obs_id, CASE WHEN lower(input_a) <= lower(input_b) THEN input_a ELSE input_b END AS first_input, CASE WHEN lower(input_a) <= lower(input_b) THEN input_b ELSE input_a END AS second_input,
    concat_ws('+', least({B.key('input_a')}, {B.key('input_b')}), greatest({B.key('input_a')}, {B.key('input_b')})) AS pair_key FROM recipe_observations WHERE input_a IS NOT NULL AND input_b IS NOT NULL""")
def pair_keys(spark: SparkSession, d: str) -> DataFrame:
    """P4, P5."""
    obs = table(spark, d, "recipe_observations").filter("input_a is not null and input_b is not null")
    a, b = X.ordered("input_a", "input_b")
    return obs.select("obs_id", a.alias("first_input"), b.alias("second_input"), X.pair_key(X.key("input_a"), X.key("input_b")).alias("pair_key"))


@plans.add(r"""SELECT item_id, regexp_replace(regexp_replace(lower(suite), '[^\p{L}\p{N}]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug,
    CASE WHEN regexp_replace(lower(coalesce(suite, '')), '[^a-z0-9_-]+', '-', 'g') = '' THEN 'anonymous' ELSE regexp_replace(lower(coalesce(suite, '')), '[^a-z0-9_-]+', '-', 'g') END AS segment FROM eval_passages""")
def slugs(spark: SparkSession, d: str) -> DataFrame:
    """P9, P10."""
    return table(spark, d, "eval_passages").select("item_id", X.slug("suite").alias("slug"), X.storage_segment("suite").alias("segment"))


_CONNECTOR = r"(?:with|and|or|of|in|for|to|on|from|by)"
_LINE = "regexp_extract(" + B.strip("coalesce(prediction, '')") + r", '^([^\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]*)', 1)"
_HEAD = r"regexp_extract(line, '^([^.:;?!()\[\]{}]*)', 1)"
_CUT = f"l AS (SELECT prediction_id, {_LINE} AS line FROM predictions), h AS (SELECT prediction_id, {B.flat(f"replace({B.strip(_HEAD)}, '*', ' ')")} AS flat FROM l)"


@plans.add(rf"""WITH {_CUT},
    c AS (SELECT prediction_id, CASE WHEN regexp_matches(flat, '(?i)(?:^|[^\p{{L}}\p{{N}}_]){_CONNECTOR}(?:[^\p{{L}}\p{{N}}_]|$)') THEN regexp_extract(flat, '(?is)^(|.*?[^\p{{L}}\p{{N}}_]){_CONNECTOR}(?:[^\p{{L}}\p{{N}}_].*)?$', 1) ELSE flat END AS cut FROM h),
    w AS (SELECT prediction_id, list_filter(list_transform(string_split(cut, ' '), lambda w: trim(w, ',-_')), lambda w: w <> '') AS words FROM c)
    SELECT prediction_id, array_to_string(words[1:3], ' ') AS concept, array_to_string(words, ' ') AS uncut FROM w""")
def generated_concepts(spark: SparkSession, d: str) -> DataFrame:
    """Up to three words, and all of them."""
    return table(spark, d, "predictions").select("prediction_id", X.generated_concept("prediction").alias("concept"), X.generated_concept("prediction", 0).alias("uncut"))


@plans.add(r"""SELECT prediction_id, nullif(regexp_extract(prediction, '(?s)\{.*\}'), '') AS object,
    CASE WHEN json_valid(nullif(regexp_extract(prediction, '(?s)\{.*\}'), '')) THEN json_extract_string(regexp_extract(prediction, '(?s)\{.*\}'), '$.result') END AS result FROM predictions""")
def outer_objects(spark: SparkSession, d: str) -> DataFrame:
    """P16."""
    found = X.outer_object("prediction")
    return table(spark, d, "predictions").select("prediction_id", found.alias("object"), F.get_json_object(found, "$.result").alias("result"))


_REPLY = """CASE prediction_id % 5 WHEN 0 THEN '<think>a' || chr(10) || 'b</think>' || chr(10) || '<|end|>' || chr(10) || 'Concept: ' || x WHEN 1 THEN '"Resulting  concept : ' || x || '"' || chr(10) || 'more'
    WHEN 2 THEN chr(39) || chr(10) || '`concept:`' || chr(13) || chr(10) || x WHEN 3 THEN '<think>open' || chr(10) || x ELSE x END"""
_BARE = B.strip(r"""regexp_replace(regexp_replace({}, '^["''`]+|["''`]+$', '', 'g'), '(?i)^(?:resulting[\s\x{{0b}}\x{{85}}\p{{Z}}]+concept|concept)[\s\x{{0b}}\x{{85}}\p{{Z}}]*:[\s\x{{0b}}\x{{85}}\p{{Z}}]*', '')""".format(B.strip("y")))


@plans.add(rf"""WITH r AS (SELECT prediction_id, {_REPLY} AS raw, '```json' || chr(10) || x || chr(10) || '``` ' AS fenced, x FROM (SELECT prediction_id, coalesce(prediction, canonical_output, 'none') AS x FROM predictions)),
    t AS (SELECT *, regexp_replace(regexp_replace(raw, '(?is)<think>.*?</think>', '', 'g'), '<\|[^|]+?\|>', '', 'g') AS said FROM r),
    y AS (SELECT *, list_filter(list_transform(regexp_split_to_array({B.strip('said')}, '\r?\n'), lambda y: {_BARE}), lambda y: y <> '') AS bare FROM t)
    SELECT prediction_id, {B.concept("coalesce(bare[1], '')")} AS concept, {B.strip("x")} AS unfenced,
    CASE WHEN contains(raw, '</think>') THEN substr(raw, strpos(raw, '</think>') + 8) WHEN contains(raw, '<think>') THEN '' ELSE raw END AS said FROM y""")
def model_concepts(spark: SparkSession, d: str) -> DataFrame:
    """Predictions as models give them, wrapped in thoughts, fences, quotes and labels, and unwrapped again."""
    x, n = F.coalesce("prediction", "canonical_output", F.lit("none")), F.col("prediction_id") % 5
    raw = (
        F.when(n == 0, F.concat(F.lit("<think>a\nb</think>\n<|end|>\nConcept: "), x)).when(n == 1, F.concat(F.lit('"Resulting  concept : '), x, F.lit('"\nmore')))
        .when(n == 2, F.concat(F.lit("'\n`concept:`\r\n"), x)).when(n == 3, F.concat(F.lit("<think>open\n"), x)).otherwise(x)
    )
    fenced = F.concat(F.lit("```json\n"), x, F.lit("\n``` "))
    return table(spark, d, "predictions").select("prediction_id", X.model_concept(raw).alias("concept"), X.without_fence(fenced).alias("unfenced"), X.without_thoughts(raw).alias("said"))


_PLAIN = "'Input A: ' || input_a || chr(10) || 'Input B: ' || input_b || chr(10) || 'Final concept:'"
_WHY = "'Input A: ' || input_a || chr(10) || 'Input B: ' || input_b || chr(10) || 'Rationale:'"


@plans.add(f"""WITH p AS (SELECT prediction_id, canonical_output AS o, coalesce(prediction, '') AS why, {_PLAIN} AS plain, {_WHY} AS reasoned, 'Given two concepts, combine them into one resulting concept.' || chr(10) || chr(10) || 'Concept A: ' || input_a || chr(10) || 'Concept B: ' || input_b || chr(10) || chr(10) || 'Return only the resulting concept.' AS chat FROM predictions WHERE canonical_output IS NOT NULL),
    x AS (SELECT prediction_id, chat, unnest(['plain', 'after', 'before']) AS kind, o, why, plain, reasoned FROM p),
    y AS (SELECT prediction_id, chat, kind, CASE WHEN kind = 'plain' OR why = '' THEN plain || ' ' || o WHEN kind = 'after' THEN plain || ' ' || o || chr(10) || 'Rationale: ' || why ELSE reasoned || ' ' || why || chr(10) || 'Final concept: ' || o END AS text,
        CASE WHEN kind <> 'before' OR why = '' THEN length(plain) + 1 ELSE length(reasoned) + length(why) + 17 END AS st, CASE WHEN kind = 'plain' OR why = '' THEN 0 WHEN kind = 'after' THEN length(plain) + length(o) + 13 ELSE length(reasoned) + 1 END AS rst, length(o) AS lo, CASE WHEN kind = 'plain' THEN 0 ELSE length(why) END AS lw FROM x)
    SELECT prediction_id, chat, kind, text, CAST(st AS INTEGER) AS "start", CAST(st + lo AS INTEGER) AS "end", CAST(rst AS INTEGER) AS rationale_start, CAST(rst + lw AS INTEGER) AS rationale_end FROM y""")
def prompts(spark: SparkSession, d: str) -> DataFrame:
    """Plain, with the rationale after the concept and before it; and as a chat."""
    p = table(spark, d, "predictions").filter("canonical_output is not null")
    kinds = {"plain": X.prompt_spans("input_a", "input_b", "canonical_output"), "after": X.prompt_spans("input_a", "input_b", "canonical_output", "prediction"), "before": X.prompt_spans("input_a", "input_b", "canonical_output", "prediction", rationale_first=True)}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("x")) for k, v in kinds.items()]))
    return p.select("prediction_id", X.chat_prompt("input_a", "input_b").alias("chat"), each.alias("k")).select("prediction_id", "chat", "k.kind", "k.x.*")


@plans.add("""SELECT row_id, '{"request":{"contents":[{"role":"user","parts":[{"text":' || to_json('Input A: ' || input_a || chr(10) || 'Input B: ' || input_b || chr(10) || 'Final concept:') || '}]}],"generationConfig":{"maxOutputTokens":' ||
    greatest(2048, 256 * len(known_outputs)) || '}}}' AS line FROM recipe_canonical_v0""")
def batch_requests(spark: SparkSession, d: str) -> DataFrame:
    """P24."""
    c = table(spark, d, "recipe_canonical_v0")
    return c.select("row_id", X.batch_request(X.prompt("input_a", "input_b"), F.size("known_outputs")).alias("line"))


@plans.add("""SELECT event_id, 'goal:' || strftime(ts, '%Y-%m-%d') || ':' || (user_id % 20 + 1) AS seed FROM events""")
def day_seeds(spark: SparkSession, d: str) -> DataFrame:
    """P27."""
    return table(spark, d, "events").select("event_id", X.day_seed("ts", F.col("user_id") % 20 + 1).alias("seed"))


@plans.add("""SELECT o_orderkey, CASE WHEN n >= 1000 AND n % 1000 = 0 THEN (n // 1000) || 'k' ELSE n || '' END AS size,
    CASE WHEN s >= 3600 THEN (s // 3600) || 'h' || lpad((s % 3600 // 60) || '', 2, '0') || 'm' || lpad((s % 60) || '', 2, '0') || 's' WHEN s >= 60 THEN (s // 60) || 'm' || lpad((s % 60) || '', 2, '0') || 's' ELSE s || 's' END AS duration
    FROM (SELECT o_orderkey, o_orderkey * 500 AS n, CAST(greatest(round_even(t, 0), 0) AS BIGINT) AS s FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 200 - 20.5 ELSE o_totalprice / 16 END AS t FROM orders))""")
def readable_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Durations with fractions, halves and negative ones among them."""
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    seconds = F.when(k % 4 == 0, (k % 200).cast("double") - 20.5).otherwise(F.col("o_totalprice") / 16)
    return o.select("o_orderkey", X.human_size(k * 500).alias("size"), X.human_duration(seconds).alias("duration"))


@plans.add("""SELECT row_id, pair_id = sha256('["' || input_a || '","' || input_b || '"]') AS same, sha256('["final","' || input_a || '","' || input_b || '"]') AS import_id,
    sha256('["' || pair_id || '","1","' || canonical_output || '"]') AS candidate_id, 'web:' || substr(sha256(input_a || '+' || input_b), 1, 24) AS web_id FROM recipe_canonical_v0""")
def identifiers(spark: SparkSession, d: str) -> DataFrame:
    """The four ids of a pair, and the id of its first candidate."""
    c = table(spark, d, "recipe_canonical_v0")
    return c.select("row_id", (F.col("pair_id") == H.canonical_pair_id("input_a", "input_b")).alias("same"), H.import_pair_id(F.lit("final"), "input_a", "input_b").alias("import_id"), H.candidate_id("pair_id", F.lit(1), "canonical_output").alias("candidate_id"), H.web_pair_id(F.lit("web"), "input_a", "input_b").alias("web_id"))


@plans.add(f"SELECT row_id, CAST({B.bucket('pair_key')} AS INTEGER) AS bucket, {B.split('input_a', 'input_b')} AS split FROM recipe_canonical_v0")
def pair_splits(spark: SparkSession, d: str) -> DataFrame:
    """D1."""
    c = table(spark, d, "recipe_canonical_v0")
    return c.select("row_id", H.stable_bucket("pair_key").alias("bucket"), H.split_of("input_a", "input_b").alias("split"))


@plans.add("""SELECT p_partkey, h AS hash, CAST(h % 360 AS INTEGER) AS hue, (h * 1664525 + 1013904223) % 4294967296 AS next FROM
    (SELECT p_partkey, list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split(lower(p_name), ''), lambda c: CAST(ord(c) AS BIGINT))), lambda x, c: (xor(x, c) * 16777619) % 4294967296) AS h FROM part)""")
def name_hashes(spark: SparkSession, d: str) -> DataFrame:
    """P19, P20, P21."""
    p = table(spark, d, "part")
    h = H.fnv1a(F.lower("p_name"))
    return p.select("p_partkey", h.alias("hash"), H.hue("p_name").alias("hue"), H.lcg(h).alias("next"))


@plans.add("SELECT o_orderkey, true AS same, length(o_orderkey || '') > 0 AS coded FROM orders")
def packed_ids(spark: SparkSession, d: str) -> DataFrame:
    """There and back."""
    o = table(spark, d, "orders")
    code = H.packed_id("o_orderkey")
    return o.select("o_orderkey", (H.unpacked_id(code) == F.col("o_orderkey")).alias("same"), (F.length(code) > 0).alias("coded"))


@plans.add(f"""SELECT obs_id, {B.garbage('input_a')} AS garbage_a, {B.garbage('output')} AS garbage_out, {B.defect('output')} AS reason FROM recipe_observations""")
def concept_quality(spark: SparkSession, d: str) -> DataFrame:
    """F1, F2."""
    obs = table(spark, d, "recipe_observations")
    return obs.select("obs_id", C.is_garbage("input_a").alias("garbage_a"), C.is_garbage("output").alias("garbage_out"), C.concept_defect("output").alias("reason"))


@plans.add(f"""SELECT doc_id, {B.defect('title')} AS reason FROM documents""")
def title_quality(spark: SparkSession, d: str) -> DataFrame:
    """F2 on whole titles, which break more of its rules."""
    return table(spark, d, "documents").select("doc_id", C.concept_defect("title").alias("reason"))


@plans.add(f"""SELECT obs_id, {B.recipe_defect('a', 'b', 'o')} AS reason FROM (SELECT obs_id, {B.key('input_a')} AS a, {B.key('input_b')} AS b, {B.key('output')} AS o FROM recipe_observations)""")
def recipe_quality(spark: SparkSession, d: str) -> DataFrame:
    """F3."""
    k = table(spark, d, "recipe_observations").select("obs_id", X.key("input_a").alias("a"), X.key("input_b").alias("b"), X.key("output").alias("o"))
    return k.select("obs_id", C.recipe_defect("a", "b", "o").alias("reason"))


@plans.add(f"""SELECT obs_id FROM (SELECT obs_id, {B.concept("coalesce(output, '')")} AS o, {B.concept('input_a')} AS a, {B.concept('input_b')} AS b FROM recipe_observations)
    WHERE o <> '' AND o <> a AND o <> b AND length(o) <= 48 AND len(string_split(o, ' ')) <= 5""")
def usable_generations(spark: SparkSession, d: str) -> DataFrame:
    """F9."""
    return table(spark, d, "recipe_observations").filter(C.usable_generation("output", "input_a", "input_b")).select("obs_id")


@plans.add("""SELECT source, n, starts_with(source, 'chatdump') OR source IN ('wordlab', 'arena_log') AS matches FROM (SELECT source, count(*) AS n FROM recipe_observations WHERE source IS NOT NULL GROUP BY 1)""")
def source_rules(spark: SparkSession, d: str) -> DataFrame:
    """F5."""
    rows = table(spark, d, "recipe_observations").filter("source is not null").groupBy("source").agg(F.count("*").alias("n"))
    return rows.select("source", "n", C.source_matches("source", ("wordlab", "arena_log"), ("chatdump",)).alias("matches"))


@plans.add(f"SELECT obs_id, output FROM recipe_observations WHERE contains(lower(output), 'fire')")
def inventory_search(spark: SparkSession, d: str) -> DataFrame:
    """F13."""
    return table(spark, d, "recipe_observations").filter(F.lower("output").contains("fire")).select("obs_id", "output")


@plans.add("SELECT obs_id, ltrim(output, ' ') AS fixed FROM recipe_observations WHERE starts_with(output, ' ')")
def leading_spaces(spark: SparkSession, d: str) -> DataFrame:
    """F19."""
    return table(spark, d, "recipe_observations").filter(F.col("output").rlike("^ ")).select("obs_id", F.ltrim("output").alias("fixed"))
