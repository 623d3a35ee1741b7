"""Queries from observations to canonical pairs, reports and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tinctura.functions.hashing import split_of
from tinctura.operators import canonical as S
from tinctura.operators.sampling import reservoir
from tinctura.plans import base as B
from tinctura.plans.base import Plans
from tinctura.sources.writers import load_counts
from tinctura.storage import materialize, table

plans = Plans()
queries, oracle_sql = plans.queries, plans.oracle_sql

CLEANING = S.Cleaning(untrusted=("scrape_misc",), untrusted_prefixes=("player_",), trusted=("wordlab", "teacher_pass"), trusted_prefixes=("chatdump_",))

_KEYS = f"""k AS (SELECT * FROM (SELECT obs_id AS pos, {B.key('input_a')} AS a, {B.key('input_b')} AS b, {B.key('output')} AS o, emoji_a, emoji_b, emoji_output, coalesce(source, '') AS source FROM recipe_observations)
    WHERE a <> '' AND b <> '' AND o <> ''),
q AS (SELECT *, CASE WHEN {B.garbage('a')} OR {B.garbage('b')} OR {B.garbage('o')} THEN 'garbage' ELSE {B.recipe_defect('a', 'b', 'o')} END AS base FROM k),
v AS (SELECT DISTINCT c FROM (SELECT unnest([{B.concept('input_a')}, {B.concept('input_b')}, {B.concept('output')}]) AS c FROM recipe_observations WHERE source IN ('wordlab', 'teacher_pass') OR starts_with(source, 'chatdump_')) WHERE c <> ''),
j AS (SELECT *, CASE WHEN base IS NULL AND (source = 'scrape_misc' OR starts_with(source, 'player_')) AND (a NOT IN (SELECT c FROM v) OR b NOT IN (SELECT c FROM v) OR o NOT IN (SELECT c FROM v)) THEN 'untrusted_source_vocab' ELSE base END AS reason FROM q)"""

_CANON = f"""{_KEYS},
g AS (SELECT *, least(a, b) AS lo, greatest(a, b) AS hi FROM j WHERE reason IS NULL),
em AS (SELECT concept, emoji, count(*) AS n, min(nth) AS nth FROM (SELECT a AS concept, emoji_a AS emoji, pos * 3 AS nth FROM g UNION ALL SELECT b, emoji_b, pos * 3 + 1 FROM g UNION ALL SELECT o, emoji_output, pos * 3 + 2 FROM g)
       WHERE emoji <> '' AND emoji <> '⚪' GROUP BY 1, 2),
e AS (SELECT concept, emoji FROM (SELECT *, row_number() OVER (PARTITION BY concept ORDER BY n DESC, nth) AS r FROM em) WHERE r = 1),
c AS (SELECT lo, hi, o, count(*) AS n, min(pos) AS pos FROM g GROUP BY 1, 2, 3),
ce AS (SELECT c.*, coalesce(e.emoji, '⚪') AS emoji, row_number() OVER (PARTITION BY lo, hi ORDER BY n DESC, pos) AS r FROM c LEFT JOIN e ON e.concept = c.o),
s AS (SELECT lo, hi, list_sort(list_distinct(list(source) FILTER (source <> ''))) AS sources FROM g GROUP BY 1, 2),
p AS (SELECT lo, hi, list(o ORDER BY o) AS known_outputs, list(emoji ORDER BY o) AS known_emojis, list(n ORDER BY o) AS observation_counts, max(CASE WHEN r = 1 THEN o END) AS canonical_output, max(CASE WHEN r = 1 THEN emoji END) AS canonical_emoji FROM ce GROUP BY 1, 2),
canon AS (SELECT sha256('[' || to_json(lo) || ',' || to_json(hi) || ']') AS pair_id, lo || '+' || hi AS pair_key, lo AS input_a, hi AS input_b,
    coalesce(ea.emoji, '⚪') AS emoji_a, coalesce(eb.emoji, '⚪') AS emoji_b, known_outputs, known_emojis, canonical_output, canonical_emoji, observation_counts, coalesce(sources, []) AS sources, CAST(coalesce(len(sources), 0) AS INTEGER) AS source_count,
    CAST(len(known_outputs) AS INTEGER) AS pair_num_outputs, len(known_outputs) > 1 AS is_conflicting_pair, {B.split('lo', 'hi')} AS split, CASE WHEN canonical_output = lo OR canonical_output = hi THEN 'review_identity' ELSE 'keep' END AS status
    FROM p JOIN s USING (lo, hi) LEFT JOIN e ea ON ea.concept = lo LEFT JOIN e eb ON eb.concept = hi)"""


def _obs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "recipe_observations")


@plans.add(f"WITH {_CANON} SELECT * FROM canon")
def canonical_pairs(spark: SparkSession, d: str) -> DataFrame:
    """A1, A2, A3, D1, D2, D4, F4, J6, J7, O12."""
    return S.canonical_pairs(_obs(spark, d), CLEANING)


@plans.add(f"""WITH {_CANON} SELECT count(*) AS num_canonical_pairs, count(*) FILTER (is_conflicting_pair) AS num_conflicting_pairs, count(*) FILTER (status = 'keep') AS num_keep, count(*) FILTER (status = 'review_identity') AS num_review_identity,
    count(*) FILTER (split = 'train') AS train_pairs, count(*) FILTER (split = 'dev') AS dev_pairs, count(*) FILTER (split = 'test') AS test_pairs,
    (SELECT count(*) FROM j WHERE reason = 'garbage') AS num_garbage_discarded, (SELECT count(*) FROM j WHERE reason <> 'garbage') AS num_quality_discarded FROM canon""")
def clean_metrics(spark: SparkSession, d: str) -> DataFrame:
    """A5, K5."""
    return S.clean_metrics(materialize(S.judged(_obs(spark, d), CLEANING), "judged"), CLEANING)


@plans.add(f"WITH {_KEYS} SELECT reason, count(*) AS n FROM j WHERE reason IS NOT NULL GROUP BY 1")
def reject_reasons(spark: SparkSession, d: str) -> DataFrame:
    """A6, K4."""
    return S.reject_histogram(S.judged(_obs(spark, d), CLEANING))


@plans.add(f"WITH {_KEYS} SELECT pos, a AS input_a, b AS input_b, o AS output, source, reason FROM j WHERE reason <> 'garbage' ORDER BY pos LIMIT 500")
def reject_sample(spark: SparkSession, d: str) -> DataFrame:
    """A sample of a fixed size is the feature."""
    return S.reject_sample(S.judged(_obs(spark, d), CLEANING))


@plans.add(f"WITH {_KEYS} SELECT c AS concept FROM v")
def trusted_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """D2."""
    return S.vocabulary(_obs(spark, d), CLEANING.trusted, CLEANING.trusted_prefixes)


@plans.add(f"""WITH k AS (SELECT least({B.key("coalesce(input_a, '')")}, {B.key("coalesce(input_b, '')")}) AS lo, greatest({B.key("coalesce(input_a, '')")}, {B.key("coalesce(input_b, '')")}) AS hi, {B.key("coalesce(output, '')")} AS o, source FROM recipe_observations),
    u AS (SELECT DISTINCT lo, hi, o FROM k)
    SELECT count(*) AS num_observations, (SELECT count(*) FROM (SELECT DISTINCT lo, hi FROM k)) AS num_unique_pairs, (SELECT count(*) FROM u) AS num_unique_recipes, count(*) FILTER (o = '') AS empty_output_count,
    (SELECT count(*) FROM (SELECT lo, hi FROM u GROUP BY 1, 2 HAVING count(*) > 1)) AS conflicting_pair_count, count(DISTINCT source) FILTER (source <> '') AS num_sources, count(*) - (SELECT count(*) FROM u) AS duplicate_recipe_count FROM k""")
def validation_report(spark: SparkSession, d: str) -> DataFrame:
    """A7, A31."""
    return S.validation_report(_obs(spark, d))


_REGISTRY = f"""r AS (SELECT concept, emoji FROM (SELECT *, row_number() OVER (PARTITION BY concept ORDER BY emoji = '⚪', obs_id) AS n FROM (SELECT obs_id, {B.key('output')} AS concept, emoji_output AS emoji FROM recipe_observations) WHERE concept <> '' AND emoji <> '') WHERE n = 1)"""


@plans.add(f"WITH {_REGISTRY} SELECT concept, emoji FROM r")
def emoji_registry(spark: SparkSession, d: str) -> DataFrame:
    """A4."""
    return S.emoji_registry(_obs(spark, d))


@plans.add(f"""WITH {_REGISTRY}, o AS (SELECT obs_id AS pos, {B.strip('input_a')} AS a, {B.strip('input_b')} AS b, {B.strip('output')} AS output, emoji_output AS eo, source FROM recipe_observations),
    w AS (SELECT pos, CASE WHEN lower(a) <= lower(b) THEN a ELSE b END AS input_a, CASE WHEN lower(a) <= lower(b) THEN b ELSE a END AS input_b, output, eo, source FROM o)
    SELECT pos, input_a, input_b, output, ra.emoji AS emoji_a, rb.emoji AS emoji_b, coalesce(nullif(eo, ''), ro.emoji) AS emoji_output, source
    FROM w LEFT JOIN r ra ON ra.concept = {B.key('input_a')} LEFT JOIN r rb ON rb.concept = {B.key('input_b')} LEFT JOIN r ro ON ro.concept = {B.key('output')}""")
def backfilled(spark: SparkSession, d: str) -> DataFrame:
    """P4, J5."""
    return S.backfilled(_obs(spark, d))


@plans.add("SELECT input_a, input_b, known_outputs AS outputs, split FROM recipe_canonical_v0")
def gold_recipes(spark: SparkSession, d: str) -> DataFrame:
    """K2's rows."""
    return S.gold(table(spark, d, "recipe_canonical_v0"))


@plans.add("SELECT split, count(*) AS pairs, CAST(sum(len(known_outputs)) AS BIGINT) AS candidates FROM recipe_canonical_v0 GROUP BY 1")
def split_counts(spark: SparkSession, d: str) -> DataFrame:
    """A29, K12."""
    return load_counts(table(spark, d, "recipe_canonical_v0"))


@plans.add(f"""WITH r AS (SELECT {B.key('input_a')} AS a, {B.key('input_b')} AS b, split FROM recipe_canonical_v0 UNION ALL SELECT {B.key('input_a')}, {B.key('input_b')}, split FROM eval_records)
    SELECT least(a, b) AS input_a, greatest(a, b) AS input_b, count(DISTINCT split) AS splits FROM r GROUP BY 1, 2 HAVING count(DISTINCT split) > 1""")
def split_leaks(spark: SparkSession, d: str) -> DataFrame:
    """D3: pairs that the canonical table and the exported evaluation items put in different splits."""
    c, e = (table(spark, d, t).select(S.key("input_a").alias("input_a"), S.key("input_b").alias("input_b"), "split") for t in ("recipe_canonical_v0", "eval_records"))
    return S.split_leaks(c.unionByName(e))


@plans.add(f"SELECT count(*) AS pairs, 0 AS leaks FROM (SELECT DISTINCT least(input_a, input_b), greatest(input_a, input_b) FROM recipe_canonical_v0)")
def split_check(spark: SparkSession, d: str) -> DataFrame:
    """Splits by the pair never leak."""
    c = table(spark, d, "recipe_canonical_v0").withColumn("split", split_of(F.least("input_a", "input_b"), F.greatest("input_a", "input_b")))
    splits = c.groupBy(F.least("input_a", "input_b").alias("a"), F.greatest("input_a", "input_b").alias("b")).agg(F.countDistinct("split").alias("n"))
    return splits.agg(F.count("*").alias("pairs"), F.count_if(F.col("n") > 1).cast("int").alias("leaks"))


@plans.add("SELECT row_id, pair_key, split FROM recipe_canonical_v0 WHERE split = 'test' ORDER BY sha256(row_id || '|42'), row_id LIMIT 100")
def eval_sample(spark: SparkSession, d: str) -> DataFrame:
    """A sample of a fixed size is the feature."""
    return reservoir(table(spark, d, "recipe_canonical_v0").filter("split = 'test'").select("row_id", "pair_key", "split"), 100, F.col("row_id"))


@plans.add(f"SELECT input_a, input_b, count(*) AS n FROM (SELECT least({B.key('input_a')}, {B.key('input_b')}) AS input_a, greatest({B.key('input_a')}, {B.key('input_b')}) AS input_b FROM recipe_observations WHERE input_a IS NOT NULL AND input_b IS NOT NULL) GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_pairs(spark: SparkSession, d: str) -> DataFrame:
    """A26, D29."""
    k = S.key
    rows = _obs(spark, d).filter("input_a is not null and input_b is not null").select(F.least(k("input_a"), k("input_b")).alias("input_a"), F.greatest(k("input_a"), k("input_b")).alias("input_b"))
    return S.duplicate_keys(rows, "input_a", "input_b")


@plans.add("SELECT obs_id, source FROM recipe_observations WHERE source IS NULL OR source NOT IN (SELECT source FROM source_trust WHERE source IS NOT NULL)")
def orphan_sources(spark: SparkSession, d: str) -> DataFrame:
    """A foreign key."""
    return S.orphans(_obs(spark, d).select("obs_id", "source"), table(spark, d, "source_trust"), ["source"])


@plans.add("SELECT eval_id, split, source FROM eval_records WHERE source NOT IN ('eval_test_full', 'eval_dev_full')")
def outside_sources(spark: SparkSession, d: str) -> DataFrame:
    """An enumeration."""
    return S.outside(table(spark, d, "eval_records").select("eval_id", "split", "source"), "source", ("eval_test_full", "eval_dev_full"))


@plans.add(f"""WITH o AS (SELECT least(x, y) AS a, greatest(x, y) AS b, o FROM (SELECT {B.key('input_a')} AS x, {B.key('input_b')} AS y, {B.key('output')} AS o FROM recipe_observations WHERE input_a IS NOT NULL AND input_b IS NOT NULL AND output IS NOT NULL)),
    dp AS (SELECT o.a, o.b, any_value(c.canonical_output) AS r, bool_or(o = c.canonical_output) AS had FROM o JOIN recipe_canonical_v0 c ON c.input_a = o.a AND c.input_b = o.b GROUP BY 1, 2 HAVING count(*) > 1)
    SELECT o.a AS input_a, o.b AS input_b, o AS output FROM o LEFT JOIN dp ON dp.a = o.a AND dp.b = o.b WHERE r IS NULL OR r = o UNION ALL SELECT a, b, r FROM dp WHERE NOT had""")
def repaired_recipes(spark: SparkSession, d: str) -> DataFrame:
    """D27."""
    rows = _obs(spark, d).filter("input_a is not null and input_b is not null and output is not null").select(*[S.key(c).alias(c) for c in ("input_a", "input_b", "output")])
    return S.repaired(rows, table(spark, d, "recipe_canonical_v0").select("input_a", "input_b", F.col("canonical_output").alias("output")))
