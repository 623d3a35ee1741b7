"""Queries over step logs: orders' lines as agent runs, averages by day as training logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tinctura.operators import series as Z
from tinctura.plans.base import Plans, concept
from tinctura.storage import table

plans = Plans()
queries, oracle_sql = plans.queries, plans.oracle_sql

_FNV = "list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split(lower(name), ''), lambda c: CAST(ord(c) AS BIGINT))), lambda x, c: (xor(x, c) * 16777619) % 4294967296)"
_FALLBACK = "[" + ", ".join(f"'{e}'" for e in Z.FALLBACK_EMOJI) + "]"


@plans.add(f"""WITH k AS (SELECT canonical_output AS concept, min(canonical_emoji) AS emoji FROM recipe_canonical_v0 WHERE canonical_output NOT LIKE '% %' AND canonical_emoji <> '⚪' AND length(canonical_output) % 2 = 0 GROUP BY 1),
    n AS (SELECT DISTINCT canonical_output AS name FROM recipe_canonical_v0), t AS (SELECT name, unnest(list_prepend(name, list_reverse(string_split(name, ' ')))) AS concept, unnest(range(len(string_split(name, ' ')) + 1)) AS nth FROM n),
    f AS (SELECT name, arg_min(k.emoji, nth) FILTER (k.emoji IS NOT NULL) AS emoji FROM t LEFT JOIN k USING (concept) GROUP BY 1) SELECT name, coalesce(emoji, {_FALLBACK}[CAST({_FNV} % 20 AS INTEGER) + 1]) AS emoji FROM f""")
def concept_emoji(spark: SparkSession, d: str) -> DataFrame:
    """P18, P20."""
    c = table(spark, d, "recipe_canonical_v0")
    known = c.filter("canonical_output not like '% %' and canonical_emoji <> '⚪' and length(canonical_output) % 2 = 0").groupBy(F.col("canonical_output").alias("concept")).agg(F.min("canonical_emoji").alias("emoji"))
    return Z.concept_emoji(c.select(F.col("canonical_output").alias("name")), known)


@plans.add(f"""WITH k AS (SELECT canonical_output AS concept, min(canonical_emoji) AS emoji FROM recipe_canonical_v0 WHERE canonical_output NOT LIKE '% %' AND canonical_emoji <> '⚪' AND length(canonical_output) % 2 = 0 GROUP BY 1),
    n AS (SELECT {concept('input_a')} AS name, min(emoji_a) AS given FROM recipe_canonical_v0 GROUP BY 1), t AS (SELECT name, unnest(list_prepend(name, list_reverse(string_split(name, ' ')))) AS concept, unnest(range(len(string_split(name, ' ')) + 1)) AS nth FROM n),
    f AS (SELECT name, arg_min(k.emoji, nth) FILTER (k.emoji IS NOT NULL) AS emoji FROM t LEFT JOIN k USING (concept) GROUP BY 1) SELECT name AS id, name, coalesce(given, f.emoji, {_FALLBACK}[CAST({_FNV} % 20 AS INTEGER) + 1]) AS emoji FROM n JOIN f USING (name)""")
def element_tokens(spark: SparkSession, d: str) -> DataFrame:
    """P17."""
    c = table(spark, d, "recipe_canonical_v0")
    known = c.filter("canonical_output not like '% %' and canonical_emoji <> '⚪' and length(canonical_output) % 2 = 0").groupBy(F.col("canonical_output").alias("concept")).agg(F.min("canonical_emoji").alias("emoji"))
    return Z.element_tokens(c.select(F.col("input_a").alias("name"), F.col("emoji_a").alias("given")), known)


_STEPS = "st AS (SELECT l_orderkey AS run, l_partkey % 40 AS output, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS idx FROM lineitem)"


def _steps(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run"), (F.col("l_partkey") % 40).alias("output"), "l_quantity", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return Z.numbered(li, "run", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity").select("run", "output", "l_quantity", "index")


@plans.add(f"""WITH {_STEPS}, e AS (SELECT run, min(CASE WHEN l_quantity > 45 THEN idx END) AS bad, arg_min(CASE WHEN l_quantity > 48 THEN 'model_error' WHEN l_quantity > 46 THEN 'invalid_action' ELSE 'combine_error' END, idx) FILTER (l_quantity > 45) AS why, min(CASE WHEN output = 7 AND l_quantity <= 45 THEN idx END) AS hit, count(*) AS n FROM st WHERE idx <= 5 GROUP BY 1)
    SELECT run, CASE WHEN hit IS NOT NULL AND (bad IS NULL OR hit < bad) THEN 'target_reached' WHEN bad IS NOT NULL THEN why WHEN n >= 5 THEN 'budget_exhausted' ELSE 'open' END AS stop_reason, hit IS NOT NULL AND (bad IS NULL OR hit < bad) AS success,
    CASE WHEN hit IS NOT NULL AND (bad IS NULL OR hit < bad) THEN hit WHEN bad IS NOT NULL THEN bad - 1 ELSE n END AS combinations FROM e""")
def run_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """D20."""
    q = F.col("l_quantity")
    return Z.outcomes(_steps(spark, d), "run", F.col("output") == 7, F.when(q > 48, "model_error").when(q > 46, "invalid_action").when(q > 45, "combine_error"), 5)


@plans.add(f"""WITH {_STEPS}, f AS (SELECT *, row_number() OVER (PARTITION BY run, output ORDER BY idx) = 1 AS new FROM st) SELECT run, CAST(idx AS INTEGER) AS step, new, CAST(sum(CAST(new AS INTEGER)) OVER (PARTITION BY run ORDER BY idx ROWS UNBOUNDED PRECEDING) AS BIGINT) AS inventory FROM f""")
def playback(spark: SparkSession, d: str) -> DataFrame:
    """D21."""
    return Z.playback(_steps(spark, d), "run", "output").select("run", F.col("index").alias("step"), "new", "inventory")


@plans.add("SELECT DISTINCT n_name FROM nation")
def inventory_list(spark: SparkSession, d: str) -> DataFrame:
    """O14."""
    return Z.alphabetical(table(spark, d, "nation"), "n_name")


_LOG = "lg AS (SELECT event_type AS run, CAST(floor(epoch(ts)) AS BIGINT) // 3600 % 1000 + 1 AS step, avg(value) AS loss FROM events GROUP BY 1, 2)"


def _log(spark: SparkSession, d: str) -> DataFrame:
    step = (F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600) % 1000 + 1).cast("long")
    return table(spark, d, "events").groupBy(F.col("event_type").alias("run"), step.alias("step")).agg(F.avg("value").alias("loss"))


@plans.add(f"WITH {_LOG} SELECT run, CAST((step - 1) // 50 * 50 + 50 AS BIGINT) AS step, avg(loss) AS mean FROM lg GROUP BY 1, 2", fractions="mean")
def logged_means(spark: SparkSession, d: str) -> DataFrame:
    """2.7: means between log points."""
    return Z.averaged(_log(spark, d), "run", "step", "loss", 50)


@plans.add(f"WITH {_LOG}, b AS (SELECT *, min(loss) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM lg) SELECT run, step, least(before, loss) AS best, before IS NULL OR loss < before AS improved FROM b", fractions="best")
def best_losses(spark: SparkSession, d: str) -> DataFrame:
    """2.7: the best so far."""
    return Z.best_so_far(_log(spark, d), "run", "step", "loss")


@plans.add(f"WITH {_LOG} SELECT run, step FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY step DESC) AS n FROM lg) WHERE n > 3")
def old_checkpoints(spark: SparkSession, d: str) -> DataFrame:
    """2.7: all but the last three."""
    return Z.superseded(_log(spark, d).select("run", "step"), "run", "step", 3)
