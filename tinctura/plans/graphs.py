"""Queries over the recipe graph: all canonical recipes; starters are the inputs that no recipe makes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tinctura.functions.hashing import PACKED_ALPHABET
from tinctura.operators import graph as G
from tinctura.plans.base import Plans
from tinctura.storage import materialize, table

plans = Plans()
queries, oracle_sql = plans.queries, plans.oracle_sql

_EDGES = """ed AS (SELECT DISTINCT least(input_a, input_b) AS a, greatest(input_a, input_b) AS b, canonical_output AS c FROM recipe_canonical_v0
    WHERE input_a <> canonical_output AND input_b <> canonical_output)"""


def _levels(start: int, plus: str) -> str:
    """SQL of each node's least cost: a table by key that rows replace while they improve it."""
    return f"""WITH RECURSIVE {_EDGES}, st AS (SELECT DISTINCT x AS node FROM (SELECT unnest([a, b]) AS x FROM ed) WHERE x NOT IN (SELECT c FROM ed)),
    lv(node, cost) USING KEY (node) AS (SELECT node, CAST({start} AS BIGINT) FROM st UNION
        SELECT c, min({plus}) FROM ed JOIN recurring.lv x ON x.node = a JOIN recurring.lv y ON y.node = b LEFT JOIN recurring.lv z ON z.node = c GROUP BY c, z.cost HAVING z.cost IS NULL OR min({plus}) < z.cost)
    SELECT node, cost FROM lv"""


_DEPTHS, _COSTS = _levels(0, "greatest(x.cost, y.cost) + 1"), _levels(1, "x.cost + y.cost")
#: Elements whose untried partners are listed, and steps of a witness path at most.
ASKED, STEPS = 5, 8


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return G.pool(table(spark, d, "recipe_canonical_v0").select(F.col("input_a").alias("a"), F.col("input_b").alias("b"), F.col("canonical_output").alias("c")))


def _unmade(edges: DataFrame, cost: int) -> DataFrame:
    inputs = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return inputs.join(edges.select(F.col("c").alias("node")).distinct(), "node", "left_anti").withColumn("cost", F.lit(cost).cast("long"))


@plans.add(f"WITH {_EDGES} SELECT a, b, c FROM ed")
def recipe_edges(spark: SparkSession, d: str) -> DataFrame:
    """D19, F18, F20."""
    return _edges(spark, d)


@plans.add(_DEPTHS)
def depths(spark: SparkSession, d: str) -> DataFrame:
    """Rounds of joins to a fixpoint."""
    e = materialize(_edges(spark, d), "whole")
    return G.levels(e, _unmade(e, 0))


@plans.add(_COSTS)
def sum_costs(spark: SparkSession, d: str) -> DataFrame:
    """D25."""
    e = materialize(_edges(spark, d), "whole")
    return G.levels(e, _unmade(e, 1), cost="sum")


@plans.add(f"""WITH dp AS ({_DEPTHS}), o AS (SELECT *, min(abs(cost - 5) * 2 + CAST(cost > 5 AS INTEGER)) OVER () AS best, abs(cost - 5) * 2 + CAST(cost > 5 AS INTEGER) AS off FROM dp WHERE cost > 0)
    SELECT node, cost FROM (SELECT *, row_number() OVER (ORDER BY node) - 1 AS n, count(*) OVER () AS al FROM o WHERE off = best) WHERE n = floor(0.4 * al)""")
def daily_goal(spark: SparkSession, d: str) -> DataFrame:
    """D18."""
    return G.goal(depths(spark, d), 5, F.lit(0.4))


@plans.add(f"""WITH {_EDGES}, x AS (SELECT a AS element, 1 AS i, 0 AS o FROM ed UNION ALL SELECT b, 1, 0 FROM ed WHERE a <> b UNION ALL SELECT c, 0, 1 FROM ed) SELECT element, CAST(sum(i) AS BIGINT) AS as_input, CAST(sum(o) AS BIGINT) AS made_by FROM x GROUP BY 1""")
def element_uses(spark: SparkSession, d: str) -> DataFrame:
    """A27, J20."""
    return G.uses(_edges(spark, d))


@plans.add(f"""WITH {_EDGES} SELECT a AS element, 'to' AS kind, a, b, c FROM ed UNION ALL SELECT b, 'to', a, b, c FROM ed WHERE a <> b UNION ALL SELECT c, 'from', a, b, c FROM ed""")
def element_links(spark: SparkSession, d: str) -> DataFrame:
    """A27."""
    return G.links(_edges(spark, d))


@plans.add("SELECT CAST(floor(8 * ln(1 + p_partkey / 50.0)) + 1 AS INTEGER) AS chunk, count(*) AS n FROM part GROUP BY 1")
def chunks(spark: SparkSession, d: str) -> DataFrame:
    """A28."""
    return table(spark, d, "part").groupBy(G.chunk(F.col("p_partkey")).alias("chunk")).agg(F.count("*").alias("n"))


@plans.add("""WITH l AS (SELECT DISTINCT input_a AS a, input_b AS b, known_outputs[1] AS c FROM recipe_canonical_v0), r AS (SELECT DISTINCT input_a AS a, input_b AS b, canonical_output AS c FROM recipe_canonical_v0)
    SELECT *, 'left' AS side FROM (SELECT * FROM l EXCEPT SELECT * FROM r) UNION ALL SELECT *, 'right' FROM (SELECT * FROM r EXCEPT SELECT * FROM l)""")
def recipe_difference(spark: SparkSession, d: str) -> DataFrame:
    """J17."""
    c = table(spark, d, "recipe_canonical_v0")
    return G.difference(c.select(F.col("input_a").alias("a"), F.col("input_b").alias("b"), F.get("known_outputs", F.lit(0)).alias("c")), c.select(F.col("input_a").alias("a"), F.col("input_b").alias("b"), F.col("canonical_output").alias("c")))


@plans.add(f"""WITH {_EDGES}, x AS (SELECT a AS element FROM ed UNION ALL SELECT b FROM ed WHERE a <> b), el AS (SELECT DISTINCT element AS e FROM x), qs AS (SELECT element AS e FROM x GROUP BY 1 ORDER BY count(*) DESC, element LIMIT {ASKED})
    SELECT DISTINCT least(q.e, el.e) AS a, greatest(q.e, el.e) AS b FROM qs q JOIN el ON true WHERE NOT EXISTS (SELECT 1 FROM ed WHERE ed.a = least(q.e, el.e) AND ed.b = greatest(q.e, el.e))""")
def untried_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Of the elements used most (a top-k list is the feature) with all elements."""
    e = _edges(spark, d)
    used = e.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("element"))
    most = used.groupBy("element").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "element").limit(ASKED)
    return G.untried(most, used, e)


@plans.add(f"""WITH co AS ({_COSTS}), {_EDGES} SELECT ed.a, ed.b, ed.c, x.cost AS cost_a, y.cost AS cost_b, z.cost AS cost_c FROM ed LEFT JOIN co x ON x.node = ed.a LEFT JOIN co y ON y.node = ed.b LEFT JOIN co z ON z.node = ed.c WHERE coalesce(z.cost, 0) <= 100""")
def priced_recipes(spark: SparkSession, d: str) -> DataFrame:
    """O11, F17."""
    return G.listed(_edges(spark, d), sum_costs(spark, d)).filter("coalesce(cost_c, 0) <= 100")


@plans.add(f"""WITH co AS ({_COSTS}), {_EDGES} SELECT ed.a, ed.b, ed.c, x.cost AS cost_a, y.cost AS cost_b, z.cost AS cost_c FROM ed JOIN co x ON x.node = ed.a JOIN co y ON y.node = ed.b JOIN co z ON z.node = ed.c
    ORDER BY ed.c = 'Nothing', z.cost, ed.c, x.cost + y.cost, x.cost, ed.a, y.cost, ed.b LIMIT 50""")
def cheapest_recipes(spark: SparkSession, d: str) -> DataFrame:
    """The first of a report."""
    return G.listed(_edges(spark, d), sum_costs(spark, d)).filter("cost_a is not null and cost_b is not null and cost_c is not null").orderBy(*G.report_order()).limit(50)


@plans.add("""WITH r AS (SELECT CASE WHEN row_id % 51 = 0 THEN 'Nothing' ELSE input_a END AS a, CASE WHEN row_id % 53 = 0 THEN '20' ELSE input_b END AS b, CASE WHEN row_id % 50 = 0 THEN 'Nothing' WHEN row_id % 57 = 0 THEN '000 Leagues Under the Sea' ELSE canonical_output END AS c FROM recipe_canonical_v0)
    SELECT DISTINCT a, b, c, c <> 'Nothing' AND c <> a AND c <> b AS visible FROM r WHERE a <> 'Nothing' AND b <> '20' AND c <> '000 Leagues Under the Sea'""")
def visible_recipes(spark: SparkSession, d: str) -> DataFrame:
    """recipes with faults put in."""
    n = F.col("row_id")
    a, b = F.when(n % 51 == 0, "Nothing").otherwise(F.col("input_a")), F.when(n % 53 == 0, "20").otherwise(F.col("input_b"))
    c = F.when(n % 50 == 0, "Nothing").when(n % 57 == 0, "000 Leagues Under the Sea").otherwise(F.col("canonical_output"))
    return G.with_visibility(G.cleaned(table(spark, d, "recipe_canonical_v0").select(a.alias("a"), b.alias("b"), c.alias("c"))))


_DIGIT = f"substr('{PACKED_ALPHABET}', CAST({{}} % 64 AS INTEGER) + 1, 1)"
_CODE = " || ".join(f"CASE WHEN n >= {64**k} THEN {_DIGIT.format(f'n // {64**k}')} ELSE '' END" for k in range(5, 0, -1)) + " || " + _DIGIT.format("n")


@plans.add(f"""WITH co AS ({_COSTS}), {_EDGES}, nm AS (SELECT DISTINCT unnest([a, b, c]) AS name FROM ed), nb AS (SELECT name, row_number() OVER (ORDER BY coalesce(cost, 1152921504606846976), name) - 1 AS n FROM nm LEFT JOIN co ON co.node = name), cd AS (SELECT name, {_CODE} AS code FROM nb)
    SELECT x.code || ',' || y.code || ',' || z.code AS line FROM ed JOIN cd x ON x.name = ed.a JOIN cd y ON y.name = ed.b JOIN cd z ON z.name = ed.c""")
def packed_recipes(spark: SparkSession, d: str) -> DataFrame:
    """Recipes in codes of a dictionary in the order of cost and name."""
    names = F.explode(F.array("a", "b", "c")).alias("name")
    costs = sum_costs(spark, d).select(F.col("node").alias("name"), "cost")
    e = _edges(spark, d)
    return G.packed(e.select(names).distinct().join(costs, "name", "left").withColumn("cost", F.coalesce("cost", F.lit(1 << 60))), e)[1]


@plans.add()
def witness_lengths(spark: SparkSession, d: str) -> DataFrame:
    """The length of each node's path."""
    e = materialize(_edges(spark, d), "whole")
    return G.witnesses(e, _unmade(e, 0), STEPS).select("node", F.size("path").alias("length"))
