"""The recipe graph: reachability, costs, lookups and exports."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Observation, functions as F

from tinctura.functions.hashing import packed_id
from tinctura.operators.skew import BROADCAST_BYTES, lookup, numbered
from tinctura.storage import materialize, measured

# The result of a pair that makes nothing; parts of a name that a comma cut in two.
NOTHING = "Nothing"
FRAGMENTS = ("20", "000 Leagues Under the Sea")
# End of fixed values.


def cleaned(recipes: DataFrame) -> DataFrame:
    """distinct recipes without those made of nothing, or that hold a fragment of a name."""
    return recipes.filter(~F.col("a").isin(NOTHING, *FRAGMENTS) & ~F.col("b").isin(NOTHING, *FRAGMENTS) & ~F.col("c").isin(*FRAGMENTS)).select("a", "b", "c").dropDuplicates()


def with_visibility(recipes: DataFrame) -> DataFrame:
    """``visible`` is false for recipes that make nothing or one of their inputs."""
    return recipes.withColumn("visible", (F.col("c") != NOTHING) & (F.col("c") != F.col("a")) & (F.col("c") != F.col("b")))


def report_order() -> list[Column]:
    """The order of ``listed`` recipes in a report: nothing last, then cost and name of the output, then of the inputs."""
    return [F.col("c") == NOTHING, F.col("cost_c"), F.col("c"), F.col("cost_a") + F.col("cost_b"), F.col("cost_a"), F.col("a"), F.col("cost_b"), F.col("b")]


def pool(recipes: DataFrame) -> DataFrame:
    """Distinct recipes ``a <= b -> c`` without nothing, without identities."""
    rows = recipes.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "c")
    return rows.filter("a is not null and b is not null and c is not null and a <> c and b <> c").dropDuplicates()


def levels(edges: DataFrame, starters: DataFrame, *, cost: str = "depth") -> DataFrame:
    """``node, cost`` of every node that can be made; starters have ``cost``.

    cost ``depth``: 1 + the deeper input; ``sum``: the sum of both inputs. Rounds of joins until nothing improves,
    however deep the graph, so recipes with an input out of reach don't hold it up. Sums of negative starters could
    improve forever and are an error. Only recipes with an input that improved in the round before are worked out
    again; a round keeps the least cost per node with map-side combining, is written, which cuts the lineage, and
    counts what improved as it is written. The state is broadcast while it measures little; else both joins are by
    shuffle.
    """
    plus = (lambda x, y: F.greatest(x, y) + 1) if cost == "depth" else (lambda x, y: x + y)
    first = starters.select("node", F.col("cost").cast("long").alias("cost")).groupBy("node").agg(F.min("cost").alias("cost")).withColumn("new", F.lit(True))
    known, size = measured(first, "levels")
    if cost == "sum" and known.filter("cost < 0").take(1):
        raise ValueError("starters with negative costs")
    edges = materialize(edges.select("a", "b", "c"), "edges")
    for i in count():
        small = F.broadcast if size <= BROADCAST_BYTES else lambda df: df
        left, right = known.select(F.col("node").alias("a"), F.struct("cost", "new").alias("x")), known.select(F.col("node").alias("b"), F.struct("cost", "new").alias("y"))
        reached = edges.join(small(left), "a").join(small(right), "b").filter("x.new or y.new")
        made = reached.select(F.col("c").alias("node"), plus(F.col("x.cost"), F.col("y.cost")).alias("cost"), F.lit(None).cast("long").alias("was"))
        both = known.select("node", "cost", F.col("cost").alias("was")).unionByName(made)
        state = both.groupBy("node").agg(F.min("cost").alias("cost"), F.min("was").alias("was"))
        seen = Observation()
        state = state.select("node", "cost", (F.col("was").isNull() | (F.col("cost") < F.col("was"))).alias("new"))
        known, size = measured(state.observe(seen, F.count_if("new").alias("new")), f"levels-{i}")
        if not seen.get["new"]:
            return known.select("node", "cost")


def witnesses(edges: DataFrame, starters: DataFrame, max_depth: int) -> DataFrame:
    """D17 for a pool of any size: ``node, path``: recipes (a, b, c) that make the node from the starters, in order.

    ``max_depth`` rounds at most, each joining both inputs' paths of the round before. A path is the ordered union, by
    output, of its inputs' paths and the recipe; of a node's new paths the shortest, of equals the first by recipe, is
    kept where it is strictly shorter than the one before; longer ones than ``max_depth`` don't count. Starters aren't
    made. (``witness_paths`` uses within a round what it made before, in the order of its recipes.)
    """
    step = "struct<a:string,b:string,c:string>"
    edges = materialize(edges.join(starters.select(F.col("node").alias("c")).distinct(), "c", "left_anti").select("a", "b", "c"), "edges")
    begin = starters.select("node").distinct().select("node", F.array().cast(f"array<{step}>").alias("path"), F.lit(True).alias("new"))
    known, size = measured(begin, "witnesses")
    for i in range(max_depth):
        small = F.broadcast if size <= BROADCAST_BYTES else lambda df: df
        left, right = known.select(F.col("node").alias("a"), F.struct("path", "new").alias("x")), known.select(F.col("node").alias("b"), F.struct("path", "new").alias("y"))
        reached = edges.join(small(left), "a").join(small(right), "b").filter("x.new or y.new")
        apart = lambda p: F.filter(p, lambda s: ~F.exists("x.path", lambda t: t["c"] == s["c"]))
        union = F.concat("x.path", apart(F.col("y.path")))
        own = F.struct(*[F.col(k).cast("string").alias(k) for k in "abc"])
        path = F.when(F.exists(union, lambda s: s["c"] == F.col("c")), union).otherwise(F.concat(union, F.array(own)))
        made = reached.select(F.col("c").alias("node"), path.alias("path")).filter(F.size("path") <= max_depth)
        rated = lambda df, was: df.select("node", F.struct(F.size("path").alias("n"), (~F.lit(was)).alias("made"), "path").alias("p"))
        both = rated(known, True).unionByName(rated(made, False))
        state = both.groupBy("node").agg(F.min("p").alias("p")).select("node", "p.path", F.col("p.made").alias("new"))
        seen = Observation()
        known, size = measured(state.observe(seen, F.count_if("new").alias("new")), f"witnesses-{i}")
        if not seen.get["new"]:
            break
    return known.filter(F.size("path") > 0).select("node", "path")


def witness_paths(recipes: list[tuple[str, str, str]], starters: list[str], max_depth: int) -> dict[str, list[tuple[str, str, str]]]:
    """For each node that can be made the recipes that make it, in order; for a pool that fits on the driver.

    Passes over the recipes in the order given, at most ``max_depth``, each using what the pass made so far. A node's
    path is the ordered union of its inputs' paths and the recipe; a strictly shorter one replaces it; paths longer
    than ``max_depth`` don't count.
    """
    paths: dict[str, list[tuple[str, str, str]]] = {s: [] for s in starters}
    for _ in range(max_depth):
        changed = False
        for a, b, c in recipes:
            if a in paths and b in paths:
                union: dict[str, tuple[str, str, str]] = {}
                for step in (*paths[a], *paths[b], (a, b, c)):
                    union.setdefault(step[2], step)
                path = list(union.values())
                if len(path) <= max_depth and (c not in paths or len(path) < len(paths[c])):
                    paths[c], changed = path, True
        if not changed:
            break
    return {k: v for k, v in paths.items() if v}


def replays(path: list[tuple[str, str, str]], starters: list[str], target: str) -> bool:
    """Whether the path's recipes, one by one, can be made and end with the target."""
    have = set(starters)
    for a, b, c in path:
        if a not in have or b not in have:
            return False
        have.add(c)
    return bool(path) and path[-1][2] == target


def goal(nodes: DataFrame, depth: int, draw: Column) -> DataFrame:
    """A node of the wanted depth, else of the nearest (less deep first); ``draw`` in [0, 1) picks among them."""
    sized = nodes.filter("cost > 0").withColumn("off", F.abs(F.col("cost") - depth) * 2 + (F.col("cost") > depth).cast("int"))
    best = sized.agg(F.min("off").alias("off"))
    pick = numbered(sized.join(F.broadcast(best), "off").drop("off"), "node", name="n")  # one row
    total = pick.agg(F.count("*").alias("all"))
    return pick.join(F.broadcast(total), F.col("n") == F.floor(draw * F.col("all"))).select("node", "cost")


def uses(edges: DataFrame) -> DataFrame:
    """``element, as_input, made_by``: how many recipes use, and how many make, each element."""
    ins = edges.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("element"), F.lit(1).alias("i"), F.lit(0).alias("o"))
    outs = edges.select(F.col("c").alias("element"), F.lit(0).alias("i"), F.lit(1).alias("o"))
    return ins.unionByName(outs).groupBy("element").agg(F.sum("i").alias("as_input"), F.sum("o").alias("made_by"))


def links(edges: DataFrame) -> DataFrame:
    """A row per direction: ``element, kind (from, to), a, b, c``; adjacency without lists of unbounded length."""
    to = edges.select(F.col("c").alias("element"), F.lit("from").alias("kind"), "a", "b", "c")
    return edges.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("element"), F.lit("to").alias("kind"), "a", "b", "c").unionByName(to)


def chunk(i: Column) -> Column:
    """The chunk of the i-th element: few elements in the first chunks, more in later ones."""
    return (F.floor(8 * F.log1p(i / 50.0)) + 1).cast("int")


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Recipes in one set only, with the side."""
    only = lambda x, y, side: x.join(y, x.columns, "left_anti").distinct().withColumn("side", F.lit(side))
    return only(left, right, "left").unionByName(only(right, left, "right"))


def untried(queries: DataFrame, elements: DataFrame, tried: DataFrame) -> DataFrame:
    """Pairs ``a <= b`` of a query element and any element that no recipe has tried.

    The result holds a row for nearly every pair, so the queries are a stated, short list: they are sent to each task
    as one array, whose size is the caller's choice, and each element meets them where it is. Pairs of two queries
    come out once.
    """
    names = queries.select("element").distinct().agg(F.array_sort(F.collect_list("element")).alias("qs"))
    each = elements.select("element").distinct().join(F.broadcast(names)).select("element", F.explode("qs").alias("q"), "qs")
    pairs = each.filter((F.col("q") <= F.col("element")) | ~F.array_contains("qs", F.col("element"))).select(F.least("q", "element").alias("a"), F.greatest("q", "element").alias("b"))
    return pairs.join(tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), ["a", "b"], "left_anti")


def listed(edges: DataFrame, costs: DataFrame) -> DataFrame:
    """Recipes with the costs of output and inputs; a report takes the first in ``report_order``."""
    cost, size = measured(costs.select("node", "cost"), "costs")
    out = edges
    for side in ("c", "a", "b"):
        out = lookup(out, cost.select(F.col("node").alias(side), F.col("cost").alias(f"cost_{side}")), [side], size=size)
    return out.select("a", "b", "c", "cost_a", "cost_b", "cost_c")


def packed(names: DataFrame, recipes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A dictionary ``id, code, name`` in the order of cost and name, and recipes in its codes.

    Ids are numbered by range-sorted partitions, so no task sorts all names.
    """
    ids = numbered(names.select("name", "cost"), "cost", "name", name="id").select("id", "name")
    coded, size = measured(ids.withColumn("code", packed_id("id")), "codes")
    out = recipes
    for side in ("a", "b", "c"):
        out = lookup(out, coded.select(F.col("name").alias(side), F.col("code").alias(f"{side}_code")), [side], how="inner", size=size)
    return coded, out.select(F.concat_ws(",", "a_code", "b_code", "c_code").alias("line"))
