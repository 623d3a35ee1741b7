"""Step logs of agents and of training (survey ids D20, D21, O14, P18, S13, and the windows of 2.7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tinctura.functions.hashing import fnv1a
from tinctura.functions.text import concept, key
from tinctura.operators.skew import lookup

# Signs of concepts that have no emoji, by the hash of the name.
FALLBACK_EMOJI = ("✨", "🌀", "🔷", "🔶", "🟢", "🟣", "🟠", "🧿", "🎐", "🫧", "🌟", "💠", "🔺", "🧩", "🎲", "🪄", "🎇", "🌠", "🫟", "🪩")
# End of fixed values.


def concept_emoji(names: DataFrame, known: DataFrame) -> DataFrame:
    """``name, emoji`` of distinct names: that of the name, of its last word that has one, or a fallback.

    ``known``: ``concept, emoji``, one row per concept.
    """
    name = key("name")
    rows = names.select("name").distinct()
    tries = rows.select("name", F.posexplode(F.concat(F.array(name), F.reverse(F.split(name, r"[\s-]+")))).alias("at", "concept"))
    found = lookup(tries, known.select("concept", "emoji"), ["concept"]).groupBy("name").agg(F.min_by("emoji", F.when(F.col("emoji").isNotNull(), F.col("at"))).alias("emoji"))
    spare = F.element_at(F.array(*map(F.lit, FALLBACK_EMOJI)), (fnv1a(name) % len(FALLBACK_EMOJI)).cast("int") + 1)
    return found.select("name", F.coalesce("emoji", spare).alias("emoji"))


def element_tokens(rows: DataFrame, known: DataFrame) -> DataFrame:
    """``id, name, emoji`` of distinct elements (``name, given``): the emoji given, else that of the concept."""
    named = rows.select(concept("name").alias("name"), "given").filter("name <> ''").groupBy("name").agg(F.min("given").alias("given"))
    return named.join(concept_emoji(named, known), "name").select(F.col("name").alias("id"), "name", F.coalesce("given", "emoji").alias("emoji"))


def numbered(steps: DataFrame, run: str, *order: str | Column) -> DataFrame:
    """Steps with ``index`` from 1 within their run; a run's steps are few (a budget)."""
    return steps.withColumn("index", F.row_number().over(Window.partitionBy(run).orderBy(*order)))


def outcomes(steps: DataFrame, run: str, reached: Column, fault: Column, budget: int = 20) -> DataFrame:
    """How each run ended: at its first fault, at the target, or with its budget used up; else it is open.

    ``fault``: a step's reason to stop (model_error, invalid_action, combine_error), null if it went well.
    """
    rows = steps.filter(F.col("index") <= budget)
    ends = rows.groupBy(run).agg(F.min(F.when(fault.isNotNull(), F.struct("index", fault.alias("why")))).alias("bad"), F.min(F.when(reached & fault.isNull(), F.col("index"))).alias("hit"), F.count("*").alias("n"))
    target = F.col("hit").isNotNull() & (F.col("bad").isNull() | (F.col("hit") < F.col("bad.index")))
    reason = F.when(target, "target_reached").when(F.col("bad").isNotNull(), F.col("bad.why")).when(F.col("n") >= budget, "budget_exhausted").otherwise("open")
    return ends.select(run, reason.alias("stop_reason"), target.alias("success"), F.when(target, F.col("hit")).when(F.col("bad").isNotNull(), F.col("bad.index") - 1).otherwise(F.col("n")).cast("long").alias("combinations"))


def playback(steps: DataFrame, run: str, output: str) -> DataFrame:
    """Of each step whether its output is new and how many elements the run has made so far."""
    first = F.row_number().over(Window.partitionBy(run, output).orderBy("index")) == 1
    rows = steps.withColumn("new", first)
    return rows.withColumn("inventory", F.sum(F.col("new").cast("int")).over(Window.partitionBy(run).orderBy("index").rowsBetween(Window.unboundedPreceding, 0)))


def alphabetical(names: DataFrame, column: str) -> DataFrame:
    """Distinct names in the order of a dictionary, not of bytes, with ``place``; for a list shown to people."""
    shown = names.select(column).distinct()
    return shown.orderBy(F.collate(F.col(column), "UNICODE"))


def averaged(log: DataFrame, run: str, step: str, value: str, every: int) -> DataFrame:
    """The mean of a value between two points of the log."""
    return log.groupBy(run, (F.floor((F.col(step) - 1) / every) * every + every).alias("step")).agg(F.avg(value).alias("mean"))


def best_so_far(log: DataFrame, run: str, step: str, value: str) -> DataFrame:
    """The least value up to each point of a run's log, and whether the point improves on it."""
    w = Window.partitionBy(run).orderBy(step)
    before = F.min(value).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return log.select(run, step, F.least(before, F.col(value)).alias("best"), (before.isNull() | (F.col(value) < before)).alias("improved"))


def superseded(points: DataFrame, run: str, step: str, keep: int) -> DataFrame:
    """All but the last ``keep`` points of each run, as a clean-up would remove them."""
    nth = F.row_number().over(Window.partitionBy(run).orderBy(F.desc(step)))
    return points.withColumn("_n", nth).filter(F.col("_n") > keep).drop("_n")
