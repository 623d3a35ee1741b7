"""Candidate weights, grouped losses and preference pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tinctura.functions.text import answer, let
from tinctura.storage import spread


def candidates(records: DataFrame, *keys: str) -> DataFrame:
    """A row per candidate of records with ``candidate_outputs`` (structs), else ``outputs``, else ``output``.

    Columns: the keys, ``position`` from 0, ``output``, ``rank`` (position + 1 where none is given), ``weight``.
    """
    has = set(records.columns)
    kind = "array<struct<output:string,rank:int,weight:double>>"
    full = F.transform("candidate_outputs", lambda c: F.struct(c["output"].alias("output"), c["rank"].cast("int").alias("rank"), c["weight"].cast("double").alias("weight"))) if "candidate_outputs" in has else F.lit(None).cast(kind)
    plain = F.filter(F.transform("outputs", lambda o, i: F.struct(o.alias("output"), (i + 1).cast("int").alias("rank"), F.lit(None).cast("double").alias("weight"))), lambda c: F.coalesce(c["output"], F.lit("")) != "") if "outputs" in has else F.lit(None).cast(kind)
    single = F.when(F.coalesce("output", F.lit("")) != "", F.array(F.struct(F.col("output").alias("output"), F.lit(1).alias("rank"), F.lit(None).cast("double").alias("weight")))) if "output" in has else F.lit(None).cast(kind)
    return records.select(*keys, F.posexplode(F.coalesce(full, plain, single)).alias("position", "c")).select(*keys, "position", "c.*")


def normalized(rows: DataFrame, keys: list[str], fallback: str = "inverse_rank") -> DataFrame:
    """``share``, a candidate's weight over its recipe's sum.

    Given weights count if the whole recipe has them, else all count alike or by the inverse of the rank. Recipes
    with a negative weight or without a positive sum get null shares.
    """
    w = Window.partitionBy(*keys)
    given = F.min(F.col("weight").isNotNull().cast("int")).over(w) == 1
    spare = F.lit(1.0) if fallback == "uniform" else 1.0 / F.coalesce(F.nullif("rank", F.lit(0)), F.col("position") + 1)
    rows = rows.withColumn("raw", F.when(given, F.col("weight")).otherwise(spare))
    total, least = F.sum("raw").over(w), F.min("raw").over(w)
    return rows.withColumn("share", F.when((least >= 0) & (total > 0), F.col("raw") / total)).drop("raw")


def merged(rows: DataFrame, keys: list[str], fallback: str = "inverse_rank") -> DataFrame:
    """Recipes with the same inputs as one: shares of equal outputs add up, the first one's rank stays.

    ``position`` must count through all candidates of the key. Equal outputs are added up before the shuffle, so a
    recipe that comes often sends one row per output and task.
    """
    spare = F.lit(1.0) if fallback == "uniform" else 1.0 / F.coalesce(F.nullif("rank", F.lit(0)), F.col("position") + 1)
    one = rows.groupBy(*keys, "output").agg(
        F.sum("weight").alias("w"), F.sum(spare).alias("s"), F.min(F.col("weight").isNotNull()).alias("given"), F.min("weight").alias("least"), F.min("position").alias("position"), F.min_by("rank", "position").alias("rank"),
    )
    w = Window.partitionBy(*keys)
    mass = F.when(F.min("given").over(w), F.when(F.min("least").over(w) >= 0, F.col("w"))).otherwise(F.col("s"))
    one = one.withColumn("mass", mass)
    return one.select(*keys, "output", "position", "rank", F.try_divide("mass", F.nullif(F.sum("mass").over(w), F.lit(0.0))).alias("share"))


def group_losses(rows: DataFrame, group: str, logprob: str, weight: str, *, uniform: bool, logsumexp: bool) -> DataFrame:
    """Each group's loss: minus the weighted mean of logprobs, or minus the log of the weighted mean probability."""
    w = Window.partitionBy(group)
    raw = F.lit(1.0) if uniform else F.col(weight)
    rows = rows.withColumn("_p", raw / F.greatest(F.sum(raw).over(w), F.lit(1e-38)))
    if not logsumexp:
        return rows.groupBy(group).agg((-F.sum(F.col("_p") * F.col(logprob))).alias("loss"))
    term = F.ln(F.greatest(F.col("_p"), F.lit(1e-30))) + F.col(logprob)
    rows = rows.withColumn("_t", term).withColumn("_m", F.max(term).over(w))
    return rows.groupBy(group).agg((-(F.first("_m") + F.ln(F.sum(F.exp(F.col("_t") - F.col("_m")))))).alias("loss"))


def masked_logprob(logprobs: Column, mask: Column, by_length: bool = False) -> Column:
    """The sum of token logprobs under a mask, both shifted by the first token; or their mean over the mask."""
    pairs = F.zip_with(F.slice(logprobs, 2, 1 << 30), F.slice(mask, 2, 1 << 30), lambda p, m: F.when(m, p).otherwise(0.0))
    total = F.aggregate(pairs, F.lit(0.0), lambda s, p: s + F.coalesce(p, F.lit(0.0)))
    return total / F.greatest(F.size(F.filter(F.slice(mask, 2, 1 << 30), lambda m: m)), F.lit(1)) if by_length else total


def log_sigmoid(z: Column) -> Column:
    """ln(1 / (1 + e^-z)) without overflow."""
    return F.least(z, F.lit(0.0)) - F.log1p(F.exp(-F.abs(z)))


def preference_loss(rows: DataFrame, beta: float = 0.1, smoothing: float = 0.0, reference_free: bool = False) -> DataFrame:
    """Loss and rewards of preference pairs in one row. Columns: policy_/reference_ chosen and rejected logps."""
    policy = F.col("policy_chosen") - F.col("policy_rejected")
    reference = F.lit(0.0) if reference_free else F.col("reference_chosen") - F.col("reference_rejected")
    z = beta * (policy - reference)
    good, bad = beta * (F.col("policy_chosen") - F.col("reference_chosen")), beta * (F.col("policy_rejected") - F.col("reference_rejected"))
    return rows.agg(
        F.avg(-((1 - smoothing) * log_sigmoid(z) + smoothing * log_sigmoid(-z))).alias("loss"), F.avg(good).alias("chosen_reward"), F.avg(bad).alias("rejected_reward"),
        (F.avg(good) - F.avg(bad)).alias("reward_margin"), F.avg((z > 0).cast("double")).alias("reward_accuracy"), F.avg("policy_chosen").alias("chosen_logp"), F.avg("policy_rejected").alias("rejected_logp"),
    )


def weighted_mean(value: str, unit: str) -> Column:
    """A mean weighted by units, over one unit at least."""
    return F.sum(F.col(value) * F.col(unit)) / F.greatest(F.sum(unit), F.lit(1))


def _most_frequent(rows: Column) -> Column:
    """Of rows ``raw, norm, at`` the first raw of the most frequent norm; of equals the shorter, then the first."""

    def best(norms: Column) -> Column:
        # array_position gives a norm's first row, where its count is taken; later rows of the norm score lower.
        scored = F.transform(rows, lambda r, i: F.struct((-F.size(F.filter(norms, lambda n: n == r["norm"]))).alias("n"), F.length(r["norm"]).alias("length"), i.alias("i")))
        return F.get(rows, F.array_min(scored)["i"])

    return let(F.transform(rows, lambda r: r["norm"]), best)


def preference_pairs(rows: DataFrame, *, short: int = 2, verbose: int = 3) -> DataFrame:
    """Chosen and rejected outputs of each row's samples; rows without a usable pair are left out.

    chosen: the most frequent valid sample of at most ``short`` words, else the short candidate that is observed and
    ranks first. rejected: the first sample if it is bad, else the most frequent bad one; bad: neither empty nor the
    chosen one, and not valid or of ``verbose`` words or more. Needs input_a, input_b, known_outputs,
    sampled_outputs and candidate_outputs (structs of output, source, rank). Every value is worked out once a row; a
    row without a pair is dropped as its empty list is unfolded, since a filter would work it all out again.
    """
    none = F.array().cast("array<string>")
    size = lambda n: F.when(n == "", 0).otherwise(F.size(F.split(n, " ")))
    normed = F.transform(F.coalesce("sampled_outputs", none), lambda s: F.struct(s.alias("raw"), answer(s).alias("norm")))

    def labeled(known: Column) -> Column:
        return F.transform(F.filter(normed, lambda s: s["raw"].isNotNull()), lambda s: F.struct(s["raw"].alias("raw"), s["norm"].alias("norm"), size(s["norm"]).alias("words"), ((s["norm"] != "") & F.array_contains(known, s["norm"])).alias("valid")))

    def spare() -> Column:
        sized = F.transform("candidate_outputs", lambda c, i: F.struct(F.when(c["source"] == "observed", 0).otherwise(1).alias("o"), F.coalesce(c["rank"], F.lit(999)).alias("r"), i.alias("i"), c["output"].alias("output"), answer(c["output"]).alias("norm")))
        return F.array_min(F.filter(sized, lambda c: size(c["norm"]).between(1, short)))

    def of_samples(s: Column) -> Column:
        good = F.filter(s, lambda x: x["valid"] & (x["words"] <= short))
        own = lambda g: F.when(F.size(g) > 0, let(_most_frequent(g), lambda m: F.struct(m["raw"].alias("raw"), m["norm"].alias("norm"), F.lit("on_policy").alias("source"))))
        other = let(spare(), lambda c: F.when(c.isNotNull(), F.struct(c["output"].alias("raw"), c["norm"].alias("norm"), F.lit("dataset_candidate").alias("source"))))
        return let(F.coalesce(let(good, own), other), lambda chosen: of_chosen(s, chosen))

    def of_chosen(s: Column, chosen: Column) -> Column:
        is_bad = lambda x: (x["norm"] != "") & (x["norm"] != chosen["norm"]) & (~x["valid"] | (x["words"] >= verbose))
        first = F.get(s, F.lit(0))
        pick = lambda bad: F.when(is_bad(first), first).otherwise(_most_frequent(bad))
        return let(F.filter(s, is_bad), lambda bad: F.when(F.size(bad) > 0, let(pick(bad), lambda r: pair(chosen, r))))

    def pair(chosen: Column, r: Column) -> Column:
        return F.struct(
            chosen["raw"].alias("chosen"), r["raw"].alias("rejected"), chosen["source"].alias("chosen_source"),
            F.when(r["words"] >= verbose, "on_policy_verbose").otherwise("on_policy_invalid").alias("rejected_source"),
            size(chosen["norm"]).alias("chosen_len"), r["words"].alias("rejected_len"), r["valid"].alias("rejected_valid"),
        )

    known = F.transform(F.coalesce("known_outputs", none), answer)
    found = F.explode(F.array_compact(F.array(let(known, lambda k: let(labeled(k), of_samples))))).alias("p")
    return spread(rows).select("input_a", "input_b", found).select(F.concat_ws("+", "input_a", "input_b").alias("pair_id"), "input_a", "input_b", "p.*")
