"""From observations to canonical pairs, splits, reports and checks."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from tinctura.functions.concepts import PLACEHOLDER, Quality, concept_defect, is_garbage, source_matches
from tinctura.functions.hashing import canonical_pair_id, split_of
from tinctura.functions.text import concept, key, ordered, stripped
from tinctura.operators.skew import lookup
from tinctura.storage import materialize, measured, spread


@dataclass(frozen=True)
class Cleaning:
    """Settings of the cleaning stage."""

    garbage: bool = True
    quality: Quality | None = field(default_factory=Quality)
    untrusted: tuple[str, ...] = ()
    untrusted_prefixes: tuple[str, ...] = ()
    trusted: tuple[str, ...] = ()
    trusted_prefixes: tuple[str, ...] = ()
    train: float = 0.8
    dev: float = 0.1


def keys(obs: DataFrame, position: str = "obs_id") -> DataFrame:
    """observations with keys ``a, b, out`` (stripped, lower case), none blank; ``pos`` is the order of arrival."""
    rows = obs.select(F.col(position).alias("pos"), key("input_a").alias("a"), key("input_b").alias("b"), key("output").alias("out"), "emoji_a", "emoji_b", "emoji_output", F.coalesce("source", F.lit("")).alias("source"))
    return rows.filter("a <> '' and b <> '' and out <> ''")


def vocabulary(obs: DataFrame, names: tuple[str, ...], prefixes: tuple[str, ...]) -> DataFrame:
    """``concept``, the distinct concepts of trusted sources, white space collapsed."""
    rows = obs.filter(source_matches("source", names, prefixes))
    return rows.select(F.explode(F.array(*[concept(c) for c in ("input_a", "input_b", "output")])).alias("concept")).filter("concept <> ''").distinct()


def concept_flags(rows: DataFrame, known: DataFrame | None, c: Cleaning) -> tuple[DataFrame, int]:
    """``concept, garbage, reason, strange`` of each concept with a fault, and the table's bytes.

    The rules depend on a concept alone, so each distinct one is judged once. strange: asked for by a row with
    ``suspect`` and not in the vocabulary ``known``.
    """
    each = rows.select(F.explode(F.array_distinct(F.array("a", "b", "out"))).alias("concept"), "suspect").groupBy("concept").agg(F.max("suspect").alias("asked"))
    each = each.join(known.withColumn("_k", F.lit(True)), "concept", "left") if known is not None else each.withColumn("_k", F.lit(True))
    garbage = is_garbage("concept") if c.garbage else F.lit(False)
    reason = concept_defect("concept", c.quality) if c.quality else F.lit(None).cast("string")
    flags = each.select("concept", garbage.alias("garbage"), reason.alias("reason"), (F.col("asked") & F.col("_k").isNull()).alias("strange"))
    return measured(flags.filter("garbage or reason is not null or strange"), "flags")


def judged(obs: DataFrame, c: Cleaning = Cleaning(), position: str = "obs_id") -> DataFrame:
    """``keys`` with ``reason``: ``garbage``, a quality reason, ``untrusted_source_vocab``, or null for a good row.

    The vocabulary check looks up keys as they are, with inner white space, in the collapsed vocabulary (F4).
    """
    checked = bool(c.quality and (c.untrusted or c.untrusted_prefixes))
    suspect = source_matches("source", c.untrusted, c.untrusted_prefixes) if checked else F.lit(False)
    rows = keys(spread(obs), position).withColumn("suspect", suspect)
    flags, size = concept_flags(rows, vocabulary(obs, c.trusted, c.trusted_prefixes) if checked else None, c)
    sides = {"a": "input_a", "b": "input_b", "out": "output"}
    for side in sides:
        rows = lookup(rows, flags.select(F.col("concept").alias(side), F.struct("garbage", "reason", "strange").alias(f"_{side}")), [side], size=size)
    some = lambda flag: reduce(or_, [F.coalesce(F.col(f"_{s}.{flag}"), F.lit(False)) for s in sides])
    first = F.coalesce(*[F.concat(F.lit(f"{name}:"), F.col(f"_{s}.reason")) for s, name in sides.items()])
    same = F.when((F.col("out") == F.col("a")) | (F.col("out") == F.col("b")), "identity") if c.quality else F.lit(None)
    reason = F.when(some("garbage"), "garbage").otherwise(F.coalesce(first, same))
    reason = F.coalesce(reason, F.when(F.col("suspect") & some("strange"), "untrusted_source_vocab"))
    return rows.withColumn("reason", reason).select("pos", "a", "b", "out", "emoji_a", "emoji_b", "emoji_output", "source", "reason")


def emoji_modes(rows: DataFrame) -> DataFrame:
    """A3: ``concept, emoji``: each concept's most frequent emoji but the placeholder; of equals the first to arrive."""
    three = [F.struct(F.col(k).alias("concept"), F.col(e).alias("emoji"), (F.col("pos") * 3 + i).alias("at")) for i, (k, e) in enumerate((("a", "emoji_a"), ("b", "emoji_b"), ("out", "emoji_output")))]
    each = rows.select(F.explode(F.array(*three)).alias("x")).select("x.*").filter((F.col("emoji") != "") & (F.col("emoji") != PLACEHOLDER))
    counts = each.groupBy("concept", "emoji").agg(F.count("*").alias("n"), F.min("at").alias("at"))
    return counts.groupBy("concept").agg(F.max_by("emoji", F.struct("n", -F.col("at"))).alias("emoji"))


def canonical_pairs(obs: DataFrame, c: Cleaning = Cleaning(), position: str = "obs_id") -> DataFrame:
    """One row per unordered pair, in the canonical schema.

    Two shuffles of pre-aggregated rows: counts by pair and output, then pairs. The emoji of concepts are looked up
    on the counted rows.
    """
    return pairs_of(materialize(judged(obs, c, position).filter("reason is null").drop("reason"), "good"), c)  # read for emoji and for pairs


def pairs_of(good: DataFrame, c: Cleaning = Cleaning()) -> DataFrame:
    """``canonical_pairs`` of the good rows of ``judged``, which must be written."""
    good = good.withColumns({"lo": F.least("a", "b"), "hi": F.greatest("a", "b")})
    emoji, size = measured(emoji_modes(good), "emoji")  # looked up three times
    counted = good.groupBy("lo", "hi", "out").agg(F.count("*").alias("n"), F.min("pos").alias("pos"), F.collect_set(F.when(F.col("source") != "", F.col("source"))).alias("sources"))
    named = lookup(counted, emoji.select(F.col("concept").alias("out"), F.col("emoji").alias("e")), ["out"], size=size)
    one = F.struct("out", F.coalesce("e", F.lit(PLACEHOLDER)).alias("e"), F.col("n"), "pos")
    pairs = named.groupBy("lo", "hi").agg(F.array_sort(F.collect_list(one)).alias("outs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"))
    best = F.element_at(F.array_sort(F.transform("outs", lambda o: F.struct(-o["n"], o["pos"], o["out"].alias("out"), o["e"].alias("e")))), 1)
    for side in ("lo", "hi"):
        pairs = lookup(pairs, emoji.select(F.col("concept").alias(side), F.col("emoji").alias(f"e_{side}")), [side], size=size)
    return pairs.select(
        canonical_pair_id("lo", "hi").alias("pair_id"),
        F.concat_ws("+", "lo", "hi").alias("pair_key"),
        F.col("lo").alias("input_a"),
        F.col("hi").alias("input_b"),
        F.coalesce("e_lo", F.lit(PLACEHOLDER)).alias("emoji_a"),
        F.coalesce("e_hi", F.lit(PLACEHOLDER)).alias("emoji_b"),
        F.transform("outs", lambda o: o["out"]).alias("known_outputs"),
        F.transform("outs", lambda o: o["e"]).alias("known_emojis"),
        best["out"].alias("canonical_output"),
        best["e"].alias("canonical_emoji"),
        F.transform("outs", lambda o: o["n"]).alias("observation_counts"),
        "sources",
        F.size("sources").alias("source_count"),
        F.size("outs").alias("pair_num_outputs"),
        (F.size("outs") > 1).alias("is_conflicting_pair"),
        split_of("lo", "hi", c.train, c.dev).alias("split"),
        F.when((best["out"] == F.col("lo")) | (best["out"] == F.col("hi")), "review_identity").otherwise("keep").alias("status"),
    )


def clean_metrics(rows: DataFrame, c: Cleaning = Cleaning()) -> DataFrame:
    """A5: counts of canonical pairs, conflicts, statuses, splits and discarded rows in one row, of ``judged`` rows.

    The rows must be written: they are read for the pairs and for what was discarded.
    """
    of = lambda cond: F.count_if(cond)
    pairs = pairs_of(rows.filter("reason is null").drop("reason"), c).agg(
        F.count("*").alias("num_canonical_pairs"), of(F.col("is_conflicting_pair")).alias("num_conflicting_pairs"),
        of(F.col("status") == "keep").alias("num_keep"), of(F.col("status") == "review_identity").alias("num_review_identity"),
        *[of(F.col("split") == s).alias(f"{s}_pairs") for s in ("train", "dev", "test")],
    )
    gone = rows.agg(of(F.col("reason") == "garbage").alias("num_garbage_discarded"), of(F.col("reason").isNotNull() & (F.col("reason") != "garbage")).alias("num_quality_discarded"))
    return pairs.withColumn("_", F.lit(1)).join(gone.withColumn("_", F.lit(1)), "_").drop("_")  # a row each


def reject_histogram(rows: DataFrame) -> DataFrame:
    """``reason, n`` of judged rows, by reason."""
    return rows.filter("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def reject_sample(rows: DataFrame, limit: int = 500) -> DataFrame:
    """The first rejected rows to arrive (garbage aside)."""
    return rows.filter("reason <> 'garbage'").orderBy("pos").limit(limit).select("pos", F.col("a").alias("input_a"), F.col("b").alias("input_b"), F.col("out").alias("output"), "source", "reason")


def validation_report(obs: DataFrame) -> DataFrame:
    """Counts over all observations in one row, keys ignoring case; null fields count as empty texts."""
    a, b, out = (key(F.coalesce(c, F.lit(""))) for c in ("input_a", "input_b", "output"))
    rows = obs.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"), out.alias("out"), "source")
    recipes = rows.groupBy("lo", "hi", "out").agg(F.count("*").alias("n"))
    pairs = recipes.groupBy("lo", "hi").agg(F.count("*").alias("outs"), F.sum("n").alias("n"), F.sum(F.when(F.col("out") == "", F.col("n")).otherwise(0)).alias("empty"))
    total = pairs.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("num_observations"), F.count("*").alias("num_unique_pairs"), F.coalesce(F.sum("outs"), F.lit(0)).alias("num_unique_recipes"),
        F.coalesce(F.sum("empty"), F.lit(0)).alias("empty_output_count"), F.count_if(F.col("outs") > 1).alias("conflicting_pair_count"),
    )
    sources = obs.agg(F.countDistinct(F.when(F.col("source") != "", F.col("source"))).alias("num_sources"))
    both = total.withColumn("one", F.lit(1)).join(sources.withColumn("one", F.lit(1)), "one").drop("one")  # a row each
    return both.withColumn("duplicate_recipe_count", F.col("num_observations") - F.col("num_unique_recipes"))


def emoji_registry(obs: DataFrame, position: str = "obs_id") -> DataFrame:
    """A4: ``concept, emoji`` of outputs: the first emoji that is no placeholder, else the placeholder."""
    rows = obs.select(F.col(position).alias("pos"), key("output").alias("concept"), F.col("emoji_output").alias("emoji")).filter("concept <> '' and emoji <> ''")
    real = F.when(F.col("emoji") != PLACEHOLDER, F.col("pos"))
    return rows.groupBy("concept").agg(F.coalesce(F.min_by("emoji", real), F.min_by("emoji", "pos")).alias("emoji"))


def backfilled(obs: DataFrame, position: str = "obs_id") -> DataFrame:
    """Observations with inputs in order and every missing emoji taken from the registry."""
    a, b = ordered(stripped("input_a"), stripped("input_b"))
    rows = obs.select(F.col(position).alias("pos"), a.alias("input_a"), b.alias("input_b"), stripped("output").alias("output"), "emoji_output", "source")
    known, size = measured(emoji_registry(obs, position), "registry")
    for side in ("input_a", "input_b", "output"):
        rows = lookup(rows.withColumn("k", key(side)), known.select(F.col("concept").alias("k"), F.col("emoji").alias(f"e_{side}")), ["k"], size=size).drop("k")
    return rows.select("pos", "input_a", "input_b", "output", F.col("e_input_a").alias("emoji_a"), F.col("e_input_b").alias("emoji_b"), F.coalesce(F.when(F.col("emoji_output") != "", F.col("emoji_output")), "e_output").alias("emoji_output"), "source")


def gold(pairs: DataFrame) -> DataFrame:
    """The minimal recipe rows of the training export: inputs, outputs, split."""
    return pairs.select("input_a", "input_b", F.col("known_outputs").alias("outputs"), "split")


def split_leaks(rows: DataFrame, a: str = "input_a", b: str = "input_b") -> DataFrame:
    """D3: pairs in more than one split; none if the split is by pair."""
    return rows.groupBy(F.least(a, b).alias("input_a"), F.greatest(a, b).alias("input_b")).agg(F.countDistinct("split").alias("splits")).filter("splits > 1")



def duplicate_keys(rows: DataFrame, *cols: str) -> DataFrame:
    """Keys that occur more than once, with their number."""
    return rows.groupBy(*cols).agg(F.count("*").alias("n")).filter("n > 1")


def orphans(child: DataFrame, parent: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``child`` whose key is not in ``parent``; null keys are orphans too."""
    return child.join(parent.select(*on).distinct(), on, "left_anti")


def outside(rows: DataFrame, column: str, allowed: tuple[str, ...]) -> DataFrame:
    """Rows whose value isn't one of those allowed (null is)."""
    return rows.filter(~F.col(column).isin(*allowed))


def repaired(rows: DataFrame, authority: DataFrame) -> DataFrame:
    """Recipes (``input_a, input_b, output``) whose pair occurs more than once, set right by ``authority``.

    Inputs are put in order first. Of such a pair that the authority knows (a row a pair) the recipes with its output
    stay, the others go, and one with its output comes in if there was none. All other recipes stay.
    """
    rows = rows.select(F.least("input_a", "input_b").alias("input_a"), F.greatest("input_a", "input_b").alias("input_b"), "output")
    pairs = rows.groupBy("input_a", "input_b", "output").agg(F.count("*").alias("n"))
    pairs = pairs.groupBy("input_a", "input_b").agg(F.sum("n").alias("n"), F.collect_set("output").alias("outs")).filter("n > 1")
    doubted = materialize(pairs.join(authority.select("input_a", "input_b", F.col("output").alias("right")), ["input_a", "input_b"]), "doubted")
    known = lookup(rows, doubted.select("input_a", "input_b", "right"), ["input_a", "input_b"])
    kept = known.filter("right is null or right = output").select("input_a", "input_b", "output")
    new = doubted.filter(~F.array_contains("outs", F.col("right"))).select("input_a", "input_b", F.col("right").alias("output"))
    return kept.unionByName(new)
