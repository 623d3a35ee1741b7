"""Scores of predictions: coverage, semantic coverage, verdicts, creativity."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from tinctura.functions import vectors as V
from tinctura.functions.text import answer, outer_object, stripped, word_count
from tinctura.operators.skew import lookup
from tinctura.storage import measured


def items(rows: DataFrame, row_id: str) -> DataFrame:
    """``row_id, samples, known, canonical`` of prediction rows.

    samples: those sampled, else the prediction; known: the known outputs; canonical: the given one, else the first
    known. Null fields are empty.
    """
    none = F.array().cast("array<string>")
    some = F.coalesce("sampled_outputs", none)
    known = F.coalesce("known_outputs", none)
    samples = F.when(F.size(some) > 0, some).otherwise(F.array(F.coalesce("prediction", F.lit(""))))
    canonical = F.coalesce(F.when(F.col("canonical_output") != "", F.col("canonical_output")), F.get(known, F.lit(0)), F.lit(""))
    return rows.select(row_id, samples.alias("samples"), known.alias("known"), canonical.alias("canonical"))


def eval_items(rows: DataFrame) -> DataFrame:
    """Usable evaluation records; those without an input or a known output that isn't blank are left out.

    known: known_outputs, else the outputs of candidate_outputs, else the canonical output; pair_id and canonical_output
    are filled in where they are missing. Columns that ``rows`` lack count as null.
    """
    has = set(rows.columns)
    none = F.lit(None).cast("array<string>")
    known = F.col("known_outputs") if "known_outputs" in has else none
    ranked = F.transform("candidate_outputs", lambda c: c["output"]) if "candidate_outputs" in has else none
    given = F.nullif(F.col("canonical_output"), F.lit(""))
    some = F.filter(F.coalesce(known, ranked, F.when(given.isNotNull(), F.array(given))), lambda o: stripped(F.coalesce(o, F.lit(""))) != "")
    out = rows.withColumn("known_outputs", some).filter("input_a <> '' and input_b <> '' and size(known_outputs) > 0")
    pair = F.coalesce(F.nullif(F.col("pair_id"), F.lit("")) if "pair_id" in has else F.lit(None), F.concat_ws("+", "input_a", "input_b"))
    return out.withColumn("pair_id", pair).withColumn("canonical_output", F.coalesce(given, F.get("known_outputs", F.lit(0))))


def matched(rows: DataFrame, row_id: str) -> DataFrame:
    """Per row whether the first sample, or any, is the canonical or a known output; words of the first."""
    df = items(rows, row_id).select(row_id, F.transform("samples", answer).alias("s"), F.transform("known", answer).alias("k"), answer("canonical").alias("c"))
    first = F.get("s", F.lit(0))
    known = lambda s: (s != "") & F.array_contains("k", s)
    same = lambda s: (s != "") & (s == F.col("c"))
    return df.select(row_id, known(first).alias("top1_known"), same(first).alias("top1_canonical"), F.exists("s", known).alias("any_known"), F.exists("s", same).alias("any_canonical"), (first == "").alias("empty"), word_count(first).alias("words"))


def coverage(rows: DataFrame, row_id: str, *by: str) -> DataFrame:
    """Rates over all rows (or by columns of ``rows``); 0 where there are no rows."""
    flags = matched(rows, row_id)
    if by:
        flags = flags.join(rows.select(row_id, *by), row_id)
    rate = lambda c: F.coalesce(F.avg(c.cast("double")), F.lit(0.0))
    col = F.col
    return flags.groupBy(*by).agg(
        F.count("*").alias("n"), rate(col("top1_known")).alias("top1_known_match"), rate(col("top1_canonical")).alias("top1_canonical_match"), rate(col("any_known")).alias("anyk_known_match"),
        rate(col("any_canonical")).alias("anyk_canonical_match"), rate(col("empty")).alias("empty_top1_rate"), rate(col("words")).alias("mean_top1_words"), rate((col("words") > 0) & (col("words") <= 2)).alias("frac_top1_le2_words"),
    )


def text_vectors(texts: DataFrame, words: DataFrame, dims: int) -> DataFrame:
    """``text, vector``: the mean of the vectors of a text's words; zeros if none is known.

    ``texts`` holds distinct texts, so each is computed once; ``words``: ``word, vector``.
    """
    each = texts.select("text", F.explode_outer(F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "")).alias("word"))
    found = lookup(each, words, ["word"])
    full = found.groupBy("text").agg(F.collect_list("vector").alias("vs"))  # as many as the text has known words
    return full.select("text", F.coalesce(V.centroid(F.col("vs")), F.array_repeat(F.lit(0.0), dims)).alias("vector"))


def semantic(rows: DataFrame, row_id: str, embedded: DataFrame, threshold: float) -> DataFrame:
    """The share of rows (with known outputs) whose first sample, or any, is as close to a known output."""
    df = items(rows, row_id).filter(F.size("known") > 0).select(row_id, "samples", "known")
    pairs = df.select(row_id, F.posexplode("samples").alias("at", "sample"), "known").select(row_id, "at", "sample", F.explode("known").alias("target"))
    vectors, size = measured(embedded.select("text", "vector"), "vectors")
    left, right = vectors.select(F.col("text").alias("sample"), F.col("vector").alias("x")), vectors.select(F.col("text").alias("target"), F.col("vector").alias("y"))
    # Equal pairs of texts are compared once.
    distinct = pairs.select("sample", "target").distinct()
    near = lookup(lookup(distinct, left, ["sample"], how="inner", size=size), right, ["target"], how="inner", size=size).select("sample", "target", (V.cosine(F.col("x"), F.col("y")) >= threshold).alias("near"))
    each = lookup(pairs, near, ["sample", "target"]).withColumn("near", F.coalesce("near", F.lit(False)))
    flags = each.groupBy(row_id).agg(F.max(F.col("near") & (F.col("at") == 0)).alias("top1"), F.max("near").alias("any"))
    return flags.agg(F.count("*").alias("n"), F.coalesce(F.avg(F.col("top1").cast("double")), F.lit(0.0)).alias("top1_semantic_match"), F.coalesce(F.avg(F.col("any").cast("double")), F.lit(0.0)).alias("anyk_semantic_match"))


def _results(reply: Column) -> Column:
    """The list under ``results`` of the JSON object in a judge's reply; null if there is none."""
    return F.try_variant_get(F.try_parse_json(outer_object(reply)), "$.results", "array<variant>")


def _number(item: Column, name: str) -> Column:
    """A field of a JSON item as a number: numbers, texts of numbers, and true or false as 1 or 0; else null."""
    field = F.try_variant_get(item, f"$.{name}", "variant")
    kind = F.schema_of_variant(field)
    whole = F.try_variant_get(item, f"$.{name}", "double")
    told = F.trim(F.try_variant_get(item, f"$.{name}", "string")).try_cast("double")
    return F.when(kind == "BOOLEAN", F.try_variant_get(item, f"$.{name}", "boolean").cast("int").cast("double")).when(kind == "STRING", told).when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), whole)


def _clamped(x: Column) -> Column:
    """Within [0, 1]; what is no number counts as 0."""
    return F.when(F.isnan(x), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def _told(item: Column, name: str) -> Column:
    """A field of a JSON item as text: as it is if it is one, else as JSON, ``None`` for null, empty if missing."""
    field = F.try_variant_get(item, f"$.{name}", "variant")
    return F.when(field.isNull(), "").when(F.is_variant_null(field), "None").when(F.schema_of_variant(field) == "STRING", F.try_variant_get(item, f"$.{name}", "string")).otherwise(F.to_json(field))


def _truth(field: Column) -> Column:
    """Whether a JSON value counts as true: all but null, false, zero and what is empty; the text ``false`` does."""
    text = F.to_json(field)
    return F.coalesce(~text.isin("null", "false", '""', "[]", "{}") & (F.coalesce(text.try_cast("double"), F.lit(1.0)) != 0), F.lit(False))


def _by_position(reply: Column, expected: Column, each: Callable[[Column], Column], usable: Callable[[Column], Column]) -> Column:
    """``each`` of the first ``expected`` results; null if there are fewer, or one isn't usable."""
    items = F.slice(_results(reply), F.lit(1), expected)
    return F.when((F.size(items) == expected) & F.forall(items, usable), F.transform(items, each))


def parsed_verdicts(replies: DataFrame, expected: Column) -> DataFrame:
    """``verdicts`` of judge replies by position; null if the reply has fewer than ``expected`` objects.

    A verdict is plausible if the value counts as true by its JSON type; plausibility is clamped to [0, 1], and is 1
    or 0 by the verdict where none is given or it is no number.
    """

    def one(item: Column) -> Column:
        true = _truth(F.try_variant_get(item, "$.plausible", "variant"))
        return F.struct(true.alias("plausible"), _clamped(F.coalesce(_number(item, "plausibility"), true.cast("int").cast("double"))).alias("plausibility"), _told(item, "reason").alias("reason"))

    return replies.withColumn("verdicts", _by_position(F.col("reply"), expected, one, lambda i: F.schema_of_variant(i).startswith("OBJECT")))


def bucket(plausible: Column, known: Column) -> Column:
    """``invalid``, ``valid_known`` or ``valid_novel``."""
    return F.when(~plausible, "invalid").when(known, "valid_known").otherwise("valid_novel")


def judged(rows: DataFrame, row_id: str, verdicts: DataFrame) -> DataFrame:
    """A row per sample with verdict, membership and bucket; samples without a verdict are invalid.

    ``verdicts``: ``output, plausible, plausibility``, one row per distinct output.
    """
    each = items(rows, row_id).select(row_id, F.posexplode("samples").alias("at", "output"), F.transform("known", answer).alias("k"))
    found = lookup(each, verdicts.select("output", "plausible", "plausibility"), ["output"])
    plausible = F.coalesce("plausible", F.lit(False)) & (answer("output") != "")
    known = F.array_contains("k", answer("output"))
    return found.select(row_id, "at", "output", plausible.alias("plausible"), F.when(answer("output") != "", F.coalesce("plausibility", F.lit(0.0))).otherwise(0.0).alias("plausibility"), known.alias("in_dataset"), bucket(plausible, known).alias("bucket"))


def verdict_rates(samples: DataFrame, row_id: str) -> DataFrame:
    """Validity and creativity of the first and of any sample, and shares of the first's bucket, in one row."""
    first = F.col("at") == 0
    novel = F.col("plausible") & ~F.col("in_dataset")
    rows = samples.groupBy(row_id).agg(F.max(first & F.col("plausible")).alias("v1"), F.max(first & novel).alias("c1"), F.max("plausible").alias("vk"), F.max(novel).alias("ck"), F.max(F.when(first, F.col("bucket"))).alias("b"))
    rate = lambda c: F.avg(c.cast("double"))
    b = lambda x: rate(F.col("b") == x)
    return rows.agg(F.count("*").alias("n"), rate(F.col("v1")).alias("validity_top1"), rate(F.col("c1")).alias("creativity_top1"), rate(F.col("vk")).alias("validity_anyk"), rate(F.col("ck")).alias("creativity_anyk"), b("invalid").alias("top1_invalid_rate"), b("valid_known").alias("top1_valid_known_rate"), b("valid_novel").alias("top1_valid_novel_rate"))


def novelty_of(text: Column) -> Column:
    """``novelty, reason`` of a judge's reply: of its JSON, else the first number from 0 to 1 and the whole reply.

    Null without either.
    """
    parsed = F.try_parse_json(outer_object(text))
    given = _number(parsed, "novelty_score")
    found = F.nullif(F.regexp_extract(text, r"([01](?:\.\d+)?)", 1), F.lit("")).try_cast("double")
    return F.when(given.isNotNull(), F.struct(_clamped(given).alias("novelty"), _told(parsed, "reason").alias("reason"))).when(found.isNotNull(), F.struct(_clamped(found).alias("novelty"), stripped(text).alias("reason")))


def novelties_of(reply: Column, expected: Column) -> Column:
    """``novelty, reason`` of each of ``expected`` outputs by position; null if there are fewer, or one has no number."""
    one = lambda i: F.struct(_clamped(_number(i, "novelty_score")).alias("novelty"), _told(i, "reason").alias("reason"))
    return _by_position(reply, expected, one, lambda i: F.schema_of_variant(i).startswith("OBJECT") & _number(i, "novelty_score").isNotNull())


def creativity_rows(groups: DataFrame, alpha: float = 0.8, penalty: float = 2.0) -> DataFrame:
    """The creativity of each group of ``samples`` against ``known``, novelty as distance to ``inputs``."""
    novelty = V.mean_distances(F.col("samples"), F.col("inputs"))
    return groups.select("group", V.creativity(F.col("samples"), F.col("known"), novelty, alpha, penalty).alias("c")).select("group", "c.*")


def creativity_summary(rows: DataFrame) -> DataFrame:
    """Means over groups, and the least and most creative group (ties: the first)."""
    by = "local_creativity"
    means = [F.avg(c).alias(f"mean_{c}") for c in ("plausibility_score", "novelty", "diversity_score", by)]
    return rows.agg(F.count("*").alias("n"), *means, F.min_by("group", F.struct(by, "group")).alias("least"), F.max_by("group", F.struct(F.col(by), -F.col("group"))).alias("most"))
