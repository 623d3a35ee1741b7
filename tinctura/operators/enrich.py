"""Teacher outputs merged with observed ones, and batch replies matched with requests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from tinctura.functions.concepts import Quality, concept_defect
from tinctura.functions.text import compact, concept, let, one_line, reject_reason, stripped, without_fence
from tinctura.operators.skew import numbered
from tinctura.storage import materialize

# How a record's id stands in a batch request, the kinds of sources of a teacher's candidates.
RECORD_ID = r"Dataset record id:\s*(\S+)"
SOURCES = ("observed", "teacher")
# End of fixed values.

#: Quality of teacher outputs: gerunds may stand in them.
TEACHER = Quality(gerunds=True)


#: A teacher's proposal, and a candidate as written.
PROPOSAL = "array<struct<output:string,source:string,rationale:string>>"


def _none() -> Column:
    return F.array().cast("array<string>")


def valid_outputs(outputs: Column, existing: Column, a: Column, b: Column, limit: int | Column, q: Quality = TEACHER) -> Column:
    """clean outputs in their order, each once, neither existing nor an input, ``limit`` at most."""
    clean = F.transform(F.coalesce(outputs, _none()), lambda o: concept(F.coalesce(o, F.lit(""))))
    good = F.filter(clean, lambda o: (o != a) & (o != b) & concept_defect(o, q).isNull())
    return F.slice(F.array_except(F.array_distinct(good), existing), F.lit(1), F.greatest(limit if isinstance(limit, Column) else F.lit(limit), F.lit(0)))


def first_of_forms(rows: Column, form: Callable[[Column], Column]) -> Column:
    """Of structs with the same form the first, in their order; for arrays as short as a reply."""
    return let(rows, lambda rs: let(F.transform(rs, form), lambda forms: F.filter(rs, lambda r, i: F.array_position(forms, F.get(forms, i)) == i + 1)))


def enriched(rows: DataFrame, limit: int = 5, q: Quality = TEACHER) -> DataFrame:
    """Recipes with their ranked candidates, or the reason for which they are rejected.

    Needs ``input_a, input_b, outputs`` and the teacher's ``reply`` (struct of keep_recipe, reject_reason and
    candidates; null if the call failed). Adds ``candidate_outputs`` (structs of output, source, rationale, rank) and
    ``reject_reason``, null for accepted recipes; the inputs are normalised. Reasons in their order: no valid observed
    outputs (or an input missing), no reply, told by the teacher, no valid candidate.

    A proposal said to be observed must be; one that is observed is so whatever it says; it needs a rationale, quality
    and a form that no proposal before it has. All within the row, nothing is shuffled.
    """
    def of_seen(a: Column, b: Column, seen: Column) -> Column:
        known = lambda p: F.array_contains(seen, p["output"])
        one = lambda p: F.struct(concept(F.coalesce(p["output"], F.lit(""))).alias("output"), p["source"].alias("source"), one_line(F.coalesce(p["rationale"], F.lit(""))).alias("rationale"))
        usable = lambda p: (p["rationale"] != "") & (p["output"] != a) & (p["output"] != b) & (known(p) | (p["source"] != "observed")) & concept_defect(p["output"], q).isNull()
        proposed = F.filter(F.transform(F.coalesce("reply.candidates", F.array().cast(PROPOSAL)), one), usable)
        kept = F.slice(first_of_forms(proposed, lambda p: compact(p["output"])), 1, limit)
        told = F.transform(kept, lambda p, i: F.struct(p["output"].alias("output"), F.when(known(p), "observed").otherwise(p["source"]).alias("source"), p["rationale"].alias("rationale"), (i + 1).cast("int").alias("rank")))
        return F.struct(a.alias("a"), b.alias("b"), seen.alias("seen"), told.alias("told"))

    # Each value is bound where it is worked out: a column used inside the functions below would be worked out for each element.
    name = lambda c: concept(F.coalesce(c, F.lit("")))
    whole = let(name("input_a"), lambda a: let(name("input_b"), lambda b: let(valid_outputs(F.col("outputs"), _none(), a, b, limit, q), lambda seen: of_seen(a, b, seen))))
    given = rows.withColumn("_x", whole)
    reason = (
        F.when((F.col("_x.a") == "") | (F.col("_x.b") == "") | (F.size("_x.seen") == 0), "no_valid_observed_outputs").when(F.col("reply").isNull(), "teacher_response_error")
        .when(~F.coalesce("reply.keep_recipe", F.lit(False)), reject_reason("reply.reject_reason")).when(F.size("_x.told") == 0, "no_valid_teacher_candidates")
    )
    out = given.withColumn("reject_reason", reason).withColumn("candidate_outputs", F.when(F.col("reject_reason").isNull(), F.col("_x.told")))
    out = out.withColumn("outputs", F.when(F.col("reject_reason") == "no_valid_observed_outputs", F.col("outputs")).otherwise(F.col("_x.seen")))
    return out.withColumns({"input_a": F.col("_x.a"), "input_b": F.col("_x.b")}).drop("_x")


def completed(rows: DataFrame, wanted: int, q: Quality = TEACHER) -> DataFrame:
    """``candidate_outputs`` (structs of output, source): valid observed outputs, then taught ones, up to ``wanted``.

    ``quality_status``: complete, partial_enrichment or failed_enrichment. Inputs are normalised.
    """
    given = rows.withColumns({"input_a": concept(F.coalesce("input_a", F.lit(""))), "input_b": concept(F.coalesce("input_b", F.lit("")))})
    a, b = F.col("input_a"), F.col("input_b")
    given = given.withColumn("_o", valid_outputs(F.col("observed"), _none(), a, b, wanted, q))
    more = valid_outputs(F.col("taught"), F.col("_o"), a, b, F.lit(wanted) - F.size("_o"), q)
    of = lambda c, source: F.transform(c, lambda o: F.struct(o.alias("output"), F.lit(source).alias("source")))
    given = given.withColumn("candidate_outputs", F.concat(of(F.col("_o"), "observed"), of(more, "teacher"))).drop("_o")
    n = F.size("candidate_outputs")
    return given.withColumn("quality_status", F.when(n >= wanted, "complete").when(n > 0, "partial_enrichment").otherwise("failed_enrichment"))


def rationale_error(reply: Column, asked: Column) -> Column:
    """What is wrong with a reply of rationales for the outputs ``asked``; null if nothing is.

    not_json, not_a_list, or of the first bad item: not_an_object, not_texts, unexpected, duplicate, reordered.
    """
    parsed = F.try_parse_json(without_fence(reply))
    items = F.try_variant_get(parsed, "$.rationales", "array<variant>")
    names = F.transform(items, _said("output"))

    def wrong(item: Column, i: Column) -> Column:
        out = F.get(names, i)
        return (
            F.when(~F.schema_of_variant(item).startswith("OBJECT"), "not_an_object").when(out.isNull() | _said("rationale")(item).isNull(), "not_texts")
            .when(~F.array_contains(asked, out), "unexpected").when(F.array_position(names, out) != i + 1, "duplicate").when((i < F.size(asked)) & (out != F.get(asked, i)), "reordered")
        )

    first = F.get(F.filter(F.transform(items, wrong), lambda e: e.isNotNull()), F.lit(0))
    return F.when(reply.isNull() | parsed.isNull(), "not_json").when(items.isNull(), "not_a_list").otherwise(first)


def _said(name: str) -> Callable[[Column], Column]:
    """A text field of a JSON item, null if it is missing or no text."""
    value = lambda item: F.try_variant_get(item, f"$.{name}", "variant")
    return lambda item: F.when(F.schema_of_variant(value(item)) == "STRING", F.try_variant_get(item, f"$.{name}", "string"))


def with_rationales(rows: DataFrame) -> DataFrame:
    """Candidates with the rationales of a teacher's reply merged in, their status, and why some are missing.

    Needs ``candidate_outputs`` (structs of output, source, rationale) and ``reply`` (JSON text). A reply counts only
    if it is faultless and a candidate lacks a rationale; then it also replaces those given. ``quality_status``:
    complete, partial_rationale or failed_rationale; ``reason``: missing_rationales (some are there) or
    teacher_response_error (none is), null if complete; ``missing_outputs``: those without one.
    """
    asked = F.transform("candidate_outputs", lambda c: F.coalesce(c["output"], F.lit("")))
    rows = rows.withColumn("_asked", asked).withColumn("_own", F.filter("candidate_outputs", lambda c: stripped(F.coalesce(c["rationale"], F.lit(""))) != ""))
    lacks = F.size(F.array_except("_asked", F.transform("_own", lambda c: c["output"]))) > 0
    rows = rows.withColumn("_lacks", lacks).withColumn("error", F.when(F.col("_lacks"), rationale_error(F.col("reply"), F.col("_asked"))))
    items = F.try_variant_get(F.try_parse_json(without_fence(F.col("reply"))), "$.rationales", "array<variant>")
    told = F.filter(F.transform(items, lambda i: F.struct(_said("output")(i).alias("output"), one_line(_said("rationale")(i)).alias("rationale"))), lambda i: i["rationale"] != "")
    rows = rows.withColumn("_told", F.when(F.col("_lacks") & F.col("error").isNull(), told))
    last = lambda found, o: F.get(F.reverse(F.filter(found, lambda x: x["output"] == o)), F.lit(0))["rationale"]
    merged = F.transform("candidate_outputs", lambda c: F.struct(F.coalesce(c["output"], F.lit("")).alias("output"), F.coalesce(c["source"], F.lit("")).alias("source"), F.coalesce(last("_told", c["output"]), last("_own", c["output"])).alias("rationale")))
    rows = rows.withColumn("candidate_outputs", merged)
    rows = rows.withColumn("missing_outputs", F.transform(F.filter("candidate_outputs", lambda c: c["rationale"].isNull()), lambda c: c["output"]))
    n, gone = F.size("candidate_outputs"), F.size("missing_outputs")
    none = gone == n
    status = F.when((n > 0) & (gone == 0), "complete").when((n == 0) | (none & F.col("error").isNotNull()), "failed_rationale").otherwise("partial_rationale")
    reason = F.when(F.col("quality_status") == "complete", None).when(none, "teacher_response_error").otherwise("missing_rationales")
    return rows.withColumn("quality_status", status).withColumn("reason", reason).drop("_asked", "_own", "_lacks", "_told")


def remaining(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows not done yet; done: those written with a candidate at least."""
    return rows.join(done.filter(F.size("candidate_outputs") > 0).select(*keys), keys, "left_anti")


def record_ids(rows: DataFrame, split: str, order: str) -> DataFrame:
    """P25: ``split:00000000`` by the order of ``order``, counted over all splits."""
    return numbered(rows, order, name="_n").withColumn("record_id", F.concat(F.col(split), F.lit(":"), F.lpad(F.col("_n").cast("string"), 8, "0"))).drop("_n")


def _texts(line: Column, side: str) -> Column:
    """The texts, none empty, of a batch line's request or response: of its candidates, else of its contents."""
    part = "array<struct<parts:array<struct<text:string>>>>"
    read = F.from_json(line, f"struct<{side}:struct<candidates:array<struct<content:struct<parts:array<struct<text:string>>>>>,contents:{part}>>")[side]
    contents = F.when(F.size(read["candidates"]) > 0, F.transform(read["candidates"], lambda c: c["content"])).otherwise(read["contents"])
    return F.filter(F.flatten(F.transform(contents, lambda c: F.coalesce(c["parts"]["text"], F.array().cast("array<string>")))), lambda t: F.coalesce(t, F.lit("")) != "")


def reply_text(line: Column) -> Column:
    """The first text of a batch reply, null if it has none."""
    return F.get(_texts(line, "response"), F.lit(0))


def request_id(line: Column) -> Column:
    """The record id that stands in a text of a batch line's request; null if none does."""
    ids = F.transform(_texts(line, "request"), lambda t: F.regexp_extract(t, RECORD_ID, 1))
    return F.get(F.filter(ids, lambda i: i != ""), F.lit(0))


def usage(line: Column) -> Column:
    """Prompt, output and total tokens of a reply, by either set of names."""
    n = lambda *names: F.coalesce(*[F.nullif(F.get_json_object(line, f"$.response.usageMetadata.{p}").try_cast("long"), F.lit(0).cast("long")) for p in names], F.lit(0).cast("long"))
    i, o, total = n("promptTokenCount", "inputTokens"), n("candidatesTokenCount", "outputTokens"), n("totalTokenCount")
    return F.struct(i.alias("input"), o.alias("output"), F.when(total > 0, total).otherwise(i + o).alias("total"))


def teacher_reply(text: Column) -> Column:
    """The teacher's ``keep_recipe, reject_reason, candidates`` out of JSON; null if it isn't of that form.

    keep_recipe must be true or false; candidates may be missing, else each needs output, rationale and a known source.
    """
    kind = lambda v, path: F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    parsed = F.try_parse_json(text)
    items = F.try_variant_get(parsed, "$.candidate_outputs", "array<variant>")
    told = lambda i: F.struct(*[_said(k)(i).alias(k) for k in ("output", "source", "rationale")])
    whole = lambda c: c["output"].isNotNull() & c["rationale"].isNotNull() & F.coalesce(c["source"].isin(*SOURCES), F.lit(False))
    candidates = F.transform(items, told)
    usable = (kind(parsed, "$.keep_recipe") == "BOOLEAN") & F.coalesce(kind(parsed, "$.reject_reason").isin("STRING", "VOID"), F.lit(True)) & (kind(parsed, "$.candidate_outputs").isNull() | F.coalesce(F.forall(candidates, whole), F.lit(False)))
    return F.when(usable, F.struct(F.try_variant_get(parsed, "$.keep_recipe", "boolean").alias("keep_recipe"), _said("reject_reason")(parsed).alias("reject_reason"), candidates.alias("candidates")))


def imported(replies: DataFrame, index: DataFrame, done: DataFrame, limit: int = 5, q: Quality = TEACHER) -> DataFrame:
    """Batch replies (``position, line``) with their ``outcome`` and, if written, ``candidate_outputs``.

    ``index``: record_id, split, input_a, input_b, outputs; ``done``: split, input_a, input_b of recipes written before.
    The first outcome that holds: parse_error (no JSON), missing_batch_record_id (none in the request, or unknown),
    skipped_existing (done before, or by a reply before this one), batch_row_error (a status),
    batch_response_parse_error, a reason to reject the recipe, written.
    """
    key = lambda df: [df["split"], *[concept(F.coalesce(df[c], F.lit(""))) for c in ("input_a", "input_b")]]
    names = ("split", "_a", "_b")
    rows = replies.select("position", "line", request_id(F.col("line")).alias("record_id"), F.try_parse_json("line").isNull().alias("_bad"), F.coalesce(F.get_json_object("line", "$.status"), F.lit("")).alias("_status"))
    rows = rows.join(index.select("record_id", *[k.alias(n) for k, n in zip(key(index), names, strict=True)], "input_a", "input_b", "outputs", F.lit(True).alias("_known")), "record_id", "left")
    before = done.select(*[k.alias(n) for k, n in zip(key(done), names, strict=True)], F.lit(True).alias("_done")).distinct()
    rows = rows.join(before, rows["split"].eqNullSafe(before["split"]) & (rows["_a"] == before["_a"]) & (rows["_b"] == before["_b"]), "left").select(rows["*"], "_done")
    rows = enriched(rows.withColumn("reply", teacher_reply(reply_text(F.col("line")))), limit, q)
    outcome = (
        F.when(F.col("_bad"), "parse_error").when(F.col("_known").isNull(), "missing_batch_record_id").when(F.col("_done"), "skipped_existing").when(F.col("_status") != "", "batch_row_error")
        .when(F.col("reply").isNull(), "batch_response_parse_error").otherwise(F.coalesce("reject_reason", F.lit("written")))
    )
    rows = materialize(rows.select("position", "record_id", *names, outcome.alias("outcome"), "candidate_outputs"), "imported")
    first = rows.filter("outcome = 'written'").groupBy(*names).agg(F.min("position").alias("_first"))
    again = rows.alias("r").join(first.alias("f"), F.col("r.split").eqNullSafe(F.col("f.split")) & (F.col("r._a") == F.col("f._a")) & (F.col("r._b") == F.col("f._b")), "left")
    late = ~F.col("outcome").isin("parse_error", "missing_batch_record_id") & F.coalesce(F.col("position") > F.col("_first"), F.lit(False))
    final = again.select("position", "record_id", F.col("r.split").alias("split"), F.when(late, "skipped_existing").otherwise(F.col("outcome")).alias("outcome"), "candidate_outputs")
    return final.withColumn("candidate_outputs", F.when(F.col("outcome") == "written", F.col("candidate_outputs")))
