"""Text normalisers as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

Name = Column | str
_SPACE = r"(?U)[\s\x1c-\x1f]+"
#: White space of any kind, to strip; a text without any but single plain spaces needs no pattern.
_BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_ODD = r"[^ -~]|  "

# Words a generated concept is cut before; the texts of prompts.
CONNECTORS = "with|and|or|of|in|for|to|on|from|by"
PLAIN_PROMPT = "Input A: %s\nInput B: %s\nFinal concept:"
REASONED_PROMPT = "Input A: %s\nInput B: %s\nRationale:"
CHAT_PROMPT = "Given two concepts, combine them into one resulting concept.\n\nConcept A: %s\nConcept B: %s\n\nReturn only the resulting concept."
BEFORE_CONCEPT, BEFORE_RATIONALE = "\nFinal concept: ", "\nRationale: "
# End of fixed values.


def col(c: Name) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def stripped(c: Name) -> Column:
    """Without white space, of any kind, at either end."""
    return F.trim(col(c), F.lit(_BLANKS))


def one_line(c: Name) -> Column:
    """Stripped, each run of white space one space; case stays."""
    text = col(c)
    return F.trim(F.when(text.rlike(_ODD), F.regexp_replace(text, _SPACE, " ")).otherwise(text))


def concept(c: Name) -> Column:
    """Stripped, lower case, each run of white space one space."""
    return F.lower(one_line(c))


def answer(c: Name) -> Column:
    """Like ``concept``; null is the empty text."""
    return concept(F.coalesce(col(c), F.lit("")))


def key(c: Name) -> Column:
    """Stripped and lower case; inner white space stays."""
    return F.lower(stripped(c))


def ordered(a: Name, b: Name) -> tuple[Column, Column]:
    """Both inputs, swapped if that puts their lower-case forms in order; spelling stays."""
    right = F.lower(col(a)) <= F.lower(col(b))
    return F.when(right, col(a)).otherwise(col(b)), F.when(right, col(b)).otherwise(col(a))


def pair_key(a: Name, b: Name) -> Column:
    """P5: both in order, joined by ``+``."""
    return F.concat_ws("+", F.least(col(a), col(b)), F.greatest(col(a), col(b)))


def compact(c: Name) -> Column:
    """The concept without spaces, hyphens and apostrophes."""
    return F.translate(concept(c), " -'", "")


def reject_reason(c: Name) -> Column:
    """Lower case, spaces to ``_``, 80 characters at most; blank or null: the default reason."""
    text = concept(c)
    return F.substring(F.translate(F.when(F.coalesce(text, F.lit("")) == "", "teacher_rejected_recipe").otherwise(text), " ", "_"), 1, 80)


def slug(c: Name) -> Column:
    """Lower case, runs of other characters than letters and digits one ``_``, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(col(c)), r"[^\p{L}\p{N}]+", "_"), "^_+|_+$", "")


def storage_segment(c: Name) -> Column:
    """P10: lower case, other runs than ``a-z 0-9 _ -`` one ``-``; ``anonymous`` if nothing is left."""
    text = F.regexp_replace(F.lower(F.coalesce(stripped(c), F.lit(""))), "[^a-z0-9_-]+", "-")
    return F.when(text == "", "anonymous").otherwise(text)


def word_count(c: Name) -> Column:
    """Words of the answer; none for null and blank."""
    return let(answer(c), lambda text: F.when(text == "", 0).otherwise(F.size(F.split(text, " "))))


def without_thoughts(c: Name) -> Column:
    """What follows the first ``</think>``; nothing if a ``<think>`` stays open; else the text as it is."""
    text = col(c)
    after = F.substr(text, F.locate("</think>", text) + F.lit(8))
    return F.when(F.contains(text, F.lit("</think>")), after).when(F.contains(text, F.lit("<think>")), "").otherwise(text)


def generated_concept(c: Name, max_words: int = 3) -> Column:
    """A concept cut out of generated text.

    The first line up to the first of ``.:;?!()[]{}``, asterisks as spaces, up to a connecting word wherever it
    stands as a word of its own, each word without commas, hyphens and underscores at its ends; at most ``max_words``
    words, all of them if that is 0.
    """
    line = F.regexp_extract(stripped(F.coalesce(col(c), F.lit(""))), r"^([^\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]*)", 1)
    head = F.regexp_extract(line, r"^([^.:;?!()\[\]{}]*)", 1)
    flat = F.regexp_replace(F.translate(stripped(head), "*", " "), _SPACE, " ")
    cut = F.regexp_replace(flat, rf"(?is)(?<![\p{{L}}\p{{N}}_])(?:{CONNECTORS})(?![\p{{L}}\p{{N}}_]).*$", "")
    words = F.filter(F.transform(F.split(cut, " "), lambda w: F.regexp_replace(w, "^[,_-]+|[,_-]+$", "")), lambda w: w != "")
    return F.array_join(F.slice(words, 1, max_words) if max_words > 0 else words, " ")


def model_concept(c: Name) -> Column:
    """The concept in a model's reply, normalised.

    Closed thoughts and control tokens go; of the lines the first counts that holds something once quotation marks at
    its ends and then a label (``concept:``, ``resulting concept:``) are taken off.
    """
    text = F.regexp_replace(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"(?is)<think>.*?</think>", ""), r"<\|[^|]+?\|>", "")
    bare = lambda x: stripped(F.regexp_replace(F.regexp_replace(stripped(x), "^[\"'`]+|[\"'`]+$", ""), r"(?iU)^(?:resulting\s+concept|concept)\s*:\s*", ""))
    lines = F.filter(F.transform(F.split(stripped(text), r"\r?\n"), bare), lambda x: x != "")
    return concept(F.coalesce(F.get(lines, F.lit(0)), F.lit("")))


def without_fence(c: Name) -> Column:
    """Without the first and the last line of a Markdown fence, if it begins with one."""
    text = stripped(c)
    opened = F.regexp_replace(text, r"^```[^\n]*\n?", "")
    return F.when(text.startswith("```"), stripped(F.regexp_replace(opened, r"(?:^|\n)[^\S\n]*```[^\S\n]*$", ""))).otherwise(text)


def outer_object(c: Name) -> Column:
    """From the first ``{`` to the last ``}``; null if there is none."""
    found = F.regexp_extract(col(c), r"(?s)\{.*\}", 0)
    return F.when(found != "", found)


def human_size(c: Name) -> Column:
    """Thousands that divide evenly as ``k``."""
    n = col(c)
    return F.when((n >= 1000) & (n % 1000 == 0), F.concat((n / 1000).cast("long").cast("string"), F.lit("k"))).otherwise(n.cast("string"))


def human_duration(seconds: Name) -> Column:
    """``1h02m03s``, ``2m03s`` or ``3s``; rounded half to even, never below 0."""
    s = F.greatest(F.bround(col(seconds)), F.lit(0.0)).cast("long")
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return F.when(h > 0, F.format_string("%dh%02dm%02ds", h, m, r)).when(m > 0, F.format_string("%dm%02ds", m, r)).otherwise(F.format_string("%ds", r))


def prompt(a: Name, b: Name) -> Column:
    """The plain prompt for a pair."""
    return F.format_string(PLAIN_PROMPT, col(a), col(b))


def chat_prompt(a: Name, b: Name) -> Column:
    """The user's message of a chat about a pair."""
    return F.format_string(CHAT_PROMPT, col(a), col(b))


def prompt_spans(a: Name, b: Name, output: Name, rationale: Name | None = None, *, rationale_first: bool = False) -> Column:
    """A prompt with its completion: ``text, start, end, rationale_start, rationale_end``, spans in code points.

    The rationale stands after the concept, or before it if ``rationale_first``; without one (null or empty) its span
    is 0, 0 and the plain prompt is used.
    """
    out, why = col(output), F.coalesce(col(rationale), F.lit("")) if rationale is not None else F.lit("")
    plain, reasoned = prompt(a, b), F.format_string(REASONED_PROMPT, col(a), col(b))
    start = F.length(plain) + 1
    end = start + F.length(out)
    after = end + len(BEFORE_RATIONALE)
    spans = lambda *x: F.struct(*[v.alias(n) for v, n in zip(x, ("text", "start", "end", "rationale_start", "rationale_end"), strict=True)])
    none = F.lit(0)
    bare = spans(F.concat(plain, F.lit(" "), out), start, end, none, none)
    if rationale_first:
        why_at = F.length(reasoned) + 1
        at = why_at + F.length(why) + len(BEFORE_CONCEPT)
        told = spans(F.concat(reasoned, F.lit(" "), why, F.lit(BEFORE_CONCEPT), out), at, at + F.length(out), why_at, why_at + F.length(why))
    else:
        told = spans(F.concat(plain, F.lit(" "), out, F.lit(BEFORE_RATIONALE), why), start, end, after, after + F.length(why))
    return F.when(why == "", bare).otherwise(told)


def batch_request(text: Name, candidates: Column) -> Column:
    """A generation request as JSON; room for 256 tokens a candidate, 2048 at least."""
    part = F.array(F.struct(col(text).alias("text")))
    contents = F.array(F.struct(F.lit("user").alias("role"), part.alias("parts")))
    room = F.struct(F.greatest(F.lit(2048), candidates * 256).cast("int").alias("maxOutputTokens"))
    return F.to_json(F.struct(F.struct(contents.alias("contents"), room.alias("generationConfig")).alias("request")))


def day_seed(ts: Name, what: Name, prefix: str = "goal") -> Column:
    """``prefix:YYYY-MM-DD:what`` of a UTC day."""
    return F.concat_ws(":", F.lit(prefix), F.date_format(col(ts), "yyyy-MM-dd"), col(what).cast("string"))


def first_number(*cols: Column) -> Column:
    """The first that is neither null nor zero, else 0."""
    return F.coalesce(*[F.nullif(c, F.lit(0)) for c in cols], F.lit(0))
