"""Quality rules for concepts and recipes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from tinctura.functions.text import Name, col, concept, let, stripped

# Characters no concept holds, marks of titles, words of sentences, the form of a word, the sign of a missing emoji, endings and words no concept has.
GARBAGE = r"[#`;{}\[\]|\\<>+*=]"
TITLE_MARKS = r"[:?!\"()]"
SENTENCE_WORDS = ("because", "inside", "instead", "that", "this", "when", "while", "with", "without", "your")
WORD = r"([a-z0-9]+(?:['-][a-z0-9]+)?)"
PLACEHOLDER = "⚪"
SUFFIXES = ("nado",)
NO_CONCEPTS = ("undefined", "unknown", "null", "none")
# End of fixed values.


@dataclass(frozen=True)
class Quality:
    """Limits of a clean concept."""

    max_words: int = 3
    max_chars: int = 36
    min_word_chars: int = 2
    digits: bool = False
    gerunds: bool = False
    sentence_words: bool = False
    vowelless_from: int = 4
    suffixes: tuple[str, ...] = SUFFIXES
    placeholders: tuple[str, ...] = NO_CONCEPTS


def is_garbage(c: Name) -> Column:
    """null or empty, code characters, only a number, a leading zero, or a single sign."""

    def judged(text: Column) -> Column:
        number = F.regexp_replace(text, r"[.,%-]", "").rlike(r"^\s*[0-9]+\s*$")
        sign = (F.length(text) == 1) & ~text.rlike(r"^[\p{L}\p{N}]$")
        return (text == "") | text.rlike(GARBAGE) | text.startswith("0") | sign | number

    return let(stripped(F.coalesce(col(c), F.lit(""))), judged)


def concept_defect(c: Name, q: Quality = Quality()) -> Column:
    """the first reason against a concept, null if there is none. The text and its words are computed once."""

    def word_defect(w: Column) -> Column:
        out = F.when(w.isin(*q.placeholders), "placeholder_token").when(F.length(w) < q.min_word_chars, "short_token")
        if q.suffixes:
            bad = [w.endswith(s) & (F.length(w) > len(s) + 2) for s in q.suffixes]
            hit = bad[0]
            for b in bad[1:]:
                hit = hit | b
            out = out.when(hit, "suspicious_suffix")
        return out.when((F.length(w) >= q.vowelless_from) & w.rlike("^[a-z&&[^aeiou]]+$"), "vowelless_token")

    def of_words(text: Column, words: Column) -> Column:
        found = (
            F.when(F.size(words) == 0, "no_word_tokens")
            .when(F.size(words) > q.max_words, "too_many_words")
            .when(F.regexp_replace(text, "[.,%-]", "").rlike("^[0-9]+$"), "numeric")
            .when(F.lit(not q.digits) & F.exists(words, lambda w: w.rlike("[0-9]")), "has_digit")
            .when(F.size(words) != F.size(F.array_distinct(words)), "repeated_token")
            .when(F.lit(not q.gerunds) & F.exists(F.slice(words, 2, 1 << 20), lambda w: w.endswith("ing")), "gerund_phrase")
            .when(F.lit(not q.sentence_words) & (F.size(words) >= 3) & F.arrays_overlap(words, F.array(*map(F.lit, SENTENCE_WORDS))), "sentence_like")
        )
        return F.coalesce(found, F.get(F.filter(F.transform(words, word_defect), lambda r: r.isNotNull()), F.lit(0)))

    def of_text(text: Column) -> Column:
        return (
            F.when(text == "", "empty")
            .when(F.length(text) > q.max_chars, "too_long")
            .when(text.rlike(GARBAGE), "hard_symbol")
            .when(text.rlike(TITLE_MARKS), "title_or_sentence_like")
            .otherwise(let(F.regexp_extract_all(text, F.lit(WORD), F.lit(1)), lambda words: of_words(text, words)))
        )

    return let(concept(F.coalesce(col(c), F.lit(""))), of_text)


def recipe_defect(a: Name, b: Name, output: Name, q: Quality = Quality()) -> Column:
    """the first reason against a recipe, with the field's name, or ``identity``; null if there is none."""
    parts = [F.concat(F.lit(f"{n}:"), concept_defect(c, q)) for n, c in (("input_a", a), ("input_b", b), ("output", output))]
    return F.coalesce(*parts, F.when((col(output) == col(a)) | (col(output) == col(b)), "identity"))


def source_matches(source: Name, names: tuple[str, ...] = (), prefixes: tuple[str, ...] = ()) -> Column:
    """one of the names, or one of the prefixes."""
    hit = col(source).isin(*names) if names else F.lit(False)
    for p in prefixes:
        hit = hit | col(source).startswith(p)
    return F.coalesce(hit, F.lit(False))


def usable_generation(output: Name, a: Name, b: Name, max_chars: int = 48, max_words: int = 5) -> Column:
    """a generated concept that isn't empty, an input, or too long."""
    text = concept(F.coalesce(col(output), F.lit("")))
    return (text != "") & (text != concept(a)) & (text != concept(b)) & (F.length(text) <= max_chars) & (F.size(F.split(text, " ")) <= max_words)
