"""Collects queries with their SQL, and the SQL of the text normalisers."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from tinctura.functions.concepts import GARBAGE, NO_CONCEPTS, SENTENCE_WORDS

Query = Callable[[SparkSession, str], DataFrame]


#: Decimals that fractions are shown with; sums of them depend on the order of rows in the last digits.
DECIMALS = 6


class Plans:
    """Queries by name. ``@plans.add(sql, fractions)`` registers a function under its own name.

    fractions: columns of floating-point numbers, rounded on both sides.
    """

    def __init__(self) -> None:
        self._queries: dict[str, Query] = {}
        self._sql: dict[str, str] = {}

    def add(self, sql: str | None = None, fractions: str = "") -> Callable[[Query], Query]:
        names = fractions.split()

        def keep(f: Query) -> Query:
            @wraps(f)
            def shown(spark: SparkSession, d: str) -> DataFrame:
                return f(spark, d).withColumns({c: F.round(c, DECIMALS) for c in names})

            self._queries[f.__name__] = shown if names else f
            if sql:
                rounded = ", ".join(f'round("{c}", {DECIMALS}) AS "{c}"' for c in names)
                self._sql[f.__name__] = f"SELECT * REPLACE ({rounded}) FROM ({sql})" if names else sql
            return f

        return keep

    def queries(self) -> dict[str, Query]:
        return dict(self._queries)

    def oracle_sql(self) -> dict[str, str]:
        return dict(self._sql)


_WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def key(x: str) -> str:
    return f"lower({strip(x)})"


def flat(x: str) -> str:
    return rf"trim(regexp_replace({x}, '{_WS}+', ' ', 'g'))"


def concept(x: str) -> str:
    return f"lower({flat(x)})"


def words(x: str) -> str:
    """Number of words of the answer."""
    return f"CASE WHEN {concept(f'coalesce({x}, {chr(39)*2})')} = '' THEN 0 ELSE len(string_split({concept(x)}, ' ')) END"


def bucket(x: str, modulo: int = 10_000) -> str:
    return f"(CAST('0x' || substr(sha256({x}), 1, 12) AS BIGINT) % {modulo})"


def split(a: str, b: str) -> str:
    x = bucket(f"{a} || '+' || {b}")
    return f"CASE WHEN {x} < 8000 THEN 'train' WHEN {x} < 9000 THEN 'dev' ELSE 'test' END"


_SENTENCE, _NONE = (", ".join(f"'{w}'" for w in words_) for words_ in (SENTENCE_WORDS, NO_CONCEPTS))


def garbage(x: str) -> str:
    t = strip(f"coalesce({x}, '')")
    number = rf"regexp_matches(regexp_replace({t}, '[.,%-]', '', 'g'), '^\s*[0-9]+\s*$')"
    return f"({t} = '' OR regexp_matches({t}, '{GARBAGE}') OR {number} OR starts_with({t}, '0') OR (length({t}) = 1 AND NOT regexp_matches({t}, '^[\\p{{L}}\\p{{N}}]$')))"


def defect(x: str, *, max_words: int = 3, gerunds: bool = False) -> str:
    """The first reason against a concept, or NULL."""
    t = concept(f"coalesce({x}, '')")
    w = f"regexp_extract_all({t}, '[a-z0-9]+(?:[''-][a-z0-9]+)?')"
    token = f"""CASE WHEN w IN ({_NONE}) THEN 'placeholder_token' WHEN length(w) < 2 THEN 'short_token'
        WHEN ends_with(w, 'nado') AND length(w) > 6 THEN 'suspicious_suffix'
        WHEN regexp_matches(w, '^[a-z]+$') AND length(w) >= 4 AND NOT regexp_matches(w, '[aeiou]') THEN 'vowelless_token' END"""
    gerund = "" if gerunds else f"WHEN len(list_filter({w}[2:], lambda w: ends_with(w, 'ing'))) > 0 THEN 'gerund_phrase'"
    return f"""CASE WHEN {t} = '' THEN 'empty' WHEN length({t}) > 36 THEN 'too_long' WHEN regexp_matches({t}, '{GARBAGE}') THEN 'hard_symbol'
        WHEN regexp_matches({t}, '[:?!"()]') THEN 'title_or_sentence_like' WHEN len({w}) = 0 THEN 'no_word_tokens' WHEN len({w}) > {max_words} THEN 'too_many_words'
        WHEN regexp_matches(regexp_replace({t}, '[.,%-]', '', 'g'), '^[0-9]+$') THEN 'numeric'
        WHEN len(list_filter({w}, lambda w: regexp_matches(w, '[0-9]'))) > 0 THEN 'has_digit'
        WHEN len({w}) <> len(list_distinct({w})) THEN 'repeated_token' {gerund}
        WHEN len({w}) >= 3 AND len(list_intersect({w}, [{_SENTENCE}])) > 0 THEN 'sentence_like'
        ELSE list_filter(list_transform({w}, lambda w: {token}), lambda r: r IS NOT NULL)[1] END"""


def recipe_defect(a: str, b: str, o: str) -> str:
    parts = ", ".join(f"'{n}:' || ({defect(c)})" for n, c in (("input_a", a), ("input_b", b), ("output", o)))
    return f"coalesce({parts}, CASE WHEN {o} = {a} OR {o} = {b} THEN 'identity' END)"
