"""Problem 5: text that looks the same but is made of other or additional characters.

Values are normalised for compatibility and stripped of ignorable characters; tokens that still hold look-alike
letters become a lattice of the letters they could stand for, searched with Viterbi under character bigrams of one
script at a time. Emoji are compared by what is left without invisible characters.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import defaultdict
from collections.abc import Collection

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tinctura.operators.skew import BROADCAST_BYTES, lookup
from tinctura.storage import materialize

# Letters of other scripts, or of phonetic notation, that look like plain Latin ones.
CYRILLIC = dict(zip("аеорсухіјѕһԁԛԝѵкӏүАВЕЗІЈКМНОРСТУХЅԌԚԜҮӀ", "aeopcyxijshdqwvklyABE3IJKMHOPCTYXSGQWYI", strict=True))
GREEK = dict(zip("ανορυικχγτωϲϳΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ", "avopuikxytwcjABEZHIKMNOPTYXCJ", strict=True))
LATIN = dict(zip("ɑɡıɩʏʟꞮꓲǀ", "agiiyLIIl", strict=True))
ARMENIAN = dict(zip("օսհոցքзѡ", "ouhngq3w", strict=True))
CHEROKEE = dict(zip("ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᏚᎢᏙᎳᏃ", "ABCDEGHJKLMPSTVWZ", strict=True))
LISU = dict(zip("ꓮꓐꓚꓓꓰꓝꓖꓧꓙꓗꓡꓟꓠꓳꓑꓣꓢꓔꓴꓦꓪꓫꓬꓜ", "ABCDEFGHJKLMNOPRSTUVWXYZ", strict=True))
# End of fixed values.

#: Cost of reading a letter as another one, in nats, and the count added to each bigram.
SWAP, SMOOTH = 0.5, 0.1
#: A value with any other character than these goes through the canonical form.
PLAIN = r"^[\x20-\x7e\t\n\r]*$"
_SPACES = re.compile(r"[^\S\t\n\r ]|[⠀ㅤﾠᅟᅠ]")
_JOINED = re.compile(r"(?<=[؀-߿ऀ-෿])[‌‍](?=[؀-߿ऀ-෿])")
_TOKEN = re.compile(r"[^\W\d_]+")
#: For letters only the bigrams of these code points are counted, so that the model's size is bounded.
_ALPHABETS = {"latin": (0x41, 0x24F), "greek": (0x370, 0x3FF), "cyrillic": (0x400, 0x52F)}


def script(c: str) -> str:
    """The script of a letter, as far as look-alikes go; other scripts are all ``other``."""
    o = ord(c)
    if o < 0x250 or 0x1E00 <= o < 0x1F00 or 0x250 <= o < 0x2B0:
        return "latin"
    return "greek" if 0x370 <= o < 0x400 or 0x1F00 <= o < 0x2000 else "cyrillic" if 0x400 <= o < 0x530 else "other"


def _options(c: str) -> list[str]:
    """The letters that ``c`` may stand for: itself and the plain letters it looks like."""
    out = [c]
    for t in (CYRILLIC, GREEK, LATIN, ARMENIAN, CHEROKEE, LISU):
        if c in t:
            out.append(t[c])
    base = unicodedata.normalize("NFD", c)
    if len(base) > 1 and script(c) in ("greek", "cyrillic"):
        out += [unicodedata.normalize("NFC", o + base[1:]) for o in _options(base[0])[1:]]
    return out + [k for t in (CYRILLIC, GREEK) for k, v in t.items() if v == c]


class Reader:
    """Reads tokens as the plain letters meant. counts: ``{(script, first, second): n}`` of lower-case letters."""

    def __init__(self, counts: dict[tuple[str, str, str], int]):
        self.pair: dict[tuple[str, str, str], float] = defaultdict(float, counts)
        self.from_: dict[tuple[str, str], float] = defaultdict(float)
        self.letters: dict[str, float] = defaultdict(float)
        kinds: dict[str, set[str]] = defaultdict(set)
        for (s, a, b), n in counts.items():
            self.from_[s, a] += n
            self.letters[s] += n
            kinds[s].add(b)
        self.kinds = {s: len(k) + 40 for s, k in kinds.items()}
        self.all = sum(self.letters.values())
        self.known: dict[str, str] = {}

    def cost(self, s: str, a: str, b: str) -> float:
        a, b = a.lower(), b.lower()
        return -math.log((self.pair[s, a, b] + SMOOTH) / (self.from_[s, a] + SMOOTH * self.kinds.get(s, 40)))

    def read(self, token: str) -> str:
        """The best reading in one script; the token itself if all its letters can't be of one."""
        if token.isascii():
            return token
        if token not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[token] = self._read(token)
        return self.known[token]

    def latin(self, token: str) -> str | None:
        """The best reading in Latin letters alone; None if a letter looks like none."""
        found = self._read(token, ("latin",))
        return found if all(script(c) == "latin" for c in found) else None

    def _read(self, token: str, scripts: tuple[str, ...] = ("latin", "greek", "cyrillic")) -> str:
        best, least = token, math.inf
        for s in scripts:
            ways = {"^": (-math.log((self.letters[s] + 1) / (self.all + 3)), "")}
            for c in token:
                step: dict[str, tuple[float, str]] = {}
                for o in _options(c):
                    if script(o) != s and o.isalpha():
                        continue
                    for last, (cost, text) in ways.items():
                        new = cost + self.cost(s, last, o) + SWAP * (o != c)
                        if o not in step or new < step[o][0]:
                            step[o] = (new, text + o)
                ways = step
            for last, (cost, text) in ways.items():
                if (total := cost + self.cost(s, last, "$")) < least:
                    best, least = text, total
        return best

    def visible(self, text: str) -> str:
        """``text`` in composed, compatible, visible characters, its spaces plain."""
        kept = []
        for i, c in enumerate(text):
            kind = unicodedata.category(c)
            hidden = kind == "Cf" or (kind == "Cc" and c not in "\t\n\r") or c == "͏" or "︀" <= c <= "️"
            if not hidden or _JOINED.match(text, i):
                kept.append(c)
        return _SPACES.sub(" ", unicodedata.normalize("NFKC", _SPACES.sub(" ", "".join(kept))))

    def doubtful(self, text: str) -> list[tuple[str, str]]:
        """Words wholly of another script in a text with Latin letters, with what they would be in Latin ones; lower case."""
        text = self.visible(text).lower()
        if not any(script(c) == "latin" and c.isalpha() for c in text):
            return []
        words = {w for w in _TOKEN.findall(text) if _of_one_script(w) and script(w[0]) != "latin"}
        return [(w, r) for w in sorted(words) if (r := self.latin(w))]

    def canonical(self, text: str, meant: Collection[str] = ()) -> str:
        """``text`` in composed, compatible, visible characters, its tokens of one script, its spaces plain.

        A word wholly of another script stays, unless its lower-case form is one of those ``meant`` as Latin words.
        """
        return _TOKEN.sub(lambda m: m[0] if _of_one_script(m[0]) and script(m[0][0]) != "latin" and m[0].lower() not in meant else self.read(m[0]), self.visible(text))


def _of_one_script(word: str) -> bool:
    return len({script(c) for c in word}) == 1


def word_counts(values: DataFrame, col: str) -> DataFrame:
    """``w, count`` of all words in lower case, and ``alone``: how often in values without Latin letters; written."""
    other = ~F.col(col).rlike(r"\p{IsLatin}")
    words = values.select(F.explode(F.regexp_extract_all(F.lower(col), F.lit(r"(\p{L}+)"), F.lit(1))).alias("w"), other.cast("int").alias("alone"))
    return materialize(words.groupBy("w").agg(F.count("*").alias("count"), F.sum("alone").alias("alone")), "words")


def bigram_counts(words: DataFrame) -> dict[tuple[str, str, str], int]:
    """Counts of letter pairs in all words of one script; at most the square of the alphabets' letters."""
    rows = None
    for s, (low, high) in _ALPHABETS.items():
        own = words.filter(F.col("w").rlike(f"^[\\x{{{low:x}}}-\\x{{{high:x}}}]+$"))
        w = F.concat(F.lit("^"), "w", F.lit("$"))
        part = own.select(F.lit(s).alias("s"), "count", F.explode(F.transform(F.sequence(F.lit(1), F.length("w") + 1), lambda i: F.substring(w, i, F.lit(2)))).alias("p"))  # noqa: B023
        rows = part if rows is None else rows.unionByName(part)
    return {(r["s"], r["p"][0], r["p"][1]): r["n"] for r in rows.groupBy("s", "p").agg(F.sum("count").alias("n")).toLocalIterator()}


def canonical_values(values: DataFrame, col: str, *, corpus: DataFrame | None = None, bound: int = BROADCAST_BYTES) -> DataFrame:
    """``values`` with ``canonical``, the consistent form of ``col``; what plain ASCII values hold never reaches Python.

    Words are counted over ``corpus`` (``values`` itself if none is given). Null stays null, an empty text empty. Letters in upper case stay so; line breaks and tabs stay. A word wholly of
    another script beside Latin letters is read as a Latin word only if some value holds that Latin word, and no value
    without Latin letters holds the word itself.
    """
    words = word_counts(values if corpus is None else corpus, col)
    model = values.sparkSession.sparkContext.broadcast(bigram_counts(words))
    held: list[Reader] = []

    def reader() -> Reader:
        if not held:
            held.append(Reader(model.value))
        return held[0]

    @F.pandas_udf("array<struct<word:string,latin:string>>")
    def doubtful(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"word": w, "latin": r} for w, r in reader().doubtful(t)] for t in texts], dtype=object)

    @F.pandas_udf("string")
    def canonical(texts: pd.Series, meant: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else reader().canonical(t, () if m is None else frozenset(m)) for t, m in zip(texts, meant, strict=True)], dtype=object)

    odd = ~F.col(col).rlike(PLAIN)
    mixed = values.select(col).filter(odd & F.col(col).rlike(r"\p{IsLatin}") & F.col(col).rlike(r"[^\p{IsLatin}\p{IsCommon}\p{IsInherited}]")).distinct()
    open_ = mixed.select(col, F.explode(doubtful(col)).alias("d")).select(col, "d.word", "d.latin")
    open_ = open_.join(words.select(F.col("w").alias("latin")), "latin", "left_semi").join(words.filter("alone > 0").select(F.col("w").alias("word")), "word", "left_anti")
    meant = open_.groupBy(col).agg(F.collect_set("word").alias("_meant"))  # as many as the value has words
    rows = lookup(values, meant, [col], bound=bound).select(*values.columns, "_meant")
    return rows.withColumn("canonical", F.when(odd, canonical(F.when(odd, F.col(col)), "_meant")).otherwise(F.col(col))).drop("_meant")


def emoji_key(col: Column | str) -> Column:
    """What is seen of an emoji: without spaces, invisible characters and style selectors; inner joiners stay."""
    col = F.col(col) if isinstance(col, str) else col
    seen = F.regexp_replace(col, r"[\s\p{Z}\p{Cc}\x{ad}\x{34f}\x{61c}\x{115f}\x{1160}\x{17b4}\x{17b5}\x{180b}-\x{180f}\x{200b}\x{200c}\x{200e}\x{200f}\x{202a}-\x{202e}\x{2060}-\x{206f}\x{2800}\x{3164}\x{fe00}-\x{fe0f}\x{feff}\x{ffa0}]", "")
    return F.regexp_replace(seen, "^‍+|‍+$|(?<=‍)‍+", "")


def emoji_forms(reference: DataFrame) -> DataFrame:
    """``key, emoji, is_placeholder`` of each listed emoji; one row per key (the first in order)."""
    rows = reference.filter("emoji is not null").select(emoji_key("emoji").alias("key"), "emoji", "is_placeholder")
    return rows.groupBy("key").agg(F.min_by("emoji", "emoji").alias("emoji"), F.min_by("is_placeholder", "emoji").alias("is_placeholder")).filter("key <> ''")


def odd_emoji(obs: DataFrame, reference: DataFrame) -> DataFrame:
    """``obs_id, listed``: rows whose emoji looks like a listed one without being one, and the form to keep."""
    known = reference.select(F.col("emoji").alias("emoji_output")).distinct()
    shown = obs.select("obs_id", "emoji_output").filter("emoji_output is not null and not emoji_output rlike '^[\\\\x00-\\\\x7f]*$'")
    like = lookup(shown, known, ["emoji_output"], how="left_anti").withColumn("key", emoji_key("emoji_output"))
    return lookup(like, emoji_forms(reference).select("key", F.col("emoji").alias("listed")), ["key"], how="inner").select("obs_id", "listed")


def lookalikes(obs: DataFrame, reference: DataFrame, *, bound: int = BROADCAST_BYTES) -> DataFrame:
    """``obs_id, field_name``: outputs and emoji that look ordinary but are made of other characters.

    Null, empty and blank values are no case (but a value of invisible characters only is); repeated rows come out
    each; an empty table gives none; texts of any length are read whole; further columns don't matter.
    """
    odd = obs.select("obs_id", "output").filter(~F.col("output").rlike(PLAIN))
    text = canonical_values(odd, "output", corpus=obs.select("output"), bound=bound).filter("output <> canonical").select("obs_id", F.lit("output").alias("field_name"))
    return text.unionByName(odd_emoji(obs, reference).select("obs_id", F.lit("emoji_output").alias("field_name")))


def one_form(obs: DataFrame, reference: DataFrame) -> DataFrame:
    """``obs_id, output, emoji_output`` with every value in its one consistent form."""
    forms = emoji_forms(reference).select("key", F.col("emoji").alias("listed"))
    out = canonical_values(obs.select("obs_id", "output", "emoji_output"), "output").select("obs_id", F.col("canonical").alias("output"), "emoji_output", emoji_key("emoji_output").alias("key"))
    return lookup(out, forms, ["key"]).select("obs_id", "output", F.coalesce("listed", "emoji_output").alias("emoji_output"))
