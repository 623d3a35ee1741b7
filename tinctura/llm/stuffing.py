"""Problem 9: documents of stuffed keywords, link lists or product tags instead of sentences.

Each text is read in windows of words; of each window the share of function words, of its most frequent word, of
words in links and of separators is measured, and whether its line repeats. What is usual is calibrated for each
language over all documents: the share of function words by its median, the others by what sentences of the language
rarely exceed. A language without a list of function words learns one from the documents that are labelled with it;
where neither is there, function words tell nothing and aren't asked for. A document is spam if most of its words stand
in windows that are.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tinctura.storage import materialize, spread

# Frequent function words by language (not "of", which joins names in lists as well).
FUNCTION_WORDS = {
    "en": "the and to in is that for it was on at by from with as an a into this up than when i you my we not can never only one two there had have are be did or if so any no us our them they their its but after before while which who what how then about each some across among more first every both will would could should because until yes no said much just been were has he she his her him am",
    "es": "el la los las de del que y en un una por con se lo le como para pero al es su sus nadie más sin sobre entre muy este esta eso no hasta cuando quien ya son fue ser hay donde después todo aunque siendo junto",
    "fr": "le la les de des du et en un une que qui ce cette dans par pour sur pas plus est sont il elle nous vous ne se sa son ses au aux avec mais ou où comme tout très sans sous peu fait être tant près après vers reste change deux",
    "de": "der die das den dem des und in zu auf von ein eine einen einem für ist sind nicht mit als auch es an am im bei nach aus wie so über bis wird war sich was wenn oder nur noch kaum zum zur dass alle alles niemand viele gegen neben zwei",
    "it": "è il lo la gli le di del della che e un una per con non si sono come ma più questo nel alla dei da",
    "pt": "é o os as de do da dos das que e um uma por com não se como mas mais este no na em para seu sua",
    "nl": "de het een van en in is dat op te zijn met voor niet aan er om ook als maar bij uit naar dan",
}
# End of fixed values.

_WORD, _LINES = re.compile(r"[^\W_]+"), re.compile(r"[\n\r]+")
_LINK = re.compile(r"https?://\S+|www\.\S+|<a\b[^>]*>|</a>|<br\s*/?>|\]\([^)\s]*\)|#\w+|\S+@\S+\.\w+|\bSKU\S*", re.I)
_SEPARATOR = re.compile(r"[|·•»›;,/\\*#=<>\[\]]|\s-\s")
#: What may begin a link; a word that stands for each word of one.
_HINT, _LINKED = re.compile(r"http|www\.|<|\]\(|#|@|sku"), "ꙮ"
#: Words in a window; a line's last window may be half as long again.
WINDOW = 24
_SPAN = re.compile(rf"[^\W_]+(?:[\W_]+[^\W_]+){{0,{WINDOW - 1}}}[\W_]*")
#: A window lacks sentences if its share of function words is below this part of its language's usual share: the first
#: if it looks like a list as well, the second if not.
MISSING, ABSENT = 0.5, 0.15
#: Of the words of a window: links, the most frequent word, separators a word, repeated pairs, for it to look like a
#: list; the last three at least, and at least what USUAL of the language's windows with sentences stay below.
LINKED, TOP_WORD, SEPARATED, PAIRED, USUAL = 0.5, 0.2, 0.25, 0.3, 0.99
#: Share of one content word that no sentence has, whatever stands between.
REPEATED = 0.35
#: Words of a text that must be function words of a language for it to be that language's by them alone.
TOLD = 0.1
#: Documents of a language without a list that it is learnt from at least, the share of them that hold a function word,
#: and its words at most.
LEARN_DOCS, LEARN_SHARE, LEARN_WORDS = 50, 0.3, 100
#: Share of a document's words in such windows.
MOSTLY = 0.5
#: Shorter texts repeat nothing; they are spam only if most of their words are linked.
LEAST_WORDS = 6

_FEATURES = "doc_id long, lang string, words int, functional int, linked int, top int, separators int, pairs int, repeated boolean"


class Languages:
    """Function words by language: the lists given and those learnt."""

    def __init__(self, learnt: dict[str, list[str]] | None = None):
        self.words = {k: frozenset(v.split()) for k, v in FUNCTION_WORDS.items()} | {k: frozenset(v) for k, v in (learnt or {}).items()}
        self.of: dict[str, list[str]] = {}
        for k, v in self.words.items():
            for w in v:
                self.of.setdefault(w, []).append(k)

    def most(self, counts: Counter, given: str | None) -> tuple[str, int]:
        """The language with the most function words among counted words, and their number; of equals the one given."""
        score = dict.fromkeys(self.words, 0)
        for w in counts.keys() & self.of.keys():
            for k in self.of[w]:
                score[k] += counts[w]
        best = max(score, key=lambda k: (score[k], k == given))
        return best, score[best]


def windows(text: str, given: str | None, known: Languages) -> Iterator[tuple[str, int, int, int, int, int, int, bool]]:
    """``lang, words, functional, linked, top, separators, pairs, repeated`` of each window of ``text``.

    lang is empty if neither the text nor ``given`` tells a language with known function words. pairs: words that begin
    a word pair which the text's windows short of function words (under a quarter) hold three times or more, link
    words aside; counted in those windows only.
    """
    lines = [x for x in _LINES.split(text.lower()) if x and not x.isspace()]
    seen = Counter(map(str.strip, lines)) if len(lines) > 2 else {}
    parsed: list[tuple[list[str], int, int, bool]] = []
    for line in lines:
        again = bool(seen) and seen[line.strip()] > 2
        if _HINT.search(line):
            line = _LINK.sub(_as_links, line)
        words = _WORD.findall(line)
        if len(words) < WINDOW + WINDOW // 2:
            parts = [(words, line[_WORD.search(line).start() :])] if words else []
        else:
            cuts = [m.start() for m in _SPAN.finditer(line)]
            if len(words) % WINDOW and len(words) % WINDOW < WINDOW // 2:
                cuts.pop()  # too few for a window of their own
            ends = [*cuts[1:], len(line)]
            parts = [(words[k * WINDOW : (k + 1) * WINDOW if k < len(cuts) - 1 else None], line[i:j]) for k, (i, j) in enumerate(zip(cuts, ends, strict=True))]
        for words, piece in parts:
            linked = words.count(_LINKED)
            parsed.append(([w for w in words if w != _LINKED] if linked else words, linked, len(_SEPARATOR.findall(piece)), again))
    total = sum(len(plain) for plain, *_ in parsed)
    lang, own = given or "", known.words.get(given or "", frozenset())
    functionals = [sum(map(own.__contains__, plain)) for plain, *_ in parsed]
    if sum(functionals) < 0.25 * total or not own:  # the label may be wrong, or there is none
        lang, told = known.most(Counter(chain.from_iterable(plain for plain, *_ in parsed)), given)
        if told < TOLD * total:
            lang = given if given in known.words else ""
        if own is not (new := known.words.get(lang, frozenset())):
            own = new
            functionals = [sum(map(own.__contains__, plain)) for plain, *_ in parsed]
    judged = []
    near: Counter = Counter()
    for (plain, linked, separators, again), functional in zip(parsed, functionals, strict=True):
        here, words = lang, own
        if few := functional < 0.25 * len(plain):  # quotations may be in another language
            other, n = known.most(Counter(plain), lang)
            if n > functional and n >= TOLD * len(plain) and lang:
                here, words, functional = other, known.words[other], n
            if few := functional < 0.25 * len(plain):
                near.update(zip(plain, plain[1:]))
        judged.append((plain, linked, separators, again, here, words, functional, few))
    often = {x for x, n in near.items() if n > 2}
    for plain, linked, separators, again, here, words, functional, few in judged:
        # No word can come more often than this; up to TOP_WORD of the words it makes no difference which does.
        top = len(plain) - len(set(plain)) + (1 if plain else 0)
        if top > TOP_WORD * len(plain):
            top = max(Counter([w for w in plain if w not in words]).values(), default=0)
        frequent = sum(x in often for x in zip(plain, plain[1:])) if few and often else 0
        yield here, len(plain) + linked, functional, linked, top, separators, frequent, again


def _as_links(link: re.Match) -> str:
    return " " + f"{_LINKED} " * len(_WORD.findall(link[0]))


def label(lang: Column) -> Column:
    """The two letters of a language's label; null if there are none."""
    return F.nullif(F.regexp_extract(F.lower(F.coalesce(lang, F.lit(""))), r"^\s*([a-z]{2})", 1), F.lit(""))


def learnt_words(documents: DataFrame) -> dict[str, list[str]]:
    """Function words of labelled languages without a list: those that many documents of the language hold.

    At most LEARN_WORDS for each two-letter label reach the driver. Documents of languages with a list aren't read.
    """
    rows = documents.select("text", label(F.col("lang")).alias("lang")).filter(F.col("lang").isNotNull() & ~F.col("lang").isin(*FUNCTION_WORDS))
    words = rows.select("lang", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{M}\p{N}]+)"), F.lit(1))).alias("ws")).filter("size(ws) >= 12")
    docs = words.groupBy("lang").agg(F.count("*").alias("docs")).filter(F.col("docs") >= LEARN_DOCS)
    held = words.select("lang", F.explode("ws").alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n")).join(F.broadcast(docs), "lang")  # a row a label
    best = held.filter(F.col("n") >= LEARN_SHARE * F.col("docs")).withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word")))
    out: dict[str, list[str]] = {}
    for r in best.filter(F.col("k") <= LEARN_WORDS).collect():
        out.setdefault(r["lang"], []).append(r["word"])
    return out


_NAMES = ["doc_id", "lang", "words", "functional", "linked", "top", "separators", "pairs", "repeated"]
_KINDS = (pa.int64(), pa.string(), *[pa.int32()] * 6, pa.bool_())


def _measured(documents: DataFrame) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(learnt_words(documents))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Languages(shared.value)
        for batch in batches:
            rows = [(d, *w) for d, t, g in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "lang")), strict=True) for w in windows(t or "", g, known)]
            cols = list(zip(*rows, strict=True)) or [[]] * len(_KINDS)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, _KINDS, strict=True)], _NAMES)

    return spread(documents.select("doc_id", "text", label(F.col("lang")).alias("lang"))).mapInArrow(run, _FEATURES)


def _shares(documents: DataFrame) -> DataFrame:
    """``spam_shares`` with ``linked_words``, those in links."""
    seen = materialize(_measured(documents), "stuffing")
    own = F.greatest(F.col("words") - F.col("linked"), F.lit(1))
    functional, top, separated, paired = F.col("functional") / own, F.col("top") / own, F.col("separators") / F.col("words"), F.col("pairs") / own
    at = lambda c, q: F.percentile_approx(c, q, 1000)
    usual = seen.filter("lang <> '' and linked = 0 and words >= 6").groupBy("lang").agg(at(functional, 0.5).alias("usual"))
    usual = F.broadcast(usual.withColumn("usual", F.greatest("usual", F.lit(0.2))))  # a row per language with function words
    # Windows with sentences, which only known function words tell; else the limits are those that hold everywhere.
    spoken = seen.join(usual, "lang").filter("words >= 6 and linked = 0").filter(functional >= F.col("usual"))
    limits = spoken.groupBy("lang").agg(at(top, USUAL).alias("tops"), at(separated, USUAL).alias("seps"), at(paired, USUAL).alias("prs"))
    rows = seen.join(usual, "lang", "left").join(F.broadcast(limits), "lang", "left")
    over = lambda share, floor, limit: share > F.greatest(F.lit(floor), F.coalesce(limit, F.lit(floor)))
    many, cut, twice = over(top, TOP_WORD, "tops"), over(separated, SEPARATED, "seps"), over(paired, PAIRED, "prs")
    share = functional / F.coalesce("usual", F.lit(0.3))
    told = F.col("lang") != ""
    lacking = told & (((share < MISSING) & (many | cut | twice | F.col("repeated"))) | ((share < ABSENT) & (F.col("words") >= 12)))
    untold = ~told & (F.col("words") >= 6) & ((twice & (many | cut)) | (cut & many) | (F.col("repeated") & (many | cut | twice)))
    spam = (F.col("linked") / F.col("words") > LINKED) | ((top > REPEATED) & (F.col("words") >= 6)) | lacking | untold
    return rows.groupBy("doc_id").agg(F.sum("words").alias("words"), F.sum(F.when(spam, F.col("words")).otherwise(0)).alias("spam_words"), F.sum("linked").alias("linked_words"))


def spam_shares(documents: DataFrame) -> DataFrame:
    """``doc_id, words, spam_words`` of each document that has words.

    Null, empty and wordless texts don't come out; a repeated doc_id sums over its rows; texts are read whole.
    A text's language is the one whose function words make up most of it, if they are TOLD of its words, else that of
    its label, else it isn't told. A window short of them may be in another. What is usual in a language is worked out
    over all windows of all documents.
    """
    return _shares(documents).drop("linked_words")


def stuffed(documents: DataFrame, *, least_words: int = LEAST_WORDS) -> DataFrame:
    """``doc_id`` of the documents most of whose words stand in keywords, links or tags; of fewer than ``least_words``, in links."""
    long = (F.col("words") >= least_words) & (F.col("spam_words") > MOSTLY * F.col("words"))
    return _shares(documents).filter(long | (F.col("words") < least_words) & (F.col("linked_words") > LINKED * F.col("words"))).select("doc_id")
