"""Problem 6: predictions that are no proper answers, with the type of defect.

An answer's words are aligned with those of its prompt (whole shingles of the inputs, then the longest common
subsequence) to find copies, and with templates of word classes to find refusals; broken JSON, open brackets and sentences
without an end are truncated; answers whose letters don't follow English letter statistics are in another language.
"""

from __future__ import annotations

import json
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tinctura.llm.stuffing import FUNCTION_WORDS
from tinctura.operators.skew import BROADCAST_BYTES, lookup
from tinctura.storage import materialize, measured, spread

# Words for no value; classes of words that refusals are made of (apostrophes dropped), and their orders
# in refusals, with as many other words between two as said; words that only dress up a prompt; JSON keys.
NO_VALUE = ("null", "none", "nil", "na", "n a", "nan", "undefined", "no answer", "no value", "no result", "empty", "not available", "not applicable", "no output")
CLASSES = {
    "self": "i im id ill ive",
    "mine": "my our",
    "sorry": "sorry apologize apologise apologies regret afraid",
    "not": "cannot cant couldnt wont wouldnt shouldnt dont not unable decline declining refuse refusing refrain nothing",
    "never": "cannot cant wont decline refuse abstain",
    "unable": "unable cannot cant declining refusing not",
    "answer": "answer respond reply comply help assist fulfill fulfil complete provide combine merge mix do say give name invent produce generate comment discuss share continue process engage propose suggest offer support proceed create",
    "free": "comfortable able allowed permitted authorized willing going appropriate supposed",
    "request": "request question prompt query task topic this that",
    "denied": "declined denied refused rejected disallowed inappropriate prohibited forbidden",
    "outside": "outside beyond against",
    "rules": "guidelines instructions policy policies rules programming principles scope capabilities abilities limits",
    "forbid": "forbid forbids prevent prevents prohibit prohibits disallow not dont cannot",
    "improper": "inappropriate improper unethical unsuitable wrong", "me": "me us",
    "as": "as", "model": "model ai assistant", "no": "no", "something": "something anything", "please": "please", "ask": "ask try", "else": "else different another",
}
ORDERS = (
    ("self not answer", 3), ("self not free", 2), ("sorry not answer", 4), ("^ unable answer", 1), ("self never $", 1), ("^ self sorry", 1), ("^ never sorry", 2), ("request denied", 2), ("request outside self", 3), ("request outside rules", 3),
    ("outside mine rules", 1), ("as model", 3), ("mine rules forbid", 1), ("no answer self", 1), ("not something self", 1), ("please ask else", 2), ("not free answer", 2), ("not free self", 2), ("not answer request sorry", 2), ("improper me answer", 2), ("self not $", 1),
)
#: A refusal as a whole that is also a name: it counts with a full stop, or with more said.
SHORT_REFUSALS = ("no comment", "i refuse", "i decline", "request denied", "request declined", "request refused", "im sorry", "i am sorry", "sorry")
DRESSING = "what do you get when i we combine combining combined mix mixing mixed and with plus to the answer is equals concept concepts input inputs a b result output pair question prompt gives give makes make into together of these two both recipe combination so if"
RESULT_KEYS = ("result", "output", "answer", "prediction", "concept", "text", "response")
# Words that stand in sentences, not in names of things.
SENTENCE = "the is are was were be been would could will can cannot has have had does do did when who which that what if because while where than then most very more it they we you i my your their this these those there and but or so until only anyone no not as a an"
# Words after which a text goes on.
DANGLING = "is the and with a to when of if or so these combining mixing that from for by into on until only once usually simply still between in at as than would could should will has have which because while their its"
# Words that begin a sentence and no name.
OPENING = "when if because while once anyone everyone it mixing combining they you we there"
# Letters of English words and of words borrowed into English.
ENGLISH_LETTERS = "abcdefghijklmnopqrstuvwxyzàâäåæçèéêëíîïñóôöœúûü"
# End of fixed values.

_WORD = re.compile(r"[^\W_]+")
_LABEL, _STOP, _FENCE = re.compile(r"^\s*\w+\s*:\s*"), re.compile(r"[.!?…][\"')\]]*\s+"), re.compile(r"^```\w*\s*|\s*```$")
_CUT = re.compile(r"\w[-–—,;:(]$")
_SAID = re.compile(r"([^\W_]+)([^\w]*[.!?\n;:])?")
_CLASS_OF: dict[str, frozenset[str]] = {}
for _name, _some in CLASSES.items():
    for _w in _some.split():
        _CLASS_OF[_w] = _CLASS_OF.get(_w, frozenset()) | {_name}
_ORDERS = tuple((tuple(o.split()), gap) for o, gap in ORDERS)
#: Every order has a word of one of these.
_TELLING = frozenset(w for c in ("not", "never", "unable", "sorry", "denied", "outside", "model", "forbid", "no", "ask", "improper") for w in CLASSES[c].split())
_DRESSING, _SENTENCE = frozenset(DRESSING.split()), frozenset(SENTENCE.split())
_DANGLING, _OPENING = frozenset(DANGLING.split()), frozenset(OPENING.split())
_FOREIGN = {k: frozenset(v.split()) - frozenset(FUNCTION_WORDS["en"].split()) - {"on", "son", "sin", "come", "pour", "con", "sans", "plus", "est", "no", "a", "dat", "war", "also", "bis", "die", "per", "den"} for k, v in FUNCTION_WORDS.items() if k != "en"}
#: Words of the letter model whatever the prompts, and their weight.
_BASE, _BASE_WEIGHT = _SENTENCE | _DRESSING | frozenset(FUNCTION_WORDS["en"].split()), 3.0
#: Prompts of more words count in proportion, each word by its count among so many: scores don't depend on the size of a table.
FIT_WORDS = 20_000
#: Added to the counts of a trigram and of its first two letters.
_SMOOTH, _SMOOTH_ALL = 0.05, 2.0
#: Weights are added up in billionths, as integers: their sums don't depend on the order of rows.
_UNIT = 1_000_000_000
#: Part of an answer's content and of an input's that their longest common subsequence covers in a copy.
ALIGNED = 0.8


def _plain_words(text: str) -> list[str]:
    """The words of a text without numbers, as often as they stand in it."""
    return [w for w in _WORD.findall(text.lower()) if not w.isdigit()]


class English:
    """Letter trigrams of English words. ``strange`` says whether words don't look English.

    The trigrams are fitted on ``texts``, whose words look English; further ``known`` words only tell whole words from
    broken ones. ``counted`` takes trigrams that are already counted.
    """

    def __init__(self, texts: Iterable[str] = (), known: Iterable[str] = ()):
        words = Counter(w for t in texts for w in _plain_words(t))
        share = min(1.0, FIT_WORDS / max(1, words.total()))
        fit = {w: 1 + math.log(n * share) if n * share > 1 else n * share for w, n in words.items()} | dict.fromkeys(_BASE, _BASE_WEIGHT)
        tri: Counter[str] = Counter()
        for w, n in fit.items():
            x = f"^{w}$"
            for i in range(len(x) - 1):
                tri[x[max(0, i - 1) : i + 2]] += round(n * _UNIT)
        self._set(fit, tri)
        self.known = self.fitted | frozenset(w for w in known if not w.isdigit())

    @classmethod
    def counted(cls, words: Iterable[str], trigrams: dict[str, int]) -> English:
        """Of all words fitted and their trigrams with their weights in billionths."""
        new = cls.__new__(cls)
        new._set(words, trigrams)
        return new

    def _set(self, words: Iterable[str], trigrams: dict[str, int]) -> None:
        self.fitted = self.known = frozenset(words)
        bi: Counter[str] = Counter()
        for x, n in trigrams.items():
            bi[x[:-1]] += n
        self.tri = Counter({x: n / _UNIT for x, n in trigrams.items()})
        self.bi = Counter({x: n / _UNIT for x, n in bi.items()})
        self.scores: dict[str, float] = {}

    def scored(self, scores: dict[str, float]) -> None:
        """Only these words count from now on: those of score 0 as fitted, the others by their scores."""
        self.fitted = self.known = _BASE.union(w for w, s in scores.items() if s == 0)
        self.scores = scores

    def score(self, word: str) -> float:
        """Mean logarithm of the probability of a letter after the two before it; 0 for a fitted word."""
        if word in self.fitted or word.isdigit():
            return 0.0
        if word not in self.scores:
            x = f"^{word}$"
            s = [math.log((self.tri[x[max(0, i - 1) : i + 2]] + _SMOOTH) / (self.bi[x[max(0, i - 1) : i + 1]] + _SMOOTH_ALL)) for i in range(len(x) - 1)]
            if len(self.scores) > 100_000:
                self.scores.clear()
            self.scores[word] = sum(s) / len(s)
        return self.scores[word]

    def strange(self, words: list[str], text: str) -> bool:
        if not text.isascii():
            letters = [c for c in text if c.isalpha()]
            if not letters:
                return False
            if sum("LATIN" not in unicodedata.name(c, "") for c in letters if ord(c) > 127) > 0.3 * len(letters):
                return True
        new = [w for w in words if self.score(w) < 0]
        share = len(new) / len(words)
        if share < 0.34:
            return False
        odd = any(c not in ENGLISH_LETTERS for w in new for c in w if c.isalpha())
        hits = max(sum(w in f for w in words) for f in _FOREIGN.values())
        own = sum(w in _SENTENCE and len(w) > 2 and not any(w in f for f in _FOREIGN.values()) for w in words)
        if hits > own and (hits >= 2 or share >= 0.5):
            return True
        low = sum(self.score(w) for w in new) / len(new)
        return (odd and share >= 0.5) or (share >= 0.6 and own == 0 and low < -3.4) or (share > 0.8 and len(new) > 1 and own == 0 and low < -3.0)


def _aligned(classes: list[frozenset[str]], order: tuple[str, ...], gap: int) -> bool:
    """Whether words of the classes stand in ``order``, with up to ``gap`` others between two of them.

    A local alignment of the template with the words, in which a word too many costs and a template's class can't be
    left out: ``ends`` holds the words that an alignment of the template's begin can end at. ``^`` is the begin of a
    sentence, ``$`` the end of the text.
    """
    steps = [c for c in order if c not in "^$"]
    ends = [i for i, c in enumerate(classes) if steps[0] in c and (order[0] != "^" or i == 0 or "." in classes[i - 1])]
    for step in steps[1:]:
        ends = [i for i, c in enumerate(classes) if step in c and any(0 < i - j <= gap + 1 for j in ends)]
        if not ends:
            return False
    return bool(ends) and (order[-1] != "$" or len(classes) - 1 - ends[-1] <= gap)


def _refuses(text: str) -> bool:
    """Whether the answer aligns with a refusal: word classes in the order of a template."""
    flat = text.lower().replace("'", "").replace("’", "").replace("`", "")
    words = _WORD.findall(flat)
    if _TELLING.isdisjoint(words):
        return False
    classes = [_CLASS_OF.get(m[1], frozenset()) | ({"."} if m[2] else frozenset()) for m in _SAID.finditer(flat)]
    whole = " ".join(words)
    if whole in SHORT_REFUSALS:
        return text.rstrip("\"')] \n")[-1:] in ".!" and text.strip()[:1] not in '"{['
    if whole.startswith("no comment "):
        return "." in classes[1]
    have = frozenset().union(*classes)
    return any(all(c in have for c in order if c not in "^$") and _aligned(classes, order, gap) for order, gap in _ORDERS)


def _common(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def _copied(words: list[str], inputs: list[list[str]]) -> bool:
    """Whether ``words`` are only one input or both, and words that dress up a prompt.

    Whole inputs are found as shingles, however often they come. Where their words stand apart, the answer's content
    is aligned with that of an input, or of both in either order, by their longest common subsequence, which must
    cover ALIGNED of either.
    """
    free, whole = list(words), 0
    for part in sorted(filter(None, inputs), key=len, reverse=True):
        i = 0
        while i <= len(free) - len(part):  # whole shingles of the input
            if free[i : i + len(part)] == part:
                free[i : i + len(part)] = [""]
                whole += 1
            else:
                i += 1
    if whole and all(w in _DRESSING for w in free if w):
        return True
    joined = "".join(words)
    names = ["".join(p) for p in inputs if p]
    if joined in names or (len(names) == 2 and joined in (names[0] + names[1], names[1] + names[0])):
        return True
    content = [w for w in words if w not in _DRESSING]
    asked = [[w for w in p if w not in _DRESSING] for p in inputs]
    if not content or not frozenset(content) <= frozenset(w for p in asked for w in p):
        return False
    for target in (*asked, asked[0] + asked[1], asked[1] + asked[0]):
        longest = max(len(target), len(content))
        if min(len(target), len(content)) >= ALIGNED * longest and _common(content, target) >= ALIGNED * longest:
            return True
    return False


def _ends_open(text: str) -> bool:
    """Whether a bracket or a double quotation mark is left open."""
    pairs, open_ = {")": "(", "]": "[", "}": "{"}, []
    for c in text:
        if c in "([{":
            open_.append(c)
        elif c in pairs and open_ and open_[-1] == pairs[c]:
            open_.pop()
    return bool(open_) or text.count('"') % 2 == 1 or text.count("“") > text.count("”")


def _breaks_off(words: list[str], inputs: list[list[str]], body: str, english: English) -> bool:
    """Whether an input's words break off inside one, an input goes on into no word, or dots end what isn't a name."""
    for part in filter(None, inputs):
        n = len(words)
        if 1 < n <= len(part) and words[:-1] == part[: n - 1] and words[-1] != part[n - 1] and part[n - 1].startswith(words[-1]):
            return True
        rest = words[len(part) :]
        if words[: len(part)] == part and rest and not any(w in english.known for w in rest):
            return True
    return body.endswith(("...", "…")) and any(w in _SENTENCE or w in _DANGLING or w in _OPENING or w not in english.known for w in words)


def _as_json(text: str) -> str:
    """The text of a Python literal as JSON: texts in double quotes, ``true, false, null``, tuples as lists."""

    def quoted(m: re.Match) -> str:
        if m[1] is not None:
            return json.dumps(re.sub(r"\\(.)", lambda e: {"n": "\n", "t": "\t", "r": "\r"}.get(e[1], e[1]), m[1][1:-1], flags=re.S))
        return {"True": "true", "False": "false", "None": "null", "(": "[", ")": "]"}.get(m[0], m[0])

    return re.sub(r"""('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|\b(?:True|False|None)\b|[()]""", quoted, text, flags=re.S)


def _unwrapped(text: str) -> tuple[str | None, bool]:
    """The answer inside JSON, a Python literal or a code fence, however deep and long (None if there is none), and
    whether the JSON breaks off."""
    text = _FENCE.sub("", text).strip() if "```" in text else text.strip()
    if not text[:1] or text[0] not in '{["':
        return text, False
    value: object = text
    try:
        try:
            value = json.loads(text)
        except ValueError:
            if text[0] in "{[":
                value = json.loads(re.sub(r",\s*([\]}])", r"\1", _as_json(text)))
    except ValueError:
        if text[0] == "{" or (text[0] == "[" and text[1:2] in ('"', "'", "{")):
            return text, _ends_open(text)
    except RecursionError:
        return text, False
    while isinstance(value, (dict, list)):
        if isinstance(value, dict):
            value = next((value[k] for k in RESULT_KEYS if k in value), next((v for k, v in value.items() if k != "emoji"), None))
        else:
            value = value[0] if value else None
    return (None if value is None else str(value).strip()), False


def _shown(answer: str) -> tuple[str | None, bool]:
    """The answer without what can't be seen, unwrapped."""
    return _unwrapped(answer.strip() if answer.isascii() and answer.isprintable() else "".join(c for c in unicodedata.normalize("NFKC", answer) if unicodedata.category(c) not in ("Cf", "Cc") or c in "\n\t").strip())


def defect(answer: str | None, a: str | None, b: str | None, english: English) -> str | None:
    """``empty``, ``refusal``, ``copy``, ``other_language``, ``truncated`` or None, the first that holds.

    A JSON text that breaks off is truncated whatever it holds.
    """
    if answer is None:
        return "empty"
    text, broken = _shown(answer)
    if broken:
        return "truncated"
    text = text or ""
    words = _WORD.findall(text.lower())
    if not words or " ".join(words) in NO_VALUE:
        return "empty"
    if _refuses(text):
        return "refusal"
    inputs = [_WORD.findall((x or "").lower()) for x in (a, b)]
    if _copied(words, inputs):
        return "truncated" if words[-1] in _DANGLING or _CUT.search(text) else "copy"
    if english.strange(words, text):
        return "other_language"
    # What follows a first sentence or an opening bracket must be finished, and so must a sentence without either.
    body = text.rstrip()
    if _breaks_off(words, inputs, body, english):
        return "truncated"
    if _ends_open(body):
        return "truncated"
    if body[-1] in ".!?…)]}\"'”’»。！？":
        return None
    ends = [m.end() for m in _STOP.finditer(body)]
    rest = body[ends[-1] :] if ends else body
    if ends and len(_WORD.findall(body[: ends[-1]])) > 0:
        return "truncated"
    rest = _LABEL.sub("", rest).lower()  # without a label such as "Answer:"
    for part in sorted(filter(None, (a, b)), key=len, reverse=True):
        rest = rest.replace(part.lower(), " ")
    left = _WORD.findall(rest)
    if len(words) > 1 and (words[-1] in _DANGLING or words[0] in _OPENING):
        return "truncated"
    sentence = sum(w in _SENTENCE for w in left)
    return "truncated" if body[-1] in ",;:-–—(" and len(words) > 1 or sentence >= 2 or (sentence and len(words) > 5) or len(words) > 12 else None


def _all_words(texts: pd.Series) -> pd.Series:
    return pd.Series([_plain_words(x) if isinstance(x, str) else [] for x in texts], dtype=object)


def _answer_words(answers: pd.Series) -> pd.Series:
    """The distinct words of each answer as it is judged."""
    return pd.Series([sorted(set(_plain_words(_shown(x)[0] or ""))) if isinstance(x, str) else [] for x in answers], dtype=object)


def _fitted_words(predictions: DataFrame) -> DataFrame:
    """``word, weight``: the words of the prompts of all rows and those that always count, in billionths."""
    spark = predictions.sparkSession
    texts = predictions.select(F.explode(F.array("input_a", "input_b")).alias("text")).filter("text is not null").groupBy("text").agg(F.count("*").alias("n"))
    words = texts.select(F.explode(F.pandas_udf(_all_words, "array<string>")("text")).alias("word"), "n").groupBy("word").agg(F.sum("n").alias("n"))
    words = materialize(words, "words")
    share = min(1.0, FIT_WORDS / max(1, words.agg(F.sum("n")).first()[0] or 0))
    n = F.col("n") * F.lit(share)
    weight = F.round(F.when(n > 1, 1 + F.ln(n)).otherwise(n) * _UNIT).cast("long")
    base = spark.createDataFrame([(w, round(_BASE_WEIGHT * _UNIT)) for w in sorted(_BASE)], "word string, weight long")
    return words.filter(~F.col("word").isin(*sorted(_BASE))).select("word", weight.alias("weight")).unionByName(base)


def _grams(words: DataFrame) -> DataFrame:
    """``words`` with their trigrams, a row each: begin and end are signs of their own, the first has one letter."""
    x = F.concat(F.lit("^"), "word", F.lit("$"))
    cut = lambda i: F.substring(x, F.greatest(F.lit(1), i), F.when(i == 0, 2).otherwise(3))
    return words.withColumn("gram", F.explode(F.transform(F.sequence(F.lit(0), F.length("word")), cut)))


def _trigrams(words: DataFrame) -> DataFrame:
    """``gram, n``: the trigrams of ``words`` and the sums of their weights."""
    return _grams(words).groupBy("gram").agg(F.sum("weight").alias("n"))


def _scores(held: DataFrame, words: DataFrame, grams: DataFrame, bound: int) -> DataFrame:
    """``word, score`` of the distinct words of ``held``, as ``English.score`` gives them, whatever the size of the model."""
    all_ = held.select("word").distinct()
    begin = F.expr("substring(gram, 1, length(gram) - 1)")
    begins = grams.groupBy(begin.alias("begin")).agg(F.sum("n").alias("all"))
    cut = _grams(all_.join(words, "word", "left_anti")).withColumn("begin", begin)
    cut = lookup(lookup(cut, grams, ["gram"], bound=bound), begins, ["begin"], bound=bound)
    part = lambda c: F.coalesce(c, F.lit(0)) / F.lit(float(_UNIT))
    new = cut.groupBy("word").agg(F.avg(F.ln((part("n") + _SMOOTH) / (part("all") + _SMOOTH_ALL))).alias("score"))
    return all_.join(words, "word", "left_semi").select("word", F.lit(0.0).alias("score")).unionByName(new)


def defects(predictions: DataFrame, *, fit_rows: int | None = None, bound: int = BROADCAST_BYTES) -> DataFrame:  # noqa: ARG001
    """``prediction_id, defect`` of the rows whose prediction is no proper answer.

    Null inputs count as empty; null predictions are ``empty``; texts of any length are read whole; repeated rows
    come out each; an empty table gives none; further columns don't matter. The English letter model is fitted on the
    prompts of all rows; ``fit_rows`` has no effect and is kept for those who pass it. Words and trigrams are broadcast
    if their measured size is below ``bound`` bytes, else each answer is joined with the scores of its words.
    """
    spark = predictions.sparkSession
    words, size = measured(_fitted_words(predictions), "fitted")
    grams, more = measured(_trigrams(words), "trigrams")
    small = size + more <= bound
    model = spark.sparkContext.broadcast(English.counted([r[0] for r in words.select("word").collect()], {r[0]: r[1] for r in grams.collect()}) if small else English())

    def judge(answer: pd.Series, a: pd.Series, b: pd.Series, words: pd.Series, scores: pd.Series) -> pd.Series:
        english = model.value
        some = lambda s: [x if isinstance(x, str) else None for x in s]
        out = []
        for x, y, z, w, s in zip(some(answer), some(a), some(b), words, scores, strict=True):
            if not small:
                english.scored({} if w is None else dict(zip(w, s, strict=True)))
            out.append(defect(x, y, z, english))
        return pd.Series(out, dtype=object)

    # As if it weren't deterministic, so that the filter on its result isn't pushed below the dealing out and judged twice.
    judged = F.pandas_udf(judge, "string").asNondeterministic()
    rows = spread(predictions.select("prediction_id", "prediction", "input_a", "input_b"))
    if small:
        rows = rows.withColumns({"words": F.lit(None).cast("array<string>"), "scores": F.lit(None).cast("array<double>")})
    else:
        rows = materialize(rows.withColumn("at", F.monotonically_increasing_id()), "answers")
        held = materialize(rows.select("at", F.explode(F.pandas_udf(_answer_words, "array<string>")("prediction")).alias("word")), "held")
        found = lookup(held, _scores(held, words, grams, bound), ["word"], bound=bound)
        own = found.groupBy("at").agg(F.collect_list(F.struct("word", "score")).alias("m")).select("at", F.col("m.word").alias("words"), F.col("m.score").alias("scores"))
        rows = rows.join(own, "at", "left")
    return rows.select("prediction_id", judged("prediction", "input_a", "input_b", "words", "scores").alias("defect")).filter("defect is not null")
