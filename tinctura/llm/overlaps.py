"""Problem 2: the same or nearly the same records in the evaluation and the training split.

The distinct input pairs of the evaluation rows are dealt to shards by their length, and each shard becomes a compressed
full-text index. Training rows go to the shards of their own length, give or take two slips, and stream through
backward search there: a pair within one slip in each input shares, in full, one half of either input (or, of a short
one, the input itself less a letter), and the two stand side by side in an index text, so one search per combination
finds every such pair. The matches are extended from both ends of each field to maximal ones; where they leave no more
than one slip uncovered, the records' spans are merged, and rows of both tables, their outputs and counts follow.
All shards are searched in one job, and neither indexes nor matches pass through the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tinctura.llm.copies import letters_digits
from tinctura.llm.fmindex import FMIndex
from tinctura.operators.skew import HOT_PARTS
from tinctura.storage import materialize, spread

#: Letters of index text in a shard at most, and at least where there could be a shard for each core (a longer single
#: record makes a longer shard). An index takes about 12 bytes each, up to 50 where the text has many scripts. A row
#: meets the shards of five lengths, so wide shards are searched less often.
SHARD_CHARS, LEAST_CHARS = 4_000_000, 500_000
#: Training rows a task searches a shard for; it builds the shard's index itself, which takes a small part of that time.
TASK_ROWS = 250_000
#: Training rows searched at a time, and matches located at a time.
SEARCH_ROWS, LOCATE_ROWS = 16384, 1 << 18
#: Inputs of up to this many letters are found by what is left of them without one letter, longer ones by their halves.
SHORT = 4
#: Total lengths are classes of their own up to here, then eight to each doubling.
EXACT_LENGTHS = 256


def one_slip(x: Column, y: Column) -> Column:
    """Equal, or one letter added, dropped, replaced, or two neighbours swapped."""
    swapped = lambda i: y == F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.lit(1)), F.substring(x, i, F.lit(1)), F.substring(x, i + 2, F.length(x)))
    swap = F.when((F.length(x) == F.length(y)) & (F.length(x) > 1), F.exists(F.sequence(F.lit(1), F.greatest(F.length(x) - 1, F.lit(1))), swapped)).otherwise(False)
    return (x == y) | (F.levenshtein(x, y, 1) >= 0) | swap


def matched(x: str, y: str) -> int:
    """Letters of ``y`` in the maximal matches from both ends of ``x`` and ``y``, merged; -1 if more than a slip is left.

    Two neighbours swapped are letters that match too.
    """
    n, m = len(x), len(y)
    if x == y:
        return m
    if abs(n - m) > 1:
        return -1
    i = 0
    while i < n and i < m and x[i] == y[i]:
        i += 1
    if x[i + 1 :] == y[i + 1 :] or x[i:] == y[i + 1 :]:
        return m - 1
    if x[i + 1 :] == y[i:] or (n == m and x[i : i + 2] == y[i : i + 2][::-1] and x[i + 2 :] == y[i + 2 :]):
        return m
    return -1


def shortened(s: str) -> list[str]:
    """``s`` and what is left of it without one letter; two texts within a slip have one of these in common."""
    return list(dict.fromkeys([s, *(s[:i] + s[i + 1 :] for i in range(len(s)))]))


def index_texts(x: str, y: str) -> list[str]:
    """Texts in which any two parts of the inputs that ``probes`` asks for stand side by side.

    Both inputs in either order and direction; and for inputs that a short one may agree with, all that is left of
    them without a letter, between marks.
    """
    out = ["\x02".join((x[::-1], y, x, y[::-1], x[::-1]))]
    near = [shortened(s) if len(s) <= SHORT + 1 else [s] for s in (x, y)]
    if len(x) <= SHORT + 1 or len(y) <= SHORT + 1:
        out += [f"\x02{v}\x02{w}\x02{v}\x02" for v in near[0] for w in near[1]]
    return out


def probes(a: str, b: str) -> list[str]:
    """Patterns of which one at least occurs in an ``index_texts`` of every pair within a slip of (a, b), in either order.

    Each holds a half of either input, or all of a short one but at most a letter, so none is a mark alone.
    """

    def parts(s: str) -> tuple[str, str]:
        h = (len(s) - 1) // 2
        return s[:h], s[h + 1 :]

    if len(a) <= SHORT and len(b) <= SHORT:
        return [f"\x02{v}\x02{w}\x02" for v in shortened(a) for w in shortened(b)]
    if len(a) <= SHORT or len(b) <= SHORT:
        short, long = (a, b) if len(a) <= SHORT else (b, a)
        first, last = parts(long)
        return [p for v in shortened(short) for p in (f"\x02{v}\x02{first}", f"{last}\x02{v}\x02")]
    out = []
    for (p1, s1), (p2, s2) in ((parts(a), parts(b)), (parts(b), parts(a))):
        out += [f"{p2[::-1]}\x02{s1[::-1]}", f"{s2}\x02{p1}", f"{s1}\x02{s2[::-1]}", f"{p1[::-1]}\x02{p2}"]
    return out


def sides(df: DataFrame, row_id: str) -> DataFrame:
    """``row_id, a, b, outs``: canonical inputs and distinct non-blank known outputs; rows with a blank input left out."""
    outs = F.array_distinct(F.filter(F.transform(F.coalesce("known_outputs", F.array().cast("array<string>")), letters_digits), lambda o: o != ""))
    return df.select(row_id, letters_digits("input_a").alias("a"), letters_digits("input_b").alias("b"), outs.alias("outs")).filter("a <> '' and b <> '' and size(outs) > 0")


class Shard:
    """An index over pairs of inputs."""

    def __init__(self, pairs: list[tuple[str, str]]):
        texts = [index_texts(*p) for p in pairs]
        self.pairs, self.of = pairs, np.repeat(np.arange(len(pairs)), [len(t) for t in texts])
        self.index = FMIndex([t for ts in texts for t in ts])

    def search(self, a: list[str], b: list[str]) -> list[tuple[int, int, int]]:
        """``(position in a and b, position in the pairs, letters matched)`` of all that agree, inputs in either order."""
        each = [probes(x, y) for x, y in zip(a, b, strict=True)]
        owner = np.repeat(np.arange(len(a)), [len(p) for p in each])
        low, high = self.index.search([p for ps in each for p in ps])
        hits = np.flatnonzero(high > low)
        upto = np.concatenate(([0], np.cumsum((high - low)[hits])))
        out: dict[tuple[int, int], int] = {}
        at = 0
        while at < len(hits):  # in portions, so that memory stays bounded however common a match is
            end = max(at + 1, int(np.searchsorted(upto, upto[at] + LOCATE_ROWS, side="right")) - 1)
            mine = hits[at:end]
            sizes = (high - low)[mine]
            rows = np.repeat(low[mine] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
            both = np.unique(np.repeat(owner[mine], sizes) * np.int64(len(self.pairs)) + self.of[self.index.locate(rows)])
            for i, j in zip((both // len(self.pairs)).tolist(), (both % len(self.pairs)).tolist(), strict=True):
                if (i, j) not in out and (n := self._agree(a[i], b[i], *self.pairs[j])) >= 0:
                    out[i, j] = n
            at = end
        return [(i, j, n) for (i, j), n in out.items()]

    @staticmethod
    def _agree(u: str, v: str, x: str, y: str) -> int:
        best = -1
        for p, q in ((x, y), (y, x)):
            if (m := matched(u, p)) >= 0 and (n := matched(v, q)) >= 0:
                best = max(best, m + n)
        return best


def length_class(n: Column) -> Column:
    """A class for a total length; classes rise with it."""
    return F.when(n < EXACT_LENGTHS, n).otherwise(EXACT_LENGTHS + F.floor(8 * F.log2(F.greatest(n, F.lit(1)) / EXACT_LENGTHS))).cast("int")


def routes(letters: dict[int, int], shard_chars: int) -> dict[int, tuple[int, int]]:
    """``{class: (first shard, shards)}``: short classes share a shard, one with too many letters has several."""
    out, shard, room = {}, -1, 0
    for c, n in sorted(letters.items()):
        parts = max(1, -(-n // shard_chars))
        if parts > 1 or n > room:
            shard, room = shard + 1, shard_chars
        out[c] = (shard, parts)
        shard, room = shard + parts - 1, 0 if parts > 1 else room - n
    return out


_FOUND = "row_id long, outs string, ea string, eb string, matched int"


def _search(train: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
    rows = []
    if len(train) and len(pairs):
        shard = Shard(list(zip(pairs["a"], pairs["b"], strict=True)))
        for k in range(0, len(train), SEARCH_ROWS):
            part = train.iloc[k : k + SEARCH_ROWS]
            ids, outs = part["row_id"].tolist(), part["outs"].tolist()
            rows += [(ids[i], outs[i], *shard.pairs[j], n) for i, j, n in shard.search(part["a"].tolist(), part["b"].tolist())]
    return pd.DataFrame(rows, columns=["row_id", "outs", "ea", "eb", "matched"]).astype({"row_id": "int64", "matched": "int32"})


def agreeing_inputs(train: DataFrame, pairs: DataFrame, *, shard_chars: int = SHARD_CHARS, task_rows: int = TASK_ROWS) -> DataFrame:
    """``row_id, outs, ea, eb, matched``: training rows (outs joined) with each evaluation pair that their inputs agree with."""
    cores = train.sparkSession.sparkContext.defaultParallelism
    total = F.length("a") + F.length("b")
    pairs = pairs.withColumn("class", length_class(total))
    longer = lambda c: F.when(F.length(c) <= SHORT + 1, F.length(c) + 1).otherwise(1)
    texts = F.when((F.length("a") > SHORT + 1) & (F.length("b") > SHORT + 1), 0).otherwise(longer("a") * longer("b") * (total + 4))
    letters = {r["class"]: r["n"] for r in pairs.groupBy("class").agg(F.sum(3 * total + 5 + texts).alias("n")).collect()}  # a row per class
    route = routes(letters, max(1, min(shard_chars, max(LEAST_CHARS, -(-sum(letters.values()) // cores)))))
    if not route:
        return train.sparkSession.createDataFrame([], _FOUND)
    top = max(route) + 1
    # The shards of classes c and above begin at from_[c]; those of classes up to c end before to[c].
    from_ = [min((s for k, (s, _) in route.items() if k >= c), default=1 << 30) for c in range(top + 1)]
    to = [max((s + n for k, (s, n) in route.items() if k <= c), default=0) for c in range(top + 1)]
    at = lambda table, c: F.element_at(F.lit(table), F.least(F.greatest(c, F.lit(0)), F.lit(top)) + 1)
    start, end = at(from_, length_class(total - 2)), at(to, length_class(total + 2))
    rows = train.select("row_id", "a", "b", F.array_join("outs", "\x1f").alias("outs"), start.alias("s"), end.alias("e")).filter("s < e")
    rows = materialize(rows.withColumn("shard", F.explode(F.sequence("s", F.col("e") - 1))).drop("s", "e"), "overlap-train")
    parts = {r["shard"]: max(1, -(-r["n"] // task_rows)) for r in rows.groupBy("shard").agg(F.count("*").alias("n")).collect()}  # a row per shard
    tasks = rows.sparkSession.createDataFrame([(s, n) for s, n in parts.items()] or [(-1, 1)], "shard int, parts int")
    first, n = zip(*[route.get(c, (-1, 1)) for c in range(top)], strict=True)
    mine = at(list(first), F.col("class")) + F.pmod(F.xxhash64("a", "b"), at(list(n), F.col("class")).cast("long")).cast("int")
    left = rows.join(F.broadcast(tasks), "shard").withColumn("part", F.pmod(F.xxhash64("row_id"), F.col("parts").cast("long")).cast("int")).drop("parts")
    right = pairs.select("a", "b", mine.alias("shard")).join(F.broadcast(tasks), "shard").select("a", "b", "shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    # A fixed number of partitions, which adaptive execution doesn't join to a few by their size: work follows from rows.
    wide = 4 * max(cores, sum(parts.values()))
    left, right = (df.repartition(wide, "shard", "part") for df in (left, right))
    return left.groupBy("shard", "part").cogroup(right.groupBy("shard", "part")).applyInPandas(_search, _FOUND)


def overlap_spans(evals: DataFrame, canonical: DataFrame, *, shard_chars: int = SHARD_CHARS, task_rows: int = TASK_ROWS) -> DataFrame:
    """``eval_id, row_id, matched, letters`` for each evaluation row and training row that are the same or nearly the same.

    Both inputs must agree in either order, and one known output of each; agree: equal or one slip apart in letters
    and digits, case ignored. matched: letters of the evaluation row's inputs that stand in the maximal matches with
    the training row's, merged; letters: all of them. Null or blank inputs and outputs never agree; repeated rows all
    come out; a table without rows gives none; fields of any length are compared whole; further columns don't matter.
    """
    ev = materialize(sides(evals, "eval_id"), "overlap-evals")
    pairs = materialize(ev.groupBy("a", "b").agg(F.count("*").alias("n")), "overlap-pairs")
    train = spread(sides(canonical.filter("split = 'train'"), "row_id"))
    found = materialize(agreeing_inputs(train, pairs, shard_chars=shard_chars, task_rows=task_rows), "overlap-found")
    both = both_salted(found, ev.select("eval_id", F.col("a").alias("ea"), F.col("b").alias("eb"), F.col("outs").alias("eouts")), ["ea", "eb"], "row_id", "eval_id")
    outs = F.split("outs", "\x1f")
    near = F.exists(outs, lambda o: F.exists("eouts", lambda p: one_slip(o, p)))
    return both.filter(F.arrays_overlap(outs, "eouts") | near).select("eval_id", "row_id", "matched", (F.length("ea") + F.length("eb")).alias("letters"))


def both_salted(left: DataFrame, right: DataFrame, on: list[str], left_id: str, right_id: str) -> DataFrame:
    """Inner join of two written tables, keys that are frequent on either side split on both.

    Fewer than HOT_PARTS keys hold more than one in HOT_PARTS of a table's rows, so those are broadcast. A split key's
    rows meet in a grid: each row goes to the cells of its own number on one side and of all numbers on the other.
    """

    def hot(df: DataFrame, name: str) -> DataFrame:
        counts, share = df.groupBy(*on).agg(F.count("*").alias("n")), max(1, df.count() // HOT_PARTS)
        return counts.filter(F.col("n") > share).select(*on, F.least(F.ceil(F.col("n") / share), F.lit(HOT_PARTS)).cast("int").alias(name))

    split = hot(left, "_l").join(hot(right, "_r"), on, "full")
    if not split.take(1):
        return left.join(right, on)
    split = materialize(split, "split-keys")

    def dealt(df: DataFrame, row_id: str, own: str, other: str, names: tuple[str, str]) -> DataFrame:
        df = df.join(F.broadcast(split), on, "left")
        cell = F.pmod(F.xxhash64(row_id), F.coalesce(own, F.lit(1)).cast("long")).cast("int")
        return df.select("*", cell.alias(names[0]), F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1)).alias(names[1])).drop("_l", "_r")

    a, b = dealt(left, left_id, "_l", "_r", ("_i", "_j")), dealt(right, right_id, "_r", "_l", ("_j", "_i"))
    return a.join(b, [*on, "_i", "_j"]).drop("_i", "_j")


def split_overlaps(evals: DataFrame, canonical: DataFrame, **how: int) -> DataFrame:
    """``eval_id, row_id`` of ``overlap_spans``."""
    return overlap_spans(evals, canonical, **how).select("eval_id", "row_id")


def overlap_report(evals: DataFrame, canonical: DataFrame) -> DataFrame:
    """Per evaluation split and source: rows, rows with an overlap, and overlapping pairs."""
    pairs = split_overlaps(evals, canonical).groupBy("eval_id").agg(F.count("*").alias("pairs"))
    return (
        evals.select("eval_id", "split", "source").join(pairs, "eval_id", "left")
        .groupBy("split", "source")
        .agg(F.count("*").alias("eval_rows"), F.count("pairs").alias("overlapping_rows"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"))
    )
