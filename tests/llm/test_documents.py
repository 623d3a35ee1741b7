"""Problems 7, 8 and 9: packing, leaked passages, stuffed pages."""

from __future__ import annotations

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tinctura.llm import leaks, packing, stuffing

WINDOWS = "window_name string, capacity_tokens int"


@pytest.mark.skipif(not Path(packing.RANKS).exists(), reason="no tokenizer")
def test_packing(spark):
    r = random.Random(7)
    texts = [None, "", "x"] + [" ".join(["word"] * r.choice([1, 5, 30, 90, 400])) for _ in range(300)] + ["same text"] * 3
    docs = spark.createDataFrame([(i % 290, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, piece string").repartition(3)
    win = spark.createDataFrame([("s", 64), ("l", 256), ("zero", 0), (None, 9)], WINDOWS)
    got = packing.packed(docs, win).cache()
    total = packing.token_counts(docs).agg(F.sum("n_tokens")).first()[0]
    for name, capacity in (("s", 64), ("l", 256)):
        mine = got.filter(F.col("window_name") == name)
        assert mine.agg(F.sum("n_tokens")).first()[0] == total
        assert mine.groupBy("container_id").agg(F.sum("n_tokens").alias("n")).filter("container_id is not null").agg(F.max("n")).first()[0] <= capacity
        assert mine.filter("container_id is null").count() == 2
        assert mine.filter(f"piece > 0 and start_token <> piece * {capacity}").count() == 0
        whole = mine.groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("c"))
        assert whole.filter(f"n <= {capacity} and c > 2").count() == 0
    assert got.select("window_name").distinct().count() == 2
    report = {x.window_name: x for x in packing.packing_report(got, win).collect()}
    assert report["l"].containers <= report["l"].least * 1.1 + 1
    assert packing.packed(docs.limit(0), win).count() == packing.packed(docs, win.limit(0)).count() == 0


def test_boundaries_are_optimal():
    import itertools

    r = random.Random(1)
    for _ in range(30):
        h = {s: r.randint(1, 9) for s in r.sample(range(1, 40), 8)}
        pad = lambda bs: sum(n * (min(b for b in bs if b >= s) - s) for s, n in h.items())  # noqa: B023, E731
        best = min(pad((*c, max(h))) for c in itertools.combinations(sorted(h)[:-1], 2))
        assert pad(packing.boundaries(h, 3)) == best


def test_batches_hold_everything():
    r = random.Random(2)
    for _ in range(50):
        counts = {s: r.randint(1, 50) for s in r.sample(range(1, 101), r.randint(1, 20))}
        plan = packing.batches(counts, 100)
        held = {}
        for times, each in plan:
            assert sum(s * k for s, k in each.items()) <= 100
            for s, k in each.items():
                held[s] = held.get(s, 0) + times * k
        assert held == counts


def test_little_is_unused():
    """Texts of many lengths leave a thousandth of the space unused at most, whatever the window."""
    r = random.Random(5)
    for capacity in (128, 1024):
        counts: dict[int, int] = {}
        for _ in range(20_000):
            n = max(1, int(r.lognormvariate(5, 0.9)))
            for size in [capacity] * (n // capacity) + [n % capacity] * (n % capacity > 0):
                counts[size] = counts.get(size, 0) + 1
        assert packing.boundaries(counts, packing.BUCKETS) == sorted(counts)
        used = sum(t for t, _ in packing.batches(counts, capacity)) * capacity
        assert sum(s * n for s, n in counts.items()) >= 0.998 * used


ITEM = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"


def brute(docs, items, run=12):
    words = lambda t: leaks.WORD.findall((t or "").lower())
    grams = lambda t: {tuple(w[i : i + run]) for w in [words(t)] for i in range(len(w) - run + 1)}
    return sorted((d, i) for d, t in docs for i, p in items if grams(t) & grams(p))


def test_leaks(spark, rows):
    r = random.Random(3)
    vocab = [f"w{i}" for i in range(6)]
    items = [(0, ITEM), (1, ITEM), (2, None), (3, "short"), (4, "")] + [(10 + i, " ".join(r.choice(vocab) for _ in range(30))) for i in range(20)]
    w = ITEM.split()
    docs = [(1, "x " + "--, ".join(w[1:13]).upper() + "!"), (2, " ".join(w[:11])), (3, None), (4, ""), (5, " ".join(w[:6] + ["gap"] + w[6:])), (6, ("pad " * 30000) + ITEM)]
    docs += [(100 + i, " ".join(r.choice(vocab) for _ in range(200))) for i in range(40)] + [(200, items[5][1][20:])]
    d, p = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, start int"), spark.createDataFrame(items, "item_id long, text string")
    got = leaks.leaked_passages(d, p)
    assert rows(got.select("doc_id", "item_id")) == sorted(brute(docs, items), key=repr)
    assert rows(leaks.leaked_passages(d, p, block_chars=200).select("doc_id", "item_id")) == sorted(brute(docs, items), key=repr)
    span = {(x.doc_id, x.item_id): x for x in got.collect()}
    assert span[6, 0].words == 14 and docs[5][1][span[6, 0].start : span[6, 0].end] == ITEM
    assert span[1, 0].words == 12 and docs[0][1][span[1, 0].start :].startswith("TWO")
    assert leaks.leaked_passages(d.limit(0), p).count() == leaks.leaked_passages(d, p.limit(0)).count() == 0


PROSE = "The judge called this one plausible and a little surprising, and the rest follows from there when both are still new. We saw it before anyone had tried the others on a fresh board. "
GERMAN = "Der kürzeste Weg zu diesem Ort führt über den Wald, und niemand ahnte, dass es so schnell gehen kann. Viele tauschen Feuer gegen Wasser, was kaum jemand errät. "
TALK = "\n".join(["p1: Did the river work for you?", "host: Yes, that came up at once!", "p2: Thanks, I will test the stone tonight.", "p1: No luck with the glass so far."])
LINKS = "\n".join(f"* [river](https://go.example.test/a-{i}/stone.html)" for i in range(12))
STUFF = " ".join(["buy cheap river online", "river price", "best river recipe", "river coupon"] * 12)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (PROSE * 3, False), (GERMAN * 3, False), (TALK, False), ("\n".join(f"{i}. {PROSE}" for i in range(6)), False), (PROSE * 4 + "\nTags: river, stone, glass, fire", False),
        (PROSE * 8 + "\n" + "\n".join(LINKS.split("\n")[:4]), False), (None, False), ("", False), ("...", False), ("river", False),
        (STUFF, True), (LINKS, True), ("#river #stone #river_price #best_river #cheapstone " * 8, True), ("Tags: " + ", ".join(["river", "stone", "glass", "river"] * 12), True), (PROSE[:120] + "\n" + STUFF, True),
        ("\n".join(f"Elemora river | red | SKU-{i}123 | 19.9{i}" for i in range(9)), True), ("the river, River / RIVER the river. " * 12, True),
    ],
)
def test_stuffed(spark, text, want):
    docs = spark.createDataFrame([(1, text, "en", 1), (2, PROSE * 5, None, 1), (3, GERMAN * 5, "DE ", 1), (4, PROSE, "xx", 1)], "doc_id long, text string, lang string, words int")
    assert (1 in {r.doc_id for r in stuffing.stuffed(docs).collect()}) is want


RUSSIAN = "Когда мы смешали огонь с водой, над берегом поднялся густой пар, и дети долго смотрели, как он тает в холодном воздухе. Потом старик рассказал им о реке, которая когда-то текла через лес. "
POLISH = "Kiedy zmieszaliśmy ogień z wodą, nad brzegiem uniosła się gęsta para, a dzieci długo patrzyły, jak znika w chłodnym powietrzu. Potem starzec opowiedział im historię rzeki płynącej przez las. "
TURKISH = "Ateşi suyla karıştırdığımızda kıyının üzerinde yoğun bir buhar yükseldi ve çocuklar soğuk havada kayboluşunu uzun süre izlediler. Sonra yaşlı adam onlara ormandan geçen nehrin hikâyesini anlattı. "
CHINESE = "我们把火和水混在一起，岸边升起了浓浓的蒸汽，孩子们看了很久。后来老人给他们讲了那条穿过森林的河的故事。"


@pytest.mark.parametrize("lang", [None, "own", "en"])
def test_other_languages_are_not_spam(spark, rows, lang):
    """Prose whose function words nobody listed, with its own label, none, or a wrong one; keywords still come out."""
    texts = {"ru": RUSSIAN, "pl": POLISH, "tr": TURKISH, "zh": CHINESE}
    lines = [(i, t.strip() + f" {i}", k if lang == "own" else lang if k in ("ru", "zh") or lang is None else None) for i, (k, t) in enumerate(texts.items()) if lang != "en" or k in ("pl", "tr")]
    lines += [(50 + i, PROSE * 3, "en") for i in range(5)] + [(90, "вода, огонь, вода, река, вода, пар, " * 12, "ru" if lang else None)]
    df = spark.createDataFrame(lines, "doc_id long, text string, lang string")
    assert rows(stuffing.stuffed(df)) == [(90,)]


def test_function_words_are_learnt(spark):
    """From the labelled documents of a language; then pages that lack them are told from those that don't."""
    r = random.Random(4)
    nouns = [f"слово{i}" for i in range(300)]
    prose = lambda: " ".join(f"и {r.choice(nouns)} на {r.choice(nouns)} что он {r.choice(nouns)} в" for _ in range(8))
    docs = [(i, prose(), "ru-RU") for i in range(80)] + [(500, " ".join(r.sample(nouns, 60)), "RU"), (501, " ".join(r.sample(nouns, 60)), "xx")] + [(900 + i, PROSE, "en") for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    learnt = stuffing.learnt_words(df)
    assert list(learnt) == ["ru"] and {"и", "на", "что", "он", "в"} <= set(learnt["ru"]) and len(learnt["ru"]) <= stuffing.LEARN_WORDS
    assert [x.doc_id for x in stuffing.stuffed(df).collect()] == [500]


def test_stuffed_tables(spark):
    docs = spark.createDataFrame([(1, STUFF * 200, "en"), (1, STUFF, "en")], "doc_id long, text string, lang string")
    assert [r.doc_id for r in stuffing.stuffed(docs).collect()] == [1]
    assert stuffing.stuffed(docs.limit(0)).count() == 0


def test_short_texts_of_links(spark, rows):
    """Fewer than six words: links decide, lists and repetition don't."""
    texts = ["https://shop.example/cheap", "#sale #cheap #shoes", "<a href='x'>", "lamp, lamp, lamp", "a calm lake", "see www.example.org for the rest", ""]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    assert rows(stuffing.stuffed(df)) == [(0,), (1,), (2,)]
    assert stuffing.spam_shares(df).columns == ["doc_id", "words", "spam_words"]
