"""Problem 8: held-out passages in corpus documents.

One Aho-Corasick automaton holds every run of twelve successive words of every passage, a word being one symbol, and
reads each document once; matches are mapped back to offsets of the original text.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tinctura.storage import spread

#: Successive words that make a leak.
RUN_WORDS = 12
#: Letters of passages in one automaton; more passages are scanned for in blocks of about this size.
BLOCK_CHARS = 4_000_000
WORD = re.compile(r"[^\W_]+")
_SCHEMA = "doc_id long, item_id long, start int, end int, words int"


class Passages:
    """The automaton of a block of ``(item_id, text)``."""

    def __init__(self, items: list[tuple[int, str]], run: int = RUN_WORDS):
        import ahocorasick  # only where it is used, so that the other operators don't need it

        self.run, self.symbols = run, {}
        self.at: list[list[tuple[int, int]]] = []
        self.automaton = ahocorasick.Automaton()
        for item, text in items:
            coded = "".join(self._symbol(w) for w in WORD.findall((text or "").lower()))
            for i in range(len(coded) - run + 1):
                piece = coded[i : i + run]
                if (k := self.automaton.get(piece, -1)) < 0:
                    self.automaton.add_word(piece, k := len(self.at))
                    self.at.append([])
                self.at[k].append((item, i))
        if self.at:
            self.automaton.make_automaton()

    def _symbol(self, word: str) -> str:
        n = self.symbols.setdefault(word, len(self.symbols) + 1)
        return chr(n + 0xFFFF)

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """``(item, start, end, words)`` of the longest quotation of each item that ``text`` holds; the first of equals."""
        if not text or not self.at:
            return []
        words = list(WORD.finditer(text.lower()))
        if len(words) < self.run:
            return []
        coded = "".join([chr(n + 0xFFFF) if (n := self.symbols.get(m[0])) else "\x01" for m in words])
        runs: dict[tuple[int, int], int] = {}  # item and (place in the text less place in the item) -> words so far
        best: dict[int, tuple[int, int]] = {}
        for end, k in self.automaton.iter(coded):
            for item, i in self.at[k]:
                key = (item, end - i)
                # The window before this one, one word earlier on the same line, makes the quotation a word longer.
                begun = runs.get(key)
                n = begun[1] + 1 if begun and begun[0] == end - 1 else self.run
                runs[key] = (end, n)
                if n > best.get(item, (0, 0))[0]:
                    best[item] = (n, end)
        plain = len(text.lower()) == len(text)
        spans = words if plain else list(WORD.finditer(text))
        if len(spans) != len(words):
            spans = words
        return [(item, spans[end - n + 1].start(), spans[end].end(), n) for item, (n, end) in best.items()]


_held: tuple[str, Passages] | None = None


def _shared(name: str, build: Callable[[], Passages]) -> Passages:
    """A worker's automaton, built once however many tasks it runs; only the last one is kept."""
    global _held
    if _held is None or _held[0] != name:
        _held = (name, build())
    return _held[1]


def leaked_passages(documents: DataFrame, passages: DataFrame, *, run_words: int = RUN_WORDS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id, item_id, start, end, words``: each document that quotes at least ``run_words`` successive words of an item.

    start and end are offsets of the longest quotation in the original text, words its length. Case and whatever
    stands between words are ignored. Null or empty texts and passages shorter than that never match; repeated
    documents and items come out each; whole texts are read, however long; further columns don't matter.
    """
    spark = documents.sparkSession
    sized = passages.select("item_id", "text").filter("text is not null")
    chars = sized.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // block_chars))
    out = None
    for b in range(blocks):
        mine = sized.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()  # a block's passages, bounded
        shared = spark.sparkContext.broadcast([(r["item_id"], r["text"]) for r in mine])

        def scan(batches: Iterator[pa.RecordBatch], shared: object = shared, name: str = uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            found = _shared(name, lambda: Passages(shared.value, run_words))
            for batch in batches:
                rows = [(d, *hit) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True) for hit in found.find(t)]
                cols = list(zip(*rows, strict=True)) or [[]] * 5
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "item_id", "start", "end", "words"])

        part = spread(documents.select("doc_id", "text")).mapInArrow(scan, _SCHEMA)
        out = part if out is None else out.unionByName(part)
    return out
