"""A compressed full-text index (Burrows-Wheeler text, sampled ranks and text numbers) searched in batches with numpy.

Letters are the bytes of UTF-8, so any script is told apart exactly. Suffixes are compared up to the end of their text
only: a search never runs over it, and what is equal so far stays in the order of the texts, which keeps the steps of
backward search consistent.
"""

from __future__ import annotations

import math

import numpy as np

BLOCK = 64  # letters between two rank samples, and bits of a mask
STEP = 8  # letters of a text between two samples of its number
TABLE = 1 << 21  # entries of the table of short endings at most
_BELOW = (np.uint64(1) << np.arange(BLOCK, dtype=np.uint64)) - np.uint64(1)  # bits before a place in its block


def suffix_order(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Order of the suffixes, and by order the number that their first ``k`` letters make. Code 0 ends a text.

    As many letters as fit a 64-bit number are sorted at once; only suffixes still equal are sorted on, doubling.
    """
    n, base = len(codes), int(codes.max()) + 1
    width = int(62 // math.log2(max(base, 2)))
    k = max(1, min(3, width, int(math.log(TABLE, max(base, 2)))))
    ends = np.flatnonzero(codes == 0)
    left = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)  # letters before the end
    key = np.zeros(n, np.int64)
    for i in range(width):
        key *= base
        key[: max(n - i, 0)] += np.where(left[: max(n - i, 0)] >= i, codes[i:], 0)
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    short = ordered // base ** (width - k)
    new = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    alone = new & np.concatenate((new[1:], [True]))
    slots = np.flatnonzero(~alone & (left[order] >= width))
    while len(slots):
        at = order[slots]
        both = rank[at] * n + rank[at + width]
        again = np.argsort(both, kind="stable")
        at, both = at[again], both[again]
        order[slots] = at
        new = np.concatenate(([True], both[1:] != both[:-1]))
        rank[at] = slots[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        alone = new & np.concatenate((new[1:], [True]))
        width *= 2
        slots = slots[~alone & (left[at] >= width)]
    return order, short, k


def _packed(bits: np.ndarray) -> np.ndarray:
    """Masks of BLOCK bits, the first the lowest."""
    return np.packbits(bits, bitorder="little").view("<u8")


class FMIndex:
    """Backward search over ``texts``, which must not hold U+0001."""

    def __init__(self, texts: list[str]):
        points = np.frombuffer("\x01".join([*texts, ""]).encode() or b"\x01", np.uint8)
        self.code = np.full(256, 255, np.uint8)
        seen = np.unique(points)
        self.code[seen] = np.arange(len(seen), dtype=np.uint8)  # the end mark is the smallest byte
        codes = self.code[points]
        self.base = len(seen)
        order, short, self.k = suffix_order(codes.astype(np.int64))
        self.n = n = len(codes)
        self.table = np.concatenate(([0], np.cumsum(np.bincount(short, minlength=self.base**self.k)))).astype(np.int32)
        self.bwt = np.full(-(-(n + 1) // BLOCK) * BLOCK, 255, np.uint8)
        self.bwt[:n] = codes[order - 1]
        self.first = np.concatenate(([0], np.cumsum(np.bincount(codes, minlength=self.base))))[:-1].astype(np.int64)
        self.bits = np.empty((len(self.bwt) // BLOCK, self.base), np.uint64)
        for c in range(self.base):
            self.bits[:, c] = _packed(self.bwt == c)
        per = np.bitwise_count(self.bits)
        self.sampled = np.zeros((len(per) + 1, self.base), np.int32)
        np.cumsum(per, axis=0, dtype=np.int32, out=self.sampled[1:])
        ends = np.flatnonzero(codes == 0)
        number = np.searchsorted(ends, np.arange(n)).astype(np.int32)
        place = np.arange(n) - np.concatenate(([0], ends[:-1] + 1))[number]
        mark = np.zeros(len(self.bwt), bool)
        mark[:n] = (place % STEP == 0)[order]
        self.marks, self.mark_bits = mark, _packed(mark)
        self.mark_rank = np.concatenate(([0], np.cumsum(np.bitwise_count(self.mark_bits), dtype=np.int32)))
        self.numbers = number[order[mark[:n]]]

    def _rank(self, code: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each code stands in the transformed text before position ``at``."""
        block = at // BLOCK
        return self.sampled[block, code] + np.bitwise_count(self.bits[block, code] & _BELOW[at % BLOCK]).astype(np.int64)

    def search(self, patterns: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The interval [low, high) of suffixes that begin with each pattern; of all for an empty one.

        The last ``k`` letters are looked up in a table, the others are added by backward search.
        """
        coded = [p.encode() for p in patterns]
        lengths = np.array([len(p) for p in coded], np.int64)
        ends = np.cumsum(lengths)
        codes = self.code[np.frombuffer(b"".join(coded), np.uint8)].astype(np.int64)
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        long = np.flatnonzero(lengths >= self.k)
        number, fits = np.zeros(len(long), np.int64), np.ones(len(long), bool)
        for i in range(self.k, 0, -1):
            c = codes[ends[long] - i]
            fits &= c < 255
            number = number * self.base + np.where(c < 255, c, 0)
        low[long], high[long] = self.table[number], np.where(fits, self.table[number + 1], self.table[number])
        done = np.where(lengths >= self.k, self.k, 0)
        live = np.flatnonzero((lengths > done) & (low < high))
        while len(live):
            c = codes[ends[live] - done[live] - 1]
            known = c < 255
            high[live[~known]] = low[live[~known]]
            live, c = live[known], c[known]
            both = self._rank(np.concatenate((c, c)), np.concatenate((low[live], high[live])))
            low[live], high[live] = self.first[c] + both[: len(live)], self.first[c] + both[len(live) :]
            done[live] += 1
            live = live[(lengths[live] > done[live]) & (low[live] < high[live])]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The number of the text that each suffix starts in, by walking back to a sampled place of it."""
        at, out = rows.astype(np.int64), np.empty(len(rows), np.int64)
        todo = np.arange(len(rows))
        while len(todo):
            hit = self.marks[at]
            b = at[hit] // BLOCK
            out[todo[hit]] = self.numbers[self.mark_rank[b] + np.bitwise_count(self.mark_bits[b] & _BELOW[at[hit] % BLOCK])]
            todo, at = todo[~hit], at[~hit]
            c = self.bwt[at].astype(np.int64)
            at = self.first[c] + self._rank(c, at)
        return out
