"""Problem 3: how often every term occurs, in how many records, and which terms are too rare or too common.

A global dictionary numbers the distinct terms; terms are encoded, each block of the input adds up counts of
occurrences and records by identifier, and the counts of all blocks are summed range by range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tinctura.operators.skew import BROADCAST_BYTES, numbered

#: Identifiers in a range; ranges of counts a block holds before it passes them on.
RANGE, HELD = 4096, 512
#: Tasks that a range's blocks are summed by in the first step.
SALTS = 16


def terms_of(col: Column | str) -> Column:
    """The longest runs of letters, combining marks and digits in the lower-cased text."""
    return F.regexp_extract_all(F.lower(col), F.lit(r"([\p{L}\p{M}\p{N}]+)"), F.lit(1))


def term_rows(df: DataFrame, fields: list[str]) -> DataFrame:
    """``field, term, first``: a row per occurrence; ``first`` marks one of a term's occurrences in its record.

    A record's terms are sorted, so that equal ones stand together and each is compared with the one before it only.
    """
    lists = F.array(*[F.struct(F.lit(i).cast("byte").alias("field"), F.sort_array(terms_of(c)).alias("terms")) for i, c in enumerate(fields)])
    each = df.select(F.explode(lists).alias("x")).select("x.field", "x.terms")
    one = each.select("field", "terms", F.posexplode("terms").alias("pos", "term"))
    return one.select("field", "term", ((F.col("pos") == 0) | (F.col("term") != F.get("terms", F.greatest(F.col("pos") - 1, F.lit(0))))).alias("first"))


def dictionary(terms: DataFrame) -> DataFrame:
    """``term, id``: the distinct terms in order, numbered from 0 without gaps; read from a written table."""
    return numbered(terms.select("term").distinct(), "term", name="id").select("term", "id")


_COUNTS = "field byte, range long, slots array<int>, occurrences array<long>, records array<long>"


class _Ranges:
    """Count arrays by field and identifier range, passed on when too many are held."""

    def __init__(self) -> None:
        self.held: dict[tuple[int, int], np.ndarray] = {}

    def add(self, field: np.ndarray, ids: np.ndarray, occurrences: np.ndarray, records: np.ndarray) -> Iterator[pa.RecordBatch]:
        key = ids // RANGE * 256 + field
        order = np.argsort(key, kind="stable")
        edges = np.flatnonzero(np.diff(key[order], prepend=-1))
        for k, at in zip(key[order][edges].tolist(), np.split(order, edges[1:]), strict=True):
            counts = self.held.get((k % 256, k // 256))
            if counts is None:
                if len(self.held) >= HELD:
                    yield self.out()
                counts = self.held[k % 256, k // 256] = np.zeros((2, RANGE), np.int64)
            slot = ids[at] % RANGE
            np.add.at(counts[0], slot, occurrences[at])
            np.add.at(counts[1], slot, records[at])

    def out(self) -> pa.RecordBatch:
        used = [np.flatnonzero(c[0]) for c in self.held.values()]
        ends = np.cumsum([0] + [len(u) for u in used])
        flat = lambda row: np.concatenate([c[row][u] for c, u in zip(self.held.values(), used, strict=True)] or [np.zeros(0, np.int64)])
        lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), v) for v in (pa.array(np.concatenate(used or [np.zeros(0)]), pa.int32()), pa.array(flat(0)), pa.array(flat(1)))]
        keys = list(self.held)
        self.held = {}
        return pa.RecordBatch.from_arrays([pa.array([f for f, _ in keys], pa.int8()), pa.array([r for _, r in keys], pa.int64()), *lists], ["field", "range", "slots", "occurrences", "records"])


def _count_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ranges = _Ranges()
    for b in batches:
        yield from ranges.add(*(b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("field", "id", "occurrences", "records")))
    yield ranges.out()


def _sum_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ranges = _Ranges()
    for b in batches:
        slots = b.column("slots")
        sizes = np.diff(slots.offsets.to_numpy())
        wide = lambda c: np.repeat(b.column(c).to_numpy().astype(np.int64), sizes)  # noqa: B023, E731
        yield from ranges.add(wide("field"), wide("range") * RANGE + slots.flatten().to_numpy(), b.column("occurrences").flatten().to_numpy(), b.column("records").flatten().to_numpy())
    yield ranges.out()


def term_counts(df: DataFrame, fields: list[str], *, broadcast_bytes: int = BROADCAST_BYTES) -> tuple[DataFrame, DataFrame]:
    """``field (name), id, occurrences, records`` and the dictionary ``term, id``.

    Null and empty values hold no terms; repeated rows count each; further columns don't matter. The dictionary is
    broadcast if it measures up to ``broadcast_bytes``; a larger one is joined by shuffle, after each block has
    added up its own terms, so that no term sends more than a row per block to one task.
    """
    tokens = term_rows(df, fields)
    terms = dictionary(tokens)
    size = terms.agg(F.sum(F.octet_length("term") + 48)).first()[0] or 0
    if size <= broadcast_bytes:
        coded = tokens.join(F.broadcast(terms), "term").select("field", "id", F.lit(1).alias("occurrences"), F.col("first").cast("int").alias("records"))
    else:
        block = tokens.withColumn("block", F.spark_partition_id()).groupBy("block", "field", "term").agg(F.count("*").alias("occurrences"), F.sum(F.col("first").cast("int")).alias("records"))
        # In the order of identifiers, so that a task fills one range after the other.
        coded = block.join(terms, "term").select("field", "id", "occurrences", "records").sortWithinPartitions("id")
    blocks = coded.mapInArrow(_count_block, _COUNTS)
    # A range's blocks are summed in two steps, so that a range in every block isn't one task's work alone.
    some = blocks.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS))).repartition("range", "salt").drop("salt").mapInArrow(_sum_ranges, _COUNTS)
    total = some.repartition("range").mapInArrow(_sum_ranges, _COUNTS)
    each = total.select("field", "range", F.explode(F.arrays_zip("slots", "occurrences", "records")).alias("x"))
    # A range that a task passed on early comes out in parts.
    summed = each.groupBy("field", (F.col("range") * RANGE + F.col("x.slots")).alias("id")).agg(F.sum("x.occurrences").alias("occurrences"), F.sum("x.records").alias("records"))
    names = F.element_at(F.array(*[F.lit(f) for f in fields]), F.col("field") + 1)
    return summed.select(names.alias("field_name"), "id", "occurrences", "records"), terms


def marked_terms(df: DataFrame, fields: list[str], *, rare_below: int = 3, common_over: float = 0.01, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``field_name, term, occurrences, records, mark``.

    mark: ``rare`` in fewer than ``rare_below`` records, ``common`` in more than that share of all rows, else null.
    A term that is both (in a tiny table) is ``rare``. An empty table gives no terms.
    """
    counts, terms = term_counts(df, fields, broadcast_bytes=broadcast_bytes)
    rows = df.count()
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") > F.lit(rows) * common_over, "common")
    return counts.withColumn("mark", mark).join(terms, "id").select("field_name", "term", "occurrences", "records", "mark")
