"""Joins and lookups that hold when one key owns a third of all rows."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window, functions as F

from tinctura.storage import materialize, measured

#: A group is hot if it holds more than one in HOT_PARTS of the rows; so fewer than HOT_PARTS groups are hot.
HOT_PARTS = 1000
#: Bytes up to which a lookup table is broadcast; beyond, it is joined by shuffle.
BROADCAST_BYTES = 16 << 20


def salted_join(rows: DataFrame, groups: DataFrame, keys: list[str], count_col: str, row_id: Column, how: str = "inner") -> DataFrame:
    """Join ``rows`` with one row per key of ``groups``, splitting the hot keys.

    ``groups`` must be cheap to read twice (a written table) and carries the number of its rows in ``count_col``.
    A key with more than 1/HOT_PARTS of the rows gets as many salts as it has such shares; fewer than HOT_PARTS
    keys can be that large, so their list is broadcast with a proven bound. Null keys never match.
    """
    total = groups.agg(F.sum(count_col)).first()[0] or 0
    share = max(1, total // HOT_PARTS)
    salts = F.least(F.ceil(F.col(count_col) / F.lit(share)).cast("int"), F.lit(HOT_PARTS))
    hot = groups.filter(F.col(count_col) > share).select(*keys, salts.alias("_salts"))
    if not hot.take(1):
        return rows.join(groups, keys, how)
    left = rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.pmod(F.xxhash64(row_id), F.coalesce("_salts", F.lit(1))).cast("int"))
    right = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.when(F.col(count_col) > share, salts).otherwise(1) - 1)))
    return left.join(right, [*keys, "_salt"], how).drop("_salt", "_salts")


def lookup(df: DataFrame, small: DataFrame, on: list[str], *, bound: int = BROADCAST_BYTES, how: str = "left", size: int | None = None) -> DataFrame:
    """Join with a lookup table of one row a key, whatever its size and however often a key is asked for.

    ``size``: the table's bytes where they are known (``storage.measured``); else it is written to learn them. Up to
    ``bound`` it is broadcast. Beyond, the rows of the keys asked for most (fewer than HOT_PARTS) are broadcast, and
    only rows with other keys meet the rest by shuffle. how: left, inner, left_semi or left_anti.
    """
    if size is None:
        small, size = measured(small, "lookup")
    if size <= bound:
        return df.join(F.broadcast(small), on, how)
    asked = df.groupBy(*on).agg(F.count("*").alias("_n"))
    total = df.count()
    hot = asked.filter(F.col("_n") > max(1, total // HOT_PARTS)).select(*on)
    hot_rows = measured(small.join(F.broadcast(hot), on, "left_semi"), "hot")[0]
    values = [c for c in small.columns if c not in on]
    found = hot_rows.select(*on, F.struct(F.lit(1).alias("_at"), *values).alias("_hot"))
    # Hot rows have what they need, null keys find nothing: salts spread both over all tasks, where nothing matches them.
    no_key = reduce(or_, [F.col(c).isNull() for c in on])
    left = df.join(F.broadcast(hot.withColumn("_is", F.lit(True))), on, "left").join(F.broadcast(found), on, "left")
    left = left.withColumn("_salt", F.when(F.col("_is") | no_key, F.pmod(F.monotonically_increasing_id(), F.lit(HOT_PARTS)) + 1).otherwise(0))
    right = small.select(*on, F.struct(F.lit(1).alias("_at"), *values).alias("_rest"), F.lit(0).cast("long").alias("_salt"))
    both = left.join(right, [*on, "_salt"], "left").withColumn("_r", F.coalesce("_hot", "_rest"))
    if how in ("inner", "left_semi"):
        both = both.filter("_r is not null")
    elif how == "left_anti":
        both = both.filter("_r is null")
    more = [F.col(f"_r.{c}").alias(c) for c in values] if how in ("left", "inner") else []
    return both.select(*on, *[c for c in df.columns if c not in on], *more)


def numbered(df: DataFrame, *order: str, name: str = "number") -> DataFrame:
    """``df`` with its rows' numbers from 0 in ``order``: sorted in ranges, each begun after the counts of those before.

    No task sorts all rows; only a row per range goes through one.
    """
    parts = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_m", 33)
    sizes = parts.groupBy(part.alias("_part")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sizes.select("_part", before.alias("_start")))
    return parts.withColumn("_part", part).join(starts, "_part").withColumn(name, F.col("_start") + F.col("_m") - F.shiftleft("_part", 33)).drop("_m", "_part", "_start")
