"""Problem 1: copies hidden by spelling, spacing, punctuation and field order.

Canonical fields (letters and digits of the lower-cased text, inputs in order) are hashed to 128 bits; groups are
counted with map-side combining, so only two longs, a check and the running minimum cross the network.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tinctura.operators.skew import salted_join
from tinctura.storage import materialize

HASH = ["h1", "h2"]


def letters_digits(col: Column | str) -> Column:
    """The letters and digits of the lower-cased text."""
    return F.regexp_replace(F.lower(col), r"[^\p{L}\p{N}]", "")


def keyed(obs: DataFrame, *carry: Column, hash_bits: int = 128) -> DataFrame:
    """``obs_id``, canonical keys ``k_out``, ``k_lo``, ``k_hi``, their hash ``h1``, ``h2`` and a check ``chk``.

    Rows with a null field, or one that keeps no letter or digit, are left out. ``carry``: further columns.
    ``hash_bits``: below 128 only in tests, to make hashes collide.
    """
    a, b, out = (letters_digits(c) for c in ("input_a", "input_b", "output"))
    df = obs.select("obs_id", *carry, a.alias("k_a"), b.alias("k_b"), out.alias("k_out")).filter("k_a <> '' and k_b <> '' and k_out <> ''")
    df = df.withColumns({"k_lo": F.least("k_a", "k_b"), "k_hi": F.greatest("k_a", "k_b")}).drop("k_a", "k_b")
    part = lambda seed: F.xxhash64(F.lit(seed), "k_out", "k_lo", "k_hi")
    h1, h2 = part(0x51ED), part(0xA3B1)
    if hash_bits < 128:
        h1, h2 = F.pmod(h1, F.lit(1 << hash_bits)), F.lit(0).cast("long")
    return df.withColumns({"h1": h1, "h2": h2, "chk": F.hash("k_out", "k_lo", "k_hi")})


def copy_groups(rows: DataFrame) -> DataFrame:
    """Groups of at least two rows: ``h1, h2, first_obs_id, n_copies, mixed``; mixed: the hash joined unequal keys."""
    groups = rows.groupBy(*HASH).agg(F.min("obs_id").alias("first_obs_id"), F.count("*").alias("n_copies"), F.min("chk").alias("c0"), F.max("chk").alias("c1"))
    return groups.filter("n_copies > 1").select(*HASH, "first_obs_id", "n_copies", (F.col("c0") != F.col("c1")).alias("mixed"))


def hidden_copies(obs: DataFrame, *, hash_bits: int = 128) -> DataFrame:
    """One row ``first_obs_id, copy_obs_id`` for each copy of an earlier row.

    Two rows are copies if the letters and digits of their outputs agree, ignoring case, and those of their inputs
    agree in either order. Null or blank fields: no part. Repeated obs_id: each repeat stands for itself, but a row
    never is its own copy; a null obs_id can't be named and gives no row. An empty table gives an empty result. Other columns don't matter. Groups whose hash
    joined unequal keys (found by the check) are grouped again by their full keys.
    """
    rows = keyed(obs, hash_bits=hash_bits)
    groups = materialize(copy_groups(rows), "copy-groups")
    pairs = _pairs(rows.select("obs_id", *HASH), groups.filter(~F.col("mixed")), HASH)
    if groups.filter("mixed").take(1):
        full = ["k_out", "k_lo", "k_hi"]
        mixed = rows.join(groups.filter("mixed").select(*HASH), HASH, "left_semi")
        exact = mixed.groupBy(*full).agg(F.min("obs_id").alias("first_obs_id"), F.count("*").alias("n_copies")).filter("n_copies > 1")
        pairs = pairs.unionByName(_pairs(mixed.select("obs_id", *full), materialize(exact, "copy-exact"), full))
    return pairs


def _pairs(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    found = salted_join(rows, groups.select(*keys, "first_obs_id", "n_copies"), keys, "n_copies", F.col("obs_id"))
    return found.filter("obs_id <> first_obs_id").select("first_obs_id", F.col("obs_id").alias("copy_obs_id"))


def collapsed(obs: DataFrame, *, hash_bits: int = 128) -> DataFrame:
    """One row per distinct record: ``first_obs_id, n_copies``, singles included.

    A record is known by its 128-bit hash and the 32-bit check together, so unequal keys with one hash stay apart.
    """
    rows = keyed(obs, hash_bits=hash_bits)
    groups = rows.groupBy(*HASH, "chk").agg(F.min("obs_id").alias("first_obs_id"), F.count("*").alias("n_copies"))
    return groups.select("first_obs_id", "n_copies")
