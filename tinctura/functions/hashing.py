"""Identifiers, stable buckets and small integer hashes (survey ids of 1.3, D1, P20, P21, S15)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tinctura.functions.text import Name, col

# Constants of FNV-1a (32 bits) and of the linear congruential generator; the alphabet of packed ids.
FNV_START, FNV_PRIME, LCG_FACTOR, LCG_STEP, WORD = 2166136261, 16777619, 1664525, 1013904223, 1 << 32
PACKED_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-="
# End of fixed values.


def json_id(*parts: Column) -> Column:
    """sha256 of the parts as a compact JSON list."""
    return F.sha2(F.to_json(F.array(*parts)), 256)


def canonical_pair_id(a: Name, b: Name) -> Column:
    """The id of a canonical pair, inputs in order."""
    return json_id(F.least(col(a), col(b)), F.greatest(col(a), col(b)))


def import_pair_id(dataset: Name, a: Name, b: Name) -> Column:
    return json_id(col(dataset), F.least(col(a), col(b)), F.greatest(col(a), col(b)))


def candidate_id(pair_id: Name, rank: Name, output: Name) -> Column:
    return json_id(col(pair_id), col(rank).cast("string"), col(output))


def web_pair_id(dataset: Name, a: Name, b: Name) -> Column:
    """``dataset:`` and 24 digits of the sha256 of ``a+b``."""
    return F.concat(col(dataset), F.lit(":"), F.substring(F.sha2(F.concat_ws("+", F.least(col(a), col(b)), F.greatest(col(a), col(b))), 256), 1, 24))


def stable_bucket(text: Name, modulo: int = 10_000) -> Column:
    """The first 48 bits of the sha256, modulo ``modulo``."""
    return (F.conv(F.substring(F.sha2(col(text), 256), 1, 12), 16, 10).cast("long") % modulo).cast("int")


def split_of(a: Name, b: Name, train: float = 0.8, dev: float = 0.1) -> Column:
    """Train, dev or test by the pair alone, so that a pair never is in two splits."""
    bucket = stable_bucket(F.concat_ws("+", col(a), col(b)))
    upto = int(train * 10_000)
    return F.when(bucket < upto, "train").when(bucket < upto + int(dev * 10_000), "dev").otherwise("test")


def fnv1a(text: Name) -> Column:
    """P20: FNV-1a over UTF-16 units, as a non-negative 64-bit integer."""
    units = F.regexp_extract_all(F.hex(F.encode(col(text), "UTF-16BE")), F.lit("(....)"), F.lit(1))
    codes = F.transform(units, lambda u: F.conv(u, 16, 10).cast("long"))
    return F.aggregate(codes, F.lit(FNV_START).cast("long"), lambda h, c: (h.bitwiseXOR(c) * FNV_PRIME) % WORD)


def lcg(state: Column) -> Column:
    """The next state of the generator; divide by 2^32 for a number in [0, 1)."""
    return (state * LCG_FACTOR + LCG_STEP) % WORD


def packed_id(n: Name) -> Column:
    """A non-negative integer in base 64, most significant digit first."""
    digit = lambda v: F.substring(F.lit(PACKED_ALPHABET), (v % 64 + 1).cast("int"), F.lit(1))
    rest = lambda k: F.floor(col(n) / F.lit(64**k)).cast("long")
    return F.concat(*[F.when((rest(k) > 0) | F.lit(k == 0), digit(rest(k))).otherwise("") for k in range(9, -1, -1)])


def unpacked_id(text: Name) -> Column:
    """The integer of a packed id."""
    letters = F.filter(F.split(col(text), ""), lambda x: x != "")
    return F.aggregate(letters, F.lit(0).cast("long"), lambda v, x: v * 64 + F.position(x, F.lit(PACKED_ALPHABET)).cast("long") - 1)


def hue(name: Name) -> Column:
    """A colour angle by the name's hash."""
    return (fnv1a(F.lower(F.trim(col(name)))) % 360).cast("int")
