"""Vector arithmetic on arrays of floating-point numbers, in double precision."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(x), doubles(y), lambda a, b: a * b), F.lit(0.0), lambda s, p: s + p)


def norm(x: Column) -> Column:
    return F.sqrt(dot(x, x))


def cosine(x: Column, y: Column) -> Column:
    """Cosine similarity; 0 if either vector is zero."""
    return F.coalesce(F.try_divide(dot(x, y), norm(x) * norm(y)), F.lit(0.0))


def unit(x: Column) -> Column:
    """Scaled to length 1; a zero vector stays."""
    return F.transform(doubles(x), lambda v: F.coalesce(F.try_divide(v, norm(x)), F.lit(0.0)))


def centroid(xs: Column) -> Column:
    """The mean of an array of vectors, not scaled; null for an empty array."""
    summed = F.aggregate(F.slice(xs, 2, 1 << 30), doubles(F.get(xs, F.lit(0))), lambda s, x: F.zip_with(s, doubles(x), lambda a, b: a + b))
    return F.transform(summed, lambda v: v / F.size(xs))


def mean(values: Column) -> Column:
    """The mean of an array of numbers, null for an empty one."""
    return F.try_divide(F.aggregate(values, F.lit(0.0), lambda s, v: s + v), F.size(values))


def cosine_matrix(xs: Column, ys: Column) -> Column:
    """A row for each of ``xs`` with its cosine similarity to each of ``ys``."""
    return F.transform(xs, lambda x: F.transform(ys, lambda y: cosine(x, y)))


def distance_matrix(xs: Column, ys: Column) -> Column:
    """One less the cosine similarity of each pair."""
    return F.transform(cosine_matrix(xs, ys), lambda row: F.transform(row, lambda c: 1 - c))


def min_distances(samples: Column, references: Column) -> Column:
    """Of each sample, the cosine distance to the nearest reference."""
    return F.transform(samples, lambda s: F.array_min(F.transform(references, lambda r: 1 - cosine(s, r))))


def mean_distances(samples: Column, references: Column) -> Column:
    """Of each sample, half the mean cosine distance to the references."""
    return F.transform(samples, lambda s: mean(F.transform(references, lambda r: 1 - cosine(s, r))) / 2)


def centroid_distances(samples: Column, references: Column) -> Column:
    """Of each sample, the cosine distance to the references' centroid."""
    middle = centroid(references)
    return F.transform(samples, lambda s: 1 - cosine(s, middle))


def mean_pairwise_distance(samples: Column) -> Column:
    """The mean cosine distance of all pairs; 0 with fewer than two."""
    n = F.size(samples)
    total = F.aggregate(F.flatten(F.transform(samples, lambda s: F.transform(samples, lambda t: 1 - cosine(s, t)))), F.lit(0.0), lambda a, d: a + d)
    own = F.aggregate(F.transform(samples, lambda s: 1 - cosine(s, s)), F.lit(0.0), lambda a, d: a + d)
    return F.when(n < 2, 0.0).otherwise((total - own) / (n * (n - 1)))


def creativity(samples: Column, references: Column, novelty: Column, alpha: float = 0.8, penalty: float = 2.0) -> Column:
    """Plausibility, novelty and diversity of samples and their weighted sum, as a struct."""
    away = centroid_distances(samples, references)
    plausible = F.transform(away, lambda d: 1 - d / 2)
    spread = mean_pairwise_distance(samples)
    local = alpha * mean(F.zip_with(plausible, novelty, lambda p, n: F.pow(p, F.lit(penalty)) * n)) + (1 - alpha) * spread / 2
    return F.struct(
        mean(away).alias("plausibility_distance"), mean(plausible).alias("plausibility_score"), mean(novelty).alias("novelty"),
        spread.alias("diversity_distance"), (spread / 2).alias("diversity_score"), local.alias("local_creativity"),
    )
