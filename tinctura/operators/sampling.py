"""Fixed-size samples (survey ids O6, O7, T4): sampling operators, so a size is their feature."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def reservoir(rows: DataFrame, n: int, by: Column, seed: int = 42) -> DataFrame:
    """The ``n`` rows with the smallest hash of ``by`` and the seed.

    A mergeable form of reservoir sampling: each task keeps its n smallest (a top-k), so memory stays at n rows a
    task, and the sample doesn't depend on partitioning or order.
    """
    return rows.orderBy(F.sha2(F.concat_ws("|", by.cast("string"), F.lit(str(seed))), 256), by).limit(n)
