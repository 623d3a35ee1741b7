"""Writers (survey ids K1-K13). Spark writes folders; a table that is replaced is written beside and then swapped in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tinctura.operators.arena import distinct_on


def write_lines(df: DataFrame, path: str) -> None:
    """K1: JSON lines, replacing what is there; non-ASCII text stays as it is."""
    df.write.mode("overwrite").json(path)


def write_splits(df: DataFrame, path: str, by: str = "split") -> None:
    """K2: a folder per split."""
    df.write.mode("overwrite").partitionBy(by).parquet(path)


def append_new(df: DataFrame, path: str, keys: list[str], spark: SparkSession) -> int:
    """K3, K8: append the rows whose key isn't there yet (one per key); how many there were."""
    new = df.dropDuplicates(keys)
    if exists(spark, path):
        new = new.join(spark.read.parquet(path).select(*keys), keys, "left_anti")
    new = new.persist()
    try:
        n = new.count()
        new.write.mode("append").parquet(path)
    finally:
        new.unpersist()
    return n


def write_with_rejects(df: DataFrame, good: str, path: str, rejects: str) -> None:
    """K4: the rows that hold ``good`` to one place, the others (null too) to another."""
    df.filter(F.coalesce(F.expr(good), F.lit(False))).write.mode("overwrite").parquet(path)
    df.filter(~F.coalesce(F.expr(good), F.lit(False))).write.mode("overwrite").json(rejects)


def write_report(df: DataFrame, path: str) -> None:
    """K5: a report of a few rows as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def sized_name(stem: str, n: int | None) -> str:
    """K6: a file name with its size: ``1k``, ``250`` or ``all``."""
    return f"{stem}_{'all' if n is None else f'{n // 1000}k' if n and n % 1000 == 0 else n}"


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """K7: old rows and new ones, the new in place of old ones with the same key. ``new`` has a row per key."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def improved(old: DataFrame, new: DataFrame, keys: list[str], score: str, at: str) -> DataFrame:
    """K9: of each key the row with the lowest score; an old row stays unless a new one is strictly better."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return distinct_on(both, keys, F.col(score), F.col("_new"), F.col(at)).drop("_new")


def without(parent: DataFrame, child: DataFrame, gone: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Both tables without the parents whose key is in ``gone``, and without their children."""
    return parent.join(gone, key, "left_anti"), child.join(gone, key, "left_anti")


def replaced_children(old: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """All children of the parents in ``new`` replaced by the new ones."""
    return old.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new)


def swap(df: DataFrame, path: str, spark: SparkSession) -> None:
    """Replace the table at ``path`` by ``df``, which may read from it.

    The new one is written beside, the old one is renamed aside and removed last; whatever fails, one of them is whole.
    """
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    here, new, old = place(path), place(f"{path}.new"), place(f"{path}.old")
    df.write.mode("overwrite").parquet(f"{path}.new")
    files = here.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.delete(old, True)
    if files.exists(here) and not files.rename(here, old):
        raise OSError(f"{path} can't be renamed")
    if not files.rename(new, here):
        files.rename(old, here)
        raise OSError(f"{path}.new can't be renamed")
    files.delete(old, True)


def load_counts(pairs: DataFrame) -> DataFrame:
    """Pairs and candidates loaded, by split."""
    return pairs.groupBy("split").agg(F.count("*").alias("pairs"), F.sum(F.size("known_outputs")).alias("candidates"))


def append_log(df: DataFrame, path: str) -> None:
    """Append to a log of JSON lines, columns in order of their names."""
    df.select(*sorted(df.columns)).write.mode("append").json(path)


def exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
