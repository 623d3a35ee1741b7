"""Streams over files (survey ids T1-T5, T7, K9). Every query runs until what is there is read, then stops."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tinctura.storage import folder, materialize


def file_stream(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """A stream of the Parquet files of a folder (or matching a pattern), some at a time."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    return stream.option("pathGlobFilter", name).parquet(folder) if name.endswith(".parquet") else stream.parquet(path)


def drained(stream: DataFrame, mode: str, to_batch: Callable[[DataFrame, int], None] | None = None, *, checkpoint: str | None = None) -> DataFrame:
    """What a stream gives up to the end of its input, written to the shared folder and read from there.

    Batches are written to a folder by batch number, replacing that of an earlier try, so each is there exactly once.
    In ``update`` mode a row stands for its key until a later batch's.
    """
    spark = stream.sparkSession
    base = folder(spark, "stream")
    out = f"{base}/out"

    def save(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={n}")

    query = stream.writeStream.outputMode(mode).foreachBatch(to_batch or save).option("checkpointLocation", checkpoint or f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(f"{_ddl(stream)}, batch int").option("basePath", out).parquet(out) if to_batch is None else stream.limit(0)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{n}` {t}" for n, t in df.dtypes)


def window_counter(events: DataFrame, keys: list[str], at: str, seconds: int, lateness: str = "1 hour") -> DataFrame:
    """Hits by key and fixed window; windows older than the watermark are dropped from the state."""
    rows = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, lateness)
    return rows.groupBy(*keys, F.window(at, f"{seconds} seconds").alias("w")).agg(F.count("*").alias("hits")).select(*keys, F.col("w.start").alias("window_start"), "hits")


def latest(updates: DataFrame, keys: list[str]) -> DataFrame:
    """The last update of each key out of ``drained`` in update mode."""
    cols = [c for c in updates.columns if c not in (*keys, "batch")]
    best = F.max_by(F.struct(*cols), "batch")
    return updates.groupBy(*keys).agg(best.alias("r")).select(*keys, "r.*")


def once(events: DataFrame, key: str, at: str, within: str = "2 days") -> DataFrame:
    """Events without repeats of a key within the watermark."""
    return events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, within).dropDuplicatesWithinWatermark([key])


def best_so_far(scores: DataFrame, keys: list[str], score: str, at: str) -> DataFrame:
    """Each key's lowest score and when it was first reached, as it improves."""
    return scores.groupBy(*keys).agg(F.min(F.struct(score, at)).alias("b")).select(*keys, f"b.{score}", f"b.{at}")


def resumed(spark: SparkSession, path: str, out: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame]) -> int:
    """T5: process the files that came since the last call, exactly once, appending to ``out``; rows there now."""
    stream = transform(file_stream(spark, path))
    query = stream.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out).count()


class Refreshed:
    """A table kept as it was loaded for ``seconds``, then loaded again; an empty one is never kept."""

    def __init__(self, load: Callable[[], DataFrame], seconds: float = 300.0, clock: Callable[[], float] = time.monotonic):
        self.load, self.seconds, self.clock = load, seconds, clock
        self.kept: tuple[DataFrame, float] | None = None

    def get(self) -> DataFrame:
        if self.kept and self.clock() - self.kept[1] < self.seconds:
            return self.kept[0]
        rows = materialize(self.load(), "refreshed")
        self.kept = (rows, self.clock()) if rows.take(1) else None
        return rows
