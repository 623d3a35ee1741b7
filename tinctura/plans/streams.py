"""Queries that run as streams to the end of their input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tinctura.plans.base import Plans
from tinctura.streaming import streams as T

plans = Plans()
queries, oracle_sql = plans.queries, plans.oracle_sql


@plans.add("SELECT user_id, event_type, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS hits FROM events GROUP BY 1, 2, 3")
def stream_window_counts(spark: SparkSession, d: str) -> DataFrame:
    """Fixed windows in update mode; a key's last update is its count."""
    stream = T.window_counter(T.file_stream(spark, f"{d}/events.parquet"), ["user_id", "event_type"], "ts", 3600, "60 days")
    keys = ["user_id", "event_type", "window_start"]
    return T.latest(T.drained(stream, "update"), keys).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@plans.add("SELECT DISTINCT event_id, user_id, event_type FROM events")
def stream_events_once(spark: SparkSession, d: str) -> DataFrame:
    """Events without repeats."""
    stream = T.once(T.file_stream(spark, f"{d}/events.parquet"), "event_id", "ts").select("event_id", "user_id", "event_type")
    return T.drained(stream, "append").drop("batch")


@plans.add("SELECT o_orderpriority AS goal, o_custkey AS user_id, min(o_totalprice) AS score, arg_min(o_orderdate, struct_pack(a := o_totalprice, b := o_orderdate)) AS at FROM orders GROUP BY 1, 2")
def stream_best_scores(spark: SparkSession, d: str) -> DataFrame:
    """T7, K9."""
    rows = T.file_stream(spark, f"{d}/orders.parquet").select(F.col("o_orderpriority").alias("goal"), F.col("o_custkey").alias("user_id"), F.col("o_totalprice").alias("score"), F.col("o_orderdate").alias("at"))
    return T.latest(T.drained(T.best_so_far(rows, ["goal", "user_id"], "score", "at"), "update"), ["goal", "user_id"])
