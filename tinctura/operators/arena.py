"""Runs, rankings, windows, leaderboards and preferences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tinctura.functions.text import concept
from tinctura.operators.skew import lookup


def runs(events: DataFrame, threshold: float = 250.0) -> DataFrame:
    """Arena runs out of events: model, UTC day, success, number of combinations, depth."""
    combos = F.get_json_object("props", "$.k").cast("int")
    return events.select(F.col("event_id").alias("run_id"), F.col("event_type").alias("model"), F.date_format("ts", "yyyy-MM-dd").alias("day"), (F.col("value") > threshold).alias("won"), combos.alias("combinations"), (F.col("user_id") % 20 + 1).cast("int").alias("depth"))


def standings(rows: DataFrame, *by: str) -> DataFrame:
    """Runs, wins, win rate and the mean combinations of wins, for each ``by``."""
    return rows.groupBy(*by).agg(
        F.count("*").alias("runs"), F.count_if(F.col("won")).alias("wins"), F.avg(F.col("won").cast("int").cast("double")).alias("win_rate"),
        F.avg(F.when(F.col("won"), F.col("combinations").cast("double"))).alias("avg_combinations"),
    )


def ranked(board: DataFrame) -> DataFrame:
    """O2: by win rate, then fewer combinations (none last), then model; with ``place``."""
    order = [F.desc("win_rate"), F.asc_nulls_last("avg_combinations"), F.asc("model")]
    return board.withColumn("place", F.row_number().over(Window.orderBy(*order)))  # a row per model


def efficiency(board: DataFrame) -> DataFrame:
    """models that won, with their mean combinations to one decimal."""
    return board.filter("avg_combinations is not null").select("model", F.round("avg_combinations", 1).alias("avg"), "wins")


def overall(daily: DataFrame) -> DataFrame:
    """Per model the mean of its daily win rates, sums, days, and combinations weighted by wins."""
    weight = F.when(F.col("avg_combinations").isNotNull(), F.col("wins"))
    return daily.groupBy("model").agg(
        F.avg("win_rate").alias("score"), F.countDistinct("day").alias("days"), F.sum("runs").alias("runs"), F.sum("wins").alias("wins"),
        F.try_divide(F.sum(F.col("avg_combinations") * weight), F.sum(weight)).alias("avg_combinations"),
    )


def day_grid(daily: DataFrame, models: list[str]) -> DataFrame:
    """A row per day, a column per model with its win rate, null where it didn't run."""
    return daily.groupBy("day").pivot("model", models).agg(F.first("win_rate"))


def trend(daily: DataFrame) -> DataFrame:
    """The change of a model's win rate since its day before, and its best so far."""
    w = Window.partitionBy("model").orderBy("day")
    return daily.withColumns({"change": F.col("win_rate") - F.lag("win_rate").over(w), "best": F.max("win_rate").over(w.rowsBetween(Window.unboundedPreceding, 0))})


def best_scores(scores: DataFrame, keys: list[str], score: str, at: str, tie: str) -> DataFrame:
    """A10, K9: each key's lowest score; of equals the earliest, then the smallest ``tie``."""
    chosen = F.min(F.struct(F.col(score), F.col(at), F.col(tie)))
    return scores.groupBy(*keys).agg(chosen.alias("b")).select(*keys, *[F.col(f"b.{c}").alias(c) for c in (score, at, tie)])


def top(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows: a top-k report."""
    return rows.orderBy(*order).limit(n)


def distinct_on(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key, the first in ``order``; group-wise minimum with map-side combining, no window sort.

    ``order`` must make the choice unique.
    """
    fields = [F.col(c) for c in rows.columns]
    ordered = rows.withColumn("_o", F.struct(*order))
    return ordered.groupBy(*keys).agg(F.min_by(F.struct(*fields), "_o").alias("r")).select("r.*")


def first_dataset(rows: DataFrame, final: str) -> DataFrame:
    """Of each pair only the candidates of one dataset: the final one, else the first by name."""
    best = rows.groupBy("input_a", "input_b").agg(F.min(F.struct((F.col("dataset") != final).alias("other"), "dataset")).alias("b"))
    return rows.join(best.select("input_a", "input_b", F.col("b.dataset").alias("dataset")), ["input_a", "input_b", "dataset"])


def looked_up(requests: DataFrame, stored: DataFrame) -> DataFrame:
    """Requests with their stored output; ``missing`` where one has to be generated."""
    best = distinct_on(stored, ["input_a", "input_b"], F.col("rank"), F.col("output"))
    rows = requests.withColumns({"input_a": F.least("x", "y"), "input_b": F.greatest("x", "y")})
    return lookup(rows, best.select("input_a", "input_b", "output"), ["input_a", "input_b"]).withColumn("missing", F.col("output").isNull())


def options(stored: DataFrame, generated: DataFrame, n: int = 3) -> DataFrame:
    """Up to ``n`` distinct options a pair; fewer than two: none.

    The stored one of rank 1 comes first and always stays, then generated ones, then what else is stored. Options are
    the same if their concepts are; the first of them stays.
    """
    rows = stored.select("input_a", "input_b", "output", F.when(F.col("rank") == 1, 0).otherwise(2).alias("kind"), F.col("rank")).unionByName(generated.select("input_a", "input_b", "output", F.lit(1).alias("kind"), F.col("rank")))
    rows = rows.withColumn("c", concept("output")).filter("c <> ''")
    first = rows.groupBy("input_a", "input_b", "c").agg(F.min(F.struct("kind", "rank", "output")).alias("o"))
    sorted_ = F.slice(F.array_sort(F.collect_list("o")), 1, n)
    return first.groupBy("input_a", "input_b").agg(sorted_.alias("o")).filter(F.size("o") > 1).select("input_a", "input_b", F.transform("o", lambda x: x["output"]).alias("options"))


def window_counts(hits: DataFrame, keys: list[str], at: str, seconds: int) -> DataFrame:
    """Hits by key and fixed window."""
    start = F.window(at, f"{seconds} seconds")
    return hits.groupBy(*keys, start.alias("w")).agg(F.count("*").alias("hits")).select(*keys, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "hits")


def limited(hits: DataFrame, keys: list[str], at: str, seconds: int, limit: int) -> DataFrame:
    """Each hit's number in its window, whether it is allowed (the limit included), and the seconds to wait if not.

    Hits are numbered within their second and the seconds before are added from counts, so that a busy key's window
    isn't sorted by one task.
    """
    second = F.unix_timestamp(F.col(at).cast("timestamp"))
    rows = hits.withColumn("_s", second).withColumn("_w", second - F.pmod(second, F.lit(seconds)))
    counts = rows.groupBy(*keys, "_w", "_s").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys, "_w").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys, "_s").orderBy(at, "event_id")))
    rows = within.join(counts.select(*keys, "_s", before.alias("_b")), [*keys, "_s"]).withColumn("nth", (F.col("_k") + F.col("_b")).cast("long"))
    wait = F.greatest(F.lit(1), F.col("_w") + seconds - F.col("_s"))
    return rows.withColumn("allowed", F.col("nth") <= limit).withColumn("retry_after", F.when(~F.col("allowed"), wait).cast("long")).drop("_w", "_s", "_k", "_b")


def preference_events(events: DataFrame) -> DataFrame:
    """Preference events: the options shown (by JSON), the one selected, and their order."""
    k = F.get_json_object("props", "$.k").cast("int")
    shown = F.array_distinct(F.array(k % 7, k % 5 + 7, k % 3 + 12))
    source = F.get(F.array(F.lit("known_recipe"), F.lit("model_generated"), F.lit("typed")), k % 3)
    return events.select("event_id", "user_id", "ts", F.col("event_type").alias("mode"), shown.alias("shown"), F.get(shown, (F.col("event_id") % 4).cast("int")).alias("selected"), source.alias("source"), (k % 10).alias("combination_index"))


def valid_preferences(rows: DataFrame, modes: tuple[str, ...], sources: tuple[str, ...]) -> DataFrame:
    """Known mode and source, a positive index, two options or more, none missing, the selected one among them; with those rejected."""
    shown = (F.size("shown") >= 2) & ~F.exists("shown", lambda o: o.isNull()) & F.array_contains("shown", F.col("selected"))
    good = F.col("mode").isin(*modes) & F.col("source").isin(*sources) & (F.col("combination_index") > 0) & shown
    return rows.filter(good).withColumn("rejected", F.array_remove("shown", F.col("selected")))


def asked(n: str = "round") -> Column:
    """the third round and every fifth after it."""
    return (F.col(n) >= 3) & ((F.col(n) - 3) % 5 == 0)


def picked(requests: DataFrame, inventory: DataFrame, n: int = 6) -> DataFrame:
    """Of each request's distinct ids those in its owner's inventory, in the order asked, ``n`` at most."""
    one = requests.select("owner", F.posexplode(F.array_distinct("ids")).alias("at", "id")).join(inventory, ["owner", "id"], "left_semi")
    return one.groupBy("owner").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("at", "id"))), lambda x: x["id"]), 1, n).alias("ids"))


def two_of(options_: Column, seed: Column, n: int = 2) -> Column:
    """``n`` of the options in the order of a hash; the same for the same seed."""
    keyed = F.transform(options_, lambda o: F.struct(F.sha2(F.concat_ws("|", seed.cast("string"), o.cast("string")), 256).alias("h"), o.alias("o")))
    return F.slice(F.transform(F.array_sort(keyed), lambda x: x["o"]), 1, n)
