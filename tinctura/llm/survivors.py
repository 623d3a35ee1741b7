"""Problem 4: one surviving record for each group of copies, field by field.

Each row votes, for each field, for what it holds, with a weight of its source's trust and its recency. ``voted_values``
sums votes by normalised value, as rows that agree make a value more credible. ``best_rows`` asks for rows by a strict
order, so there a vote is a number whose digits are trust, recency and row in the order of the field's rule (a decay so
steep that no sum of lesser votes outweighs a greater one), and the greatest vote names its row. Either way fields are
unpivoted, winners chosen by the greatest vote, and pivoted back; a vote is one number, so it is done within the task
that reads the rows, and only one row of winners a group and task crosses the network.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F

from tinctura.llm.copies import HASH, keyed
from tinctura.llm.lookalikes import emoji_forms, emoji_key
from tinctura.operators.skew import lookup

_LOW = -(1 << 63)
#: Votes are numbers of up to this many digits, those that an aggregate keeps in place.
VOTE_DIGITS = 38


def _with_trust(obs: DataFrame, trust: DataFrame, reference: DataFrame) -> DataFrame:
    """Adds ``trust`` (0 where the source is null or unlisted) and ``shown`` (the listed emoji, no placeholder)."""
    best = trust.filter("source is not null").groupBy("source").agg(F.max("trust").alias("trust"))
    forms = emoji_forms(reference).filter("not coalesce(is_placeholder, false)").select("key", F.col("emoji").alias("shown"))
    rows = obs.select("obs_id", "input_a", "input_b", "output", "emoji_output", "source", "observed_at").withColumn("key", emoji_key("emoji_output"))
    rows = lookup(lookup(rows, best, ["source"]), forms, ["key"])
    return rows.withColumn("trust", F.coalesce(F.col("trust").cast("long"), F.lit(0)))


def _measures(obs: DataFrame, trust: DataFrame) -> dict[str, tuple[int, int]]:
    """The least and greatest ``at`` (micros), ``trust`` (0 counts) and ``obs_id``: a scan of two narrow columns."""
    at = F.unix_micros(F.col("observed_at").cast("timestamp"))
    r = obs.agg(F.min(at).alias("a0"), F.max(at).alias("a1"), F.min("obs_id").alias("i0"), F.max("obs_id").alias("i1")).first()
    t = trust.agg(F.min("trust").alias("t0"), F.max("trust").alias("t1")).first()
    pair = lambda x, y: (0, 0) if x is None else (int(x), int(y))
    t0, t1 = pair(t["t0"], t["t1"])
    return {"at": pair(r["a0"], r["a1"]), "trust": (min(t0, 0), max(t1, 0)), "obs_id": pair(r["i0"], r["i1"])}


def digits(parts: list[tuple[Column, int]]) -> Column:
    """Numbers below their bounds as the digits of one, the first the most significant."""
    out = F.lit(Decimal(0)).cast(f"decimal({VOTE_DIGITS},0)")
    for value, bound in parts:
        out = (out * F.lit(Decimal(bound)).cast(f"decimal({VOTE_DIGITS},0)") + value.cast("decimal(20,0)")).cast(f"decimal({VOTE_DIGITS},0)")
    return out


def best_rows(obs: DataFrame, trust: DataFrame, reference: DataFrame, *, vote_digits: int = VOTE_DIGITS) -> DataFrame:
    """``first_obs_id, output_obs_id, emoji_obs_id, source_obs_id`` of each group of copies with two rows or more.

    output: latest observed_at (null is oldest), then higher trust. emoji_output: of rows that show a listed emoji
    other than a placeholder, higher trust, then latest observed_at; 0 without such a row. source: higher trust, then
    earliest observed_at (null last). Ties: smaller obs_id. Sources null or unlisted have trust 0; rows with a null
    or blank input or output belong to no group; repeated obs_id count as rows, a null one is never chosen; an empty
    table gives no group. Where the ranges of dates, trust and obs_id need more than ``vote_digits`` digits together,
    votes are structs instead, which say the same and sort.
    """
    rows = keyed(_with_trust(obs, trust, reference), F.col("trust"), F.unix_micros(F.col("observed_at").cast("timestamp")).alias("at"), F.col("shown").isNotNull().alias("shows"))
    spans = _measures(obs, trust)
    (a0, a1), (t0, t1), (i0, i1) = spans["at"], spans["trust"], spans["obs_id"]
    named = F.col("obs_id").isNotNull()
    latest = F.coalesce(F.col("at") - (a0 - 1), F.lit(0))
    earliest = F.coalesce(F.lit(a1 + 1) - F.col("at"), F.lit(0))
    trusted, row = F.col("trust") - t0, F.lit(i1) - F.col("obs_id")
    bounds = {"at": a1 - a0 + 2, "trust": t1 - t0 + 1, "row": i1 - i0 + 1}
    orders = {
        "output": (named, [(latest, "at"), (trusted, "trust"), (row, "row")]),
        "emoji": (named & F.col("shows"), [(trusted, "trust"), (latest, "at"), (row, "row")]),
        "source": (named, [(trusted, "trust"), (earliest, "at"), (row, "row")]),
    }
    fits = bounds["at"] * bounds["trust"] * bounds["row"] < 10**vote_digits
    vote = (lambda parts: digits([(c, bounds[b]) for c, b in parts])) if fits else (lambda parts: F.struct(*[c.cast("decimal(20,0)").alias(b) for c, b in parts]))
    row_of = (lambda v: v % F.lit(Decimal(bounds["row"]))) if fits else (lambda v: v["row"])
    keys = [*HASH, "chk"]  # the check keeps apart what the hash might join
    ballots = rows.select(*keys, "obs_id", *[F.when(may, vote(parts)).alias(f) for f, (may, parts) in orders.items()])
    won = ballots.groupBy(*keys).agg(F.min("obs_id").alias("first_obs_id"), F.count("*").alias("n"), *[F.max(f).alias(f) for f in orders]).filter("n > 1")
    return won.filter("first_obs_id is not null").select("first_obs_id", *[F.coalesce(F.lit(i1) - row_of(F.col(f)).cast("long"), F.lit(0)).alias(f"{f}_obs_id") for f in orders])


def voted_values(obs: DataFrame, trust: DataFrame, reference: DataFrame, *, half_life_days: float = 180.0) -> DataFrame:
    """A record built value by value: ``first_obs_id, n_copies, output, emoji_output, source``.

    Each row votes for its normalised value of each field with its source's trust plus one, halved for every
    ``half_life_days`` before the table's last observation (a null date counts as ten half-lives); the value with the
    most votes wins, ties go to the value later in order. Shown is the smallest spelling of the winning output. Groups of one row come
    out as well; null and blank values don't vote.
    """
    last = obs.agg(F.max("observed_at")).first()[0]
    age = F.least((F.unix_micros(F.lit(last).cast("timestamp")) - F.unix_micros(F.col("observed_at").cast("timestamp"))) / F.lit(86_400_000_000.0 * half_life_days), F.lit(60.0))
    rows = keyed(_with_trust(obs, trust, reference), "output", "shown", "source", ((F.col("trust") + 1) * F.pow(F.lit(0.5), F.coalesce(age, F.lit(10.0)))).alias("vote"))
    keys = [*HASH, "chk"]
    # The spelling goes along only where it may differ from the normalised value; rows without a value don't vote.
    fields = {"output": F.lower(F.trim("output")), "emoji_output": F.col("shown"), "source": F.when(F.trim("source") != "", F.col("source"))}
    spelt = {"output": F.col("output")}
    none = F.lit(None).cast("string")
    values = [F.when(norm.isNotNull(), F.struct(F.lit(i).cast("byte").alias("field"), norm.alias("norm"), spelt.get(f, none).alias("value"))) for i, (f, norm) in enumerate(fields.items())]
    long = rows.select(*keys, "obs_id", "vote", F.explode(F.array_compact(F.array(*values))).alias("x")).select(*keys, "obs_id", "vote", "x.*")
    is_output = F.col("field") == 0  # every row has an output, so these rows count it
    votes = long.groupBy(*keys, "field", "norm").agg(F.round(F.sum("vote"), 9).alias("votes"), F.min("value").alias("value"), F.min(F.when(is_output, F.col("obs_id"))).alias("first"), F.count("*").alias("n"))
    shown = F.coalesce("value", "norm")
    winners = [F.max_by(F.when(F.col("field") == i, shown), F.when(F.col("field") == i, F.struct("votes", "norm"))).alias(f) for i, f in enumerate(fields)]
    return votes.groupBy(*keys).agg(F.min("first").alias("first_obs_id"), F.sum(F.when(is_output, F.col("n"))).alias("n_copies"), *winners).drop(*keys)
