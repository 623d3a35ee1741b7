"""Problem 7: texts packed into containers of fixed capacity with little unused space.

Texts are measured in tokens of a public tokenizer. Dynamic programming over the global histogram of lengths chooses
bucket boundaries that minimise padding; batches that keep the token budget are planned over the buckets' sizes and
numbers alone, and items take their places by their rank in the bucket. So only histograms reach the driver.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tinctura.storage import materialize, spread

#: A public tokenizer's ranks, and the pattern its words are split by.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmtl]|ve|re|ll)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Length buckets of a window at most: up to this capacity each length has its own and nothing is padded. Rows a rank is
#: counted within.
BUCKETS, RANKED_ROWS = 4096, 100_000


def token_counts(documents: DataFrame, *, ranks: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """``doc_id, n_tokens`` of every row; null and empty texts have none. Special tokens' strings are ordinary text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, shared.value.splitlines())}
        own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        for batch in batches:
            sizes = [len(own.encode_ordinary(t)) if t else 0 for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64())], ["doc_id", "n_tokens"])

    with open(ranks, "rb") as file:  # read by the driver, so that no other machine needs it
        shared = documents.sparkSession.sparkContext.broadcast(file.read())
    return spread(documents.select("doc_id", "text")).mapInArrow(run, "doc_id long, n_tokens long")


def boundaries(histogram: dict[int, int], buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` length buckets with the least total padding, by dynamic programming.

    With c(i) items of t(i) tokens up to the i-th size s(i), a bucket (i, j] pads (c(j) - c(i)) s(j) - (t(j) - t(i)).
    So the best last cut before j is the lowest of the lines best(i) + t(i) - c(i) x at x = s(j); their slopes fall
    and x grows, so each bucket more takes one pass over the sizes.
    """
    sizes = sorted(histogram)
    n = len(sizes)
    if n <= buckets:
        return sizes
    count, total = [], []
    c = t = 0
    for s in sizes:
        c, t = c + histogram[s], t + histogram[s] * s
        count.append(c)
        total.append(t)
    best, cuts = [count[j] * sizes[j] - total[j] for j in range(n)], []
    for _ in range(1, buckets):
        new, cut = best[:], [-1] * n
        lines: list[tuple[int, int, int]] = []  # slope, height at 0, cut; of use from left to right
        at = 0
        for j in range(1, n):
            slope, height = -count[j - 1], best[j - 1] + total[j - 1]
            while len(lines) - at > 1:
                (m1, h1, _), (m2, h2, _) = lines[-2], lines[-1]
                if (height - h1) * (m1 - m2) > (h2 - h1) * (m1 - slope):
                    break
                lines.pop()
            lines.append((slope, height, j - 1))
            x = sizes[j]
            while len(lines) - at > 1 and lines[at + 1][0] * x + lines[at + 1][1] <= lines[at][0] * x + lines[at][1]:
                at += 1
            padded = count[j] * x - total[j] + lines[at][0] * x + lines[at][1]
            if padded < new[j]:
                new[j], cut[j] = padded, lines[at][2]
        best = new
        cuts.append(cut)
    out, j = [sizes[-1]], n - 1
    for cut in reversed(cuts):
        if (j := cut[j]) < 0:
            break
        out.append(sizes[j])
    return sorted(out)


def batches(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """``(containers, {bound: items in each})`` that hold all items, each container within ``capacity``.

    Each step opens containers for the largest size left and fills them with the sizes that leave the least unused
    (the largest subset sum), as often as the numbers allow.
    """
    left = {s: n for s, n in counts.items() if n}
    plan = []
    while left:
        first = max(left)
        room = capacity - first
        reach = np.full(room + 1, -1, np.int64)  # the last size added on the way to each sum
        reach[0] = 0
        for s in sorted((s for s in left if s <= room), reverse=True):
            have = left[s] - (s == first)
            sums = np.flatnonzero(reach >= 0)
            for _ in range(min(have, room // s)):
                sums = sums[sums + s <= room] + s
                sums = sums[reach[sums] < 0]
                if not len(sums):
                    break
                reach[sums] = s
            if reach[room] >= 0:
                break  # full to the last token
        at, held = int(np.flatnonzero(reach >= 0)[-1]), {first: 1}
        while at:
            s = int(reach[at])
            held[s] = held.get(s, 0) + 1
            at -= s
        times = min(left[s] // k for s, k in held.items())
        plan.append((times, held))
        for s, k in held.items():
            left[s] -= times * k
            if not left[s]:
                del left[s]
    return plan


def packed(documents: DataFrame, windows: DataFrame, *, buckets: int = BUCKETS, ranks: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """``window_name, container_id, doc_id, piece, start_token, n_tokens``: every text in containers of each capacity.

    A text is split, into pieces of the whole capacity and a rest, only if it alone exceeds the capacity. Texts
    without tokens (null or empty) take no room: container_id is null. Repeated rows are packed each. Windows without
    a capacity of one token or more are left out; a repeated window_name counts once, with its largest capacity. An
    empty table of either kind gives none. Further columns don't matter.
    """
    spark = documents.sparkSession
    sized = materialize(token_counts(documents, ranks=ranks, pattern=pattern).withColumn("row", F.monotonically_increasing_id()), "tokens")
    named = windows.filter("window_name is not null and capacity_tokens > 0").groupBy("window_name").agg(F.max("capacity_tokens").cast("long").alias("capacity"))
    known = {r["window_name"]: r["capacity"] for r in named.collect()}  # a row per window
    each = sized.withColumn("w", F.explode(F.array([F.struct(F.lit(k).alias("window_name"), F.lit(c).cast("long").alias("capacity")) for k, c in sorted(known.items())] or [F.lit(None).cast("struct<window_name:string,capacity:long>")]))).select("*", "w.*").drop("w").filter("capacity is not null")
    pieces = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n_tokens") / F.col("capacity")) - 1, F.lit(0)).cast("int")))
    items = each.withColumn("piece", pieces).withColumn("start_token", F.col("piece") * F.col("capacity"))
    items = items.withColumn("size", F.least(F.col("capacity"), F.col("n_tokens") - F.col("start_token")))
    lengths = items.filter("size > 0").groupBy("window_name", "size").count().collect()  # at most the capacity's rows a window
    bound_rows, slots = [], []
    for name, capacity in known.items():
        histogram = {r["size"]: r["count"] for r in lengths if r["window_name"] == name}
        if not histogram:
            continue
        bounds = boundaries(histogram, buckets)
        counts = dict.fromkeys(bounds, 0)
        for s, n in histogram.items():
            b = bounds[int(np.searchsorted(bounds, s))]
            counts[b] += n
            bound_rows.append((name, s, b))
        base, taken = 0, dict.fromkeys(bounds, 0)
        for times, held in batches(counts, capacity):
            for s, k in held.items():
                slots.append((name, s, taken[s], k, base))
                taken[s] += times * k
            base += times
    bucket = spark.createDataFrame(bound_rows, "window_name string, size long, bucket long")
    places = spark.createDataFrame(slots, "window_name string, bucket long, from_rank long, per_container long, first_container long")
    places = places.groupBy("window_name", "bucket").agg(F.array_sort(F.collect_list(F.struct("from_rank", "per_container", "first_container"))).alias("places"))
    rows = max(1, sized.count())
    parts = max(1, -(-rows // RANKED_ROWS))
    placed = items.filter("size > 0").join(F.broadcast(bucket), ["window_name", "size"]).withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int"))
    within = placed.withColumn("rank", F.row_number().over(Window.partitionBy("window_name", "bucket", "part").orderBy("row", "piece")) - 1)
    tally = placed.groupBy("window_name", "bucket", "part").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("window_name", "bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = within.join(tally.select("window_name", "bucket", "part", before.alias("before")), ["window_name", "bucket", "part"]).withColumn("rank", F.col("rank") + F.col("before"))
    slot = F.element_at(F.filter("places", lambda p: p["from_rank"] <= F.col("rank")), -1)
    out = ranked.join(F.broadcast(places), ["window_name", "bucket"]).withColumn("slot", slot)
    container = F.col("slot.first_container") + F.floor((F.col("rank") - F.col("slot.from_rank")) / F.col("slot.per_container"))
    columns = ["window_name", "container_id", "doc_id", "piece", "start_token", F.col("size").alias("n_tokens")]
    none = items.filter("size = 0").withColumn("container_id", F.lit(None).cast("long")).select(*columns)
    return out.withColumn("container_id", container.cast("long")).select(*columns).unionByName(none)


def packing_report(containers: DataFrame, windows: DataFrame) -> DataFrame:
    """Per window: containers, tokens, the containers that tokens alone would need, and the share of space unused."""
    used = containers.groupBy("window_name").agg(F.countDistinct("container_id").alias("containers"), F.sum("n_tokens").alias("tokens"))
    rows = used.join(F.broadcast(windows.select("window_name", "capacity_tokens")), "window_name")
    return rows.withColumn("least", F.ceil(F.col("tokens") / F.col("capacity_tokens"))).withColumn("unused", 1 - F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")))
