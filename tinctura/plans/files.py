"""Queries that write the raw formats from the tables and read them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tinctura.plans.base import Plans, strip
from tinctura.sources import readers as R, writers as W
from tinctura.storage import folder, table
from tinctura.streaming.streams import resumed

plans = Plans()
queries, oracle_sql = plans.queries, plans.oracle_sql


def _chatted(spark: SparkSession, o: DataFrame) -> DataFrame:
    m = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    said = F.to_json(F.struct(F.col("output").alias("result"), F.col("emoji_output").alias("emoji")))
    rows = o.select(F.array(m("system", F.lit("Combine.")), m("user", F.concat_ws(" + ", "input_a", "input_b")), m("assistant", said)).alias("messages"))
    W.write_lines(rows, path := folder(spark, "chats"))
    return R.chats(spark, path).select("input_a", "input_b", "output", "emoji_output")


@plans.add(f"SELECT {strip('input_a')} AS input_a, {strip('input_b')} AS input_b, {strip('output')} AS output, {strip('emoji_output')} AS emoji_output FROM recipe_observations WHERE string_split(input_a || ' + ' || input_b, ' + ') = [input_a, input_b] AND emoji_output IS NOT NULL AND {strip('input_a')} <> '' AND {strip('input_b')} <> '' AND {strip('output')} <> ''")
def chat_lines(spark: SparkSession, d: str) -> DataFrame:
    """All observations as chats and back, but those whose inputs the chat's `` + `` can't tell apart."""
    o = table(spark, d, "recipe_observations").filter("output is not null and emoji_output is not null")
    return _chatted(spark, o.filter(F.split(F.concat("input_a", F.lit(" + "), "input_b"), r" \+ ") == F.array("input_a", "input_b")))


@plans.add("SELECT input_a, input_b, canonical_output AS output FROM recipe_canonical_v0")
def csv_recipes(spark: SparkSession, d: str) -> DataFrame:
    """Canonical pairs as CSV and back."""
    c = table(spark, d, "recipe_canonical_v0")
    c.select(F.concat_ws("+", "input_a", "input_b").alias("p"), "canonical_output").write.csv(path := folder(spark, "csv"))
    return R.csv_recipes(spark, path).select("input_a", "input_b", "output")


@plans.add("SELECT input_a, input_b, canonical_output AS output FROM recipe_canonical_v0")
def packed_index(spark: SparkSession, d: str) -> DataFrame:
    """All canonical recipes in packed documents of a thousand each, ids of a document looked up three times."""
    rows = table(spark, d, "recipe_canonical_v0").select(F.floor(F.col("row_id") / 1000).alias("doc"), (F.col("row_id") % 1000 * 3).alias("at"), "input_a", "input_b", "canonical_output")
    names = [F.struct((F.col("at") + i).cast("string").alias("id"), F.array(F.lit("⭐"), c, F.lit("1")).alias("v")) for i, c in enumerate(("input_a", "input_b", "canonical_output"))]
    line = F.concat_ws(",", "at", F.col("at") + 1, F.col("at") + 2)
    docs = rows.groupBy("doc").agg(F.map_from_entries(F.flatten(F.collect_list(F.array(*names)))).alias("index"), F.array_join(F.collect_list(line), ";").alias("data"))
    docs.select("index", "data").write.json(path := folder(spark, "packed"))
    return R.packed_index(spark, path).select("input_a", "input_b", "output")


@plans.add("SELECT replace(input_a, '_', ' ') AS input_a, replace(input_b, '_', ' ') AS input_b, replace(canonical_output, '_', ' ') AS output FROM recipe_canonical_v0")
def id_files(spark: SparkSession, d: str) -> DataFrame:
    """All canonical recipes in documents of names and recipes by id, a thousand recipes each."""
    rows = table(spark, d, "recipe_canonical_v0").select(F.floor(F.col("row_id") / 1000).alias("doc"), (F.col("row_id") % 1000 * 3).alias("at"), "input_a", "input_b", "canonical_output")
    names = [F.struct((F.col("at") + i).cast("string").alias("id"), F.col(c).alias("name")) for i, c in enumerate(("input_a", "input_b", "canonical_output"))]
    recipe = F.struct(F.array(F.col("at"), F.col("at") + 1).alias("ingredients"), F.array(F.col("at") + 2).alias("results"))
    docs = rows.groupBy("doc").agg(F.map_from_entries(F.flatten(F.collect_list(F.array(*names)))).alias("names"), F.collect_list(recipe).alias("recipes"))
    docs.select("names", "recipes").write.json(path := folder(spark, "ids"))
    return R.id_files(spark, path).select("input_a", "input_b", "output")


@plans.add("SELECT 'w' || vec_id AS word, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) > 0 AS known, CAST(len(embedding) AS INTEGER) AS dims FROM embeddings")
def word_vectors(spark: SparkSession, d: str) -> DataFrame:
    """S9."""
    e = table(spark, d, "embeddings")
    e.select(F.concat_ws(" ", F.concat(F.lit("w"), "vec_id"), F.array_join(F.col("embedding").cast("array<string>"), " "))).write.text(path := folder(spark, "vectors"))
    rows = R.word_vectors(spark, path)
    return rows.select("word", F.exists("vector", lambda v: v != 0).alias("known"), F.size("vector").alias("dims"))


@plans.add("SELECT split, row_id FROM recipe_canonical_v0")
def split_folders(spark: SparkSession, d: str) -> DataFrame:
    """A folder per split, read with partition pruning."""
    W.write_splits(table(spark, d, "recipe_canonical_v0").select("row_id", "split"), path := folder(spark, "splits"))
    return spark.read.parquet(path).select("split", "row_id")


@plans.add("SELECT c_custkey, c_acctbal + CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS balance FROM customer UNION ALL SELECT c_custkey + 10000000, c_acctbal FROM customer WHERE c_custkey % 5 = 0")
def upserted(spark: SparkSession, d: str) -> DataFrame:
    """K7, K8: rows replaced by key, new ones added."""
    c = table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("balance"))
    new = c.filter("c_custkey % 3 = 0").withColumn("balance", F.col("balance") + 1).unionByName(c.filter("c_custkey % 5 = 0").withColumn("c_custkey", F.col("c_custkey") + 10_000_000))
    return W.upserted(c, new, ["c_custkey"])


@plans.add("SELECT o_custkey, min(o_totalprice) AS o_totalprice FROM orders GROUP BY 1")
def improved_scores(spark: SparkSession, d: str) -> DataFrame:
    """K9: late rows replace earlier ones only if they are better."""
    o = table(spark, d, "orders").select("o_custkey", "o_totalprice", "o_orderdate", "o_orderkey")
    old, new = o.filter("o_orderkey % 2 = 0"), o.filter("o_orderkey % 2 = 1")
    return W.improved(old, new, ["o_custkey"], "o_totalprice", "o_orderkey").select("o_custkey", "o_totalprice")


@plans.add("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey % 10 <> 0")
def cascade_deleted(spark: SparkSession, d: str) -> DataFrame:
    """K10, K11."""
    gone = table(spark, d, "customer").filter("c_custkey % 10 = 0").select(F.col("c_custkey").alias("o_custkey"))
    parents = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"))
    return W.without(parents, table(spark, d, "orders").select("o_orderkey", "o_custkey"), gone, "o_custkey")[1]


@plans.add("SELECT count(*) AS n FROM recipe_canonical_v0")
def appended(spark: SparkSession, d: str) -> DataFrame:
    """K3: rows appended twice are there once."""
    c, path = table(spark, d, "recipe_canonical_v0").select("row_id", "pair_key"), folder(spark, "append")
    W.append_new(c.filter("row_id % 3 = 0"), path, ["row_id"], spark)
    W.append_new(c, path, ["row_id"], spark)
    return spark.read.parquet(path).agg(F.count("*").alias("n"))


@plans.add("SELECT l_partkey AS a, l_suppkey AS b, l_orderkey AS c FROM lineitem WHERE l_partkey % 2 = 0 AND l_suppkey % 2 = 0 AND l_partkey IN (SELECT p_partkey FROM part) AND l_suppkey IN (SELECT p_partkey FROM part)")
def dump_with_icons(spark: SparkSession, d: str) -> DataFrame:
    """S17, F20."""
    table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey").write.csv(path := folder(spark, "dump"))
    icons = table(spark, d, "part").filter("p_partkey % 2 = 0").select(F.col("p_partkey").cast("string").alias("name"))
    return R.dump(spark, path, icons).select(*[F.col(c).cast("long").alias(c) for c in "abc"])


@plans.add("SELECT prediction_id, model FROM predictions")
def tolerant_lines(spark: SparkSession, d: str) -> DataFrame:
    """A file of which every seventh line is broken and every fifth is followed by a blank one, broken lines left out."""
    return R.json_lines(spark, _broken(spark, d), "prediction_id long, model string")


@plans.add("""SELECT prediction_id, '{"prediction_id": ' || prediction_id || ', "model' AS value FROM predictions WHERE prediction_id % 7 = 0""")
def broken_lines(spark: SparkSession, d: str) -> DataFrame:
    """The lines that a strict reader would stop at."""
    bad = R.broken_lines(spark, _broken(spark, d), "prediction_id long, model string")
    return bad.select(F.regexp_extract("value", r"(\d+)", 1).cast("long").alias("prediction_id"), "value")


def _broken(spark: SparkSession, d: str) -> str:
    n = F.col("prediction_id")
    whole = F.to_json(F.struct("prediction_id", "model"))
    lines = F.array(whole, F.when(n % 7 == 0, F.concat(F.lit('{"prediction_id": '), n, F.lit(', "model'))), F.when(n % 5 == 0, "  "))
    table(spark, d, "predictions").select(F.explode(F.array_compact(lines)).alias("value")).write.text(path := folder(spark, "broken"))
    return path


@plans.add("SELECT event_id AS step, value AS loss FROM events", fractions="loss")
def loss_logs(spark: SparkSession, d: str) -> DataFrame:
    """A log appended to in two turns, with other columns; a missing one adds nothing."""
    e, path = table(spark, d, "events").select(F.col("event_id").alias("step"), F.col("value").alias("loss"), "event_type"), folder(spark, "log")
    W.append_log(e.filter("step % 2 = 0"), path)
    W.append_log(e.filter("step % 2 = 1"), path)
    return R.loss_log(spark, path).unionByName(R.loss_log(spark, folder(spark, "none")))


@plans.add("""SELECT sha256(string_agg('{"event_id":' || event_id || ',"event_type":"' || event_type || '"}' || chr(10), '' ORDER BY event_id)) AS sha256, CAST(sum(length(event_id || '') + length(event_type) + 30) AS BIGINT) AS bytes, CAST(count(*) AS INTEGER) AS lines FROM events GROUP BY event_type""")
def file_prints(spark: SparkSession, d: str) -> DataFrame:
    """A log for each event type, one file each, columns in the order of their names."""
    path = folder(spark, "prints")
    rows = table(spark, d, "events").select("event_type", F.to_json(F.struct("event_id", "event_type")).alias("value"), "event_id")
    rows.repartition("event_type").sortWithinPartitions("event_type", "event_id").select("value", F.col("event_type").alias("kind")).write.partitionBy("kind").text(path)
    return R.fingerprints(spark, f"{path}/*/*").select("sha256", "bytes", "lines")


@plans.add("""SELECT obs_id, coalesce(output <> '', false) AS good FROM recipe_observations""")
def rejects_written(spark: SparkSession, d: str) -> DataFrame:
    """K4: rows with an output to one place, all others to another."""
    good, bad = folder(spark, "good"), folder(spark, "bad")
    W.write_with_rejects(table(spark, d, "recipe_observations").select("obs_id", "output"), "output <> ''", good, bad)
    rows = spark.read.parquet(good).select("obs_id", F.lit(True).alias("good"))
    return rows.unionByName(R.json_lines(spark, bad, "obs_id long").select("obs_id", F.lit(False).alias("good")))


@plans.add("SELECT split, count(*) AS pairs FROM recipe_canonical_v0 GROUP BY 1")
def report_written(spark: SparkSession, d: str) -> DataFrame:
    """K5: a report as one file of JSON lines."""
    W.write_report(table(spark, d, "recipe_canonical_v0").groupBy("split").agg(F.count("*").alias("pairs")), path := folder(spark, "report"))
    return R.json_lines(spark, path, "split string, pairs long", strict=True)


@plans.add("""SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey % 4 <> 0 UNION ALL SELECT o_orderkey, 1, o_totalprice FROM orders WHERE o_orderkey % 4 = 0 AND o_orderkey IN (SELECT l_orderkey FROM lineitem)
    UNION ALL SELECT o_orderkey, 2, 0 FROM orders WHERE o_orderkey % 4 = 0 AND o_orderkey IN (SELECT l_orderkey FROM lineitem)""", fractions="l_quantity")
def replaced_children(spark: SparkSession, d: str) -> DataFrame:
    """The lines of every fourth order replaced by two others, in place: read, written beside, and swapped in."""
    old, path = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), folder(spark, "children")
    kept = table(spark, d, "orders").filter("o_orderkey % 4 = 0").join(old.select(F.col("l_orderkey").alias("o_orderkey")).distinct(), "o_orderkey", "left_semi")
    lines = F.explode(F.array(F.struct(F.lit(1).alias("l_linenumber"), F.col("o_totalprice").alias("l_quantity")), F.struct(F.lit(2).alias("l_linenumber"), F.lit(0.0).alias("l_quantity"))))
    old.write.parquet(path)
    there = spark.read.schema(old.schema).parquet(path)
    W.swap(W.replaced_children(there, kept.select(F.col("o_orderkey").alias("l_orderkey"), lines.alias("x")).select("l_orderkey", "x.*"), "l_orderkey"), path, spark)
    return spark.read.schema(old.schema).parquet(path)


@plans.add("SELECT row_id, count(*) AS n FROM recipe_canonical_v0 GROUP BY 1")
def resumed_rows(spark: SparkSession, d: str) -> DataFrame:
    """T5: rows that come in two turns, each processed once; a third turn without files adds nothing."""
    c, base = table(spark, d, "recipe_canonical_v0").select("row_id", "split"), folder(spark, "resumed")
    for part in ("row_id % 2 = 0", "row_id % 2 = 1", None):
        if part:
            c.filter(part).write.mode("append").parquet(f"{base}/in")
        resumed(spark, f"{base}/in", f"{base}/out", f"{base}/checkpoint", lambda s: s.select("row_id"))
    return spark.read.parquet(f"{base}/out").groupBy("row_id").agg(F.count("*").alias("n"))
