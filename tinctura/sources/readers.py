"""Readers (survey ids S1-S9, S12, S13, S16, S17, P29). Each gives ``input_a, input_b, output, emoji_output, source`` unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tinctura.functions.hashing import unpacked_id
from tinctura.functions.text import stripped
from tinctura.operators.skew import lookup
from tinctura.storage import materialize, measured


def file_stem() -> Column:
    """The name of a row's file without folder and extension."""
    return F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[^.]*)?$", 1)


def _complete(df: DataFrame) -> DataFrame:
    return df.filter("input_a <> '' and input_b <> '' and output <> ''").select("input_a", "input_b", "output", "emoji_output", "source")


def chats(spark: SparkSession, path: str, prefix: str = "chat") -> DataFrame:
    """JSON lines of messages; the user's ``A + B``, the assistant's JSON ``result, emoji`` or plain text.

    Of several messages of a role the last counts. Broken lines and other prompts are left out. A reply that isn't
    an object, or whose result or emoji is there but no text, is the output as a whole.
    """
    lines = spark.read.text(path).select("value", file_stem().alias("stem"))
    m = F.from_json("value", "struct<messages:array<struct<role:string,content:string>>>")["messages"]
    last = lambda role: F.get(F.reverse(F.filter(m, lambda x: x["role"] == role)), F.lit(0))["content"]
    rows = lines.select("stem", F.split(last("user"), r" \+ ").alias("p"), F.coalesce(last("assistant"), F.lit("")).alias("said")).filter(F.size("p") == 2)
    told = F.try_parse_json("said")
    field = lambda k: F.try_variant_get(told, f"$.{k}", "variant")
    texts = [F.coalesce(F.schema_of_variant(field(k)) == "STRING", F.lit(True)) for k in ("result", "emoji")]
    result, emoji = (F.try_variant_get(told, f"$.{k}", "string") for k in ("result", "emoji"))
    parsed = F.coalesce(F.schema_of_variant(told).startswith("OBJECT"), F.lit(False)) & texts[0] & texts[1]
    return _complete(rows.select(
        stripped(F.get("p", F.lit(0))).alias("input_a"), stripped(F.get("p", F.lit(1))).alias("input_b"),
        F.when(parsed, stripped(F.coalesce(result, F.lit("")))).otherwise(stripped("said")).alias("output"),
        F.when(parsed, stripped(F.coalesce(emoji, F.lit("")))).alias("emoji_output"), F.concat_ws("_", F.lit(prefix), "stem").alias("source"),
    ))


def csv_recipes(spark: SparkSession, path: str, source: str = "csv") -> DataFrame:
    """``A+B,C`` lines; comments, short lines and other numbers of inputs are left out."""
    rows = spark.read.csv(path, comment="#", schema="pair string, result string")
    p = F.split("pair", r"\+")
    return _complete(rows.filter(F.size(p) == 2).select(stripped(p[0]).alias("input_a"), stripped(p[1]).alias("input_b"), stripped("result").alias("output"), F.lit(None).cast("string").alias("emoji_output"), F.lit(source).alias("source")))


def documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents with their file's ``stem`` and ``doc``, a number; a file is one document, or one on each line.

    Files whose first line is a whole document are read by lines, so that a large dump of many documents has many
    tasks; others as one text. What isn't a document of the schema comes out null.
    """
    first = spark.read.text(path).filter(F.trim("value") != "").select(F.try_parse_json("value").isNotNull()).first()
    rows = spark.read.text(path, wholetext=not (first and first[0])).filter(F.trim("value") != "")
    return rows.select(file_stem().alias("stem"), F.monotonically_increasing_id().alias("doc"), F.from_json("value", f"struct<{schema}>").alias("d"))


def _named(rows: DataFrame, names: DataFrame, sides: dict[str, dict[str, str]], on: str) -> DataFrame:
    """Ids of a document's rows replaced by what its dictionary ``doc, id, ..`` says; rows with an unknown id go."""
    names, size = measured(names, "names")
    for side, cols in sides.items():
        rows = lookup(rows, names.select(on, F.col("id").alias(side), *[F.col(k).alias(v) for k, v in cols.items()]), [on, side], how="inner", size=size)
    return rows


def packed_index(spark: SparkSession, path: str, source: str = "packed", *, decode: bool = False) -> DataFrame:
    """``{index: {id: [emoji, name, ..]}, data: "a,b,c;.."}``; lines that aren't three known ids are left out.

    Each document has its own ids. ``decode``: ids in the data are packed in base 64, those of the index are plain numbers.
    """
    docs = materialize(documents(spark, path, "index:map<string,array<string>>,data:string"), "documents")  # numbered once
    names = docs.select("doc", F.explode("d.index").alias("id", "v")).filter(F.size("v") >= 2).select("doc", "id", stripped(F.get("v", F.lit(1))).alias("name"), F.nullif(stripped(F.get("v", F.lit(0))), F.lit("")).alias("emoji"))
    rows = docs.select("doc", F.explode(F.split("d.data", ";")).alias("line")).select("doc", F.split("line", ",").alias("p")).filter(F.size("p") == 3)
    ids = {c: (unpacked_id(F.get("p", F.lit(i))).cast("string") if decode else F.get("p", F.lit(i))) for i, c in enumerate("abc")}
    rows = rows.select("doc", *[v.alias(k) for k, v in ids.items()])
    rows = _named(rows, names, {"a": {"name": "input_a"}, "b": {"name": "input_b"}, "c": {"name": "output", "emoji": "emoji_output"}}, "doc")
    return _complete(rows.withColumn("source", F.lit(source)))


def id_files(spark: SparkSession, path: str, prefix: str = "idmap") -> DataFrame:
    """Documents ``{names: {id: name}, recipes: [{ingredients, results}]}``; ids are numbers or texts; a row per result.

    Each document has its own ids. Underscores become spaces; recipes without exactly two known ingredients are left out.
    """
    docs = materialize(documents(spark, path, "names:map<string,string>,recipes:array<struct<ingredients:array<string>,results:array<string>>>"), "documents")
    names = docs.select("doc", F.explode("d.names").alias("id", "name")).select("doc", "id", stripped(F.translate("name", "_", " ")).alias("name"))
    rows = docs.select("doc", "stem", F.explode("d.recipes").alias("r")).filter(F.size("r.ingredients") == 2).select("doc", "stem", F.get("r.ingredients", F.lit(0)).alias("a"), F.get("r.ingredients", F.lit(1)).alias("b"), F.explode("r.results").alias("c"))
    rows = _named(rows, names, {"a": {"name": "input_a"}, "b": {"name": "input_b"}, "c": {"name": "output"}}, "doc")
    return _complete(rows.select("input_a", "input_b", "output", F.lit(None).cast("string").alias("emoji_output"), F.concat_ws("_", F.lit(prefix), "stem").alias("source")))


def json_lines(spark: SparkSession, path: str, schema: str, *, strict: bool = False) -> DataFrame:
    """JSON lines; blank lines are left out, broken ones too, or, if ``strict``, they stop the job."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    rows = spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)
    return rows.filter("_corrupt_record is null").drop("_corrupt_record")


def broken_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The file and text of every line that isn't a JSON object of the schema."""
    lines = spark.read.text(path).select("_metadata.file_name", "value").filter(F.trim("value") != "")
    return lines.filter(F.from_json("value", f"struct<{_fields(schema)}, _corrupt_record:string>", {"columnNameOfCorruptRecord": "_corrupt_record"})["_corrupt_record"].isNotNull()).select(F.col("file_name").alias("file"), "value")


def _fields(schema: str) -> str:
    from pyspark.sql.types import StructType

    return StructType.fromDDL(schema).simpleString()[len("struct<") : -1]


def word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """``word, vector``, lower case and of length 1; of a repeated word the last line; a header line is skipped.

    Lines with another number of values than the most frequent one are an error.
    """
    lines = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("p"), F.monotonically_increasing_id().alias("at")).filter(F.size("p") > 2)
    values = F.transform(F.slice("p", 2, 1 << 30), lambda v: v.try_cast("double"))
    rows = lines.select(F.lower(F.get("p", F.lit(0))).alias("word"), values.alias("v"), "at")
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    unit = F.transform("v", lambda x: F.coalesce(F.try_divide(x, length), F.lit(0.0)))
    last = rows.groupBy("word").agg(F.max_by("v", "at").alias("v"))
    dims = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count")).limit(2).collect()
    if len(dims) > 1:
        raise ValueError(f"vectors of {dims[0]['d']} and of {dims[1]['d']} values in {path}")
    return last.select("word", unit.alias("vector"))


def batch_replies(spark: SparkSession, path: str) -> DataFrame:
    """``line, position, text`` of batch reply files."""
    from tinctura.operators.enrich import reply_text

    return spark.read.text(path).filter(F.trim("value") != "").select(F.col("value").alias("line"), F.monotonically_increasing_id().alias("position"), reply_text(F.col("value")).alias("text"))


def loss_log(spark: SparkSession, path: str) -> DataFrame:
    """``step, loss`` of a log of JSON lines; a missing file is an empty log."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(place):
        return spark.createDataFrame([], "step long, loss double")
    return json_lines(spark, path, "step long, loss double").filter("step is not null and loss is not null")


def dump(spark: SparkSession, path: str, icons: DataFrame) -> DataFrame:
    """Three-column recipes whose inputs both have an icon (``name``)."""
    rows = spark.read.csv(path, schema="a string, b string, c string, rest string").filter("c is not null and rest is null").drop("rest")
    known = icons.select("name").distinct()
    for side in ("a", "b"):
        rows = rows.join(known.withColumnRenamed("name", side), side, "left_semi")
    return rows.select("a", "b", "c")


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """File, sha256, bytes and line breaks of each file."""
    files = spark.read.format("binaryFile").load(path)
    text = F.decode("content", "ISO-8859-1")
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"), (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))).alias("lines"))


def database(spark: SparkSession, url: str, query: str, *, by: str | None = None, bounds: tuple[int, int] = (0, 0), parts: int = 1, **options: str) -> DataFrame:
    """Rows of a database by JDBC; in ``parts`` ranges of the numeric column ``by``, so that tasks share the load."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=f"({query}) q", **options)
    if by:
        reader = reader.options(partitionColumn=by, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts)
    return reader.load()


def store(spark: SparkSession, path: str, schema: str, *, pattern: str = "*.jsonl", without: tuple[str, ...] = ()) -> DataFrame:
    """JSON lines of all files below a folder of any store whose names match, folders ``without`` left out."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).json(path)
    for folder in without:
        rows = rows.filter(~F.col("_metadata.file_path").contains(f"/{folder}/"))
    return rows
