"""Readers and writers over small files, and streams against batch results."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tinctura.plans import files
from tinctura.sources import readers as R, writers as W
from tinctura.streaming import streams as T


def test_chats(spark, tmp_path, rows):
    m = lambda user, assistant: json.dumps({"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": user}, {"role": "assistant", "content": assistant}]})
    lines = [m("Fire + Water", '{"result": "Steam", "emoji": "💨"}'), m("a + b", "plain"), m("a + b + c", "x"), m("a + ", "x"), "{broken", "", m("c + d", '{"result": "x", "emoji": null}'), m("e + f", '{"result": 5}'), m("g + h", '["x"]'), m("i + j", '{"result": " x "}'), m("k + l", '{"emoji": "💨"}')]
    (tmp_path / "train.jsonl").write_text("\n".join(lines))
    got = rows(R.chats(spark, str(tmp_path)))
    assert got == [("Fire", "Water", "Steam", "💨", "chat_train"), ("a", "b", "plain", None, "chat_train"), ("c", "d", '{"result": "x", "emoji": null}', None, "chat_train"), ("e", "f", '{"result": 5}', None, "chat_train"), ("g", "h", '["x"]', None, "chat_train"), ("i", "j", "x", "", "chat_train")]


def test_chat_lines(spark, tmp_path, rows):
    """What the format must carry; only what it can't tell apart or has no place for is left out."""
    odd = ['say "hi"', "back\\slash", "line\nbreak\r\u2028end", "crème brûlée", "a-b'c 42", "zero\u200bwidth", "火", "tab\there", "a+b", '{"result": null}', "\\\"result\\\": null", "🏴\u200d☠️", "}{", "null"]
    kept = [(a, b, c, "💨") for a, b, c in zip(odd, odd[1:] + odd[:1], odd[2:] + odd[:2], strict=True)]
    out = [("x + y", "z", "w", "💨"), ("x", "y", "  ", "💨"), ("x", "y", "z", None), (None, "y", "z", "💨"), ("x +", "y", "z", "💨")]
    spark.createDataFrame([*kept, *out, (" x ", "y\u00a0", "\tz", "💨 ")], "input_a string, input_b string, output string, emoji_output string").write.parquet(str(tmp_path / "recipe_observations.parquet"))
    assert rows(files.chat_lines(spark, str(tmp_path))) == sorted([*kept, ("x", "y", "z", "💨")], key=repr)


def test_csv(spark, tmp_path, rows):
    (tmp_path / "r.csv").write_text('# comment\n\nfire+water,steam\na+b+c,x\nalone\n"x + y","z, w"\n')
    assert rows(R.csv_recipes(spark, str(tmp_path)), "input_a", "input_b", "output") == [("fire", "water", "steam"), ("x", "y", "z, w")]


def test_packed(spark, tmp_path, rows):
    (tmp_path / "d.json").write_text(json.dumps({"index": {"0": ["🔥", "Fire", 1], "1": ["💧", "Water", 1], "2": ["💨", "Steam", 2]}, "data": "0,1,2;0,9,2;0,1;;1,0,2"}))
    assert rows(R.packed_index(spark, str(tmp_path)), "input_a", "input_b", "output", "emoji_output") == [("Fire", "Water", "Steam", "💨"), ("Water", "Fire", "Steam", "💨")]
    (tmp_path / "d.json").write_text(json.dumps({"index": {"0": ["🔥", "Fire"], "1": ["💧", "Water"], "64": ["💨", "Steam"]}, "data": "A,B,BA"}))
    assert rows(R.packed_index(spark, str(tmp_path), decode=True), "output") == [("Steam",)]


def test_id_files(spark, tmp_path, rows):
    (tmp_path / "one.json").write_text(json.dumps({"names": {"1": "big_fire", "2": "water", "x": "steam"}, "recipes": [{"ingredients": [1, "2"], "results": ["x", 2]}, {"ingredients": [1], "results": [2]}, {"ingredients": [1, 7], "results": [2]}]}, indent=1))
    assert rows(R.id_files(spark, str(tmp_path)), "input_a", "input_b", "output", "source") == [("big fire", "water", "steam", "idmap_one"), ("big fire", "water", "water", "idmap_one")]


def test_json_lines(spark, tmp_path, rows):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n{oops\n{"a": 2, "more": 3}\n')
    assert rows(R.json_lines(spark, str(tmp_path), "a int")) == [(1,), (2,)]
    assert [r.value for r in R.broken_lines(spark, str(tmp_path), "a int").collect()] == ["{oops"]
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        R.json_lines(spark, str(tmp_path), "a int", strict=True).collect()


def test_word_vectors(spark, tmp_path):
    (tmp_path / "v.txt").write_text("3 2\nfire 1 0\nWater 0 2\nsteam 1 1\nsteam 3 4\n")
    got = {r.word: r.vector for r in R.word_vectors(spark, str(tmp_path / "v.txt")).collect()}
    assert got == {"fire": [1.0, 0.0], "water": [0.0, 1.0], "steam": [pytest.approx(0.6), pytest.approx(0.8)]}


def test_logs_and_replies(spark, tmp_path):
    assert R.loss_log(spark, str(tmp_path / "none.jsonl")).count() == 0
    (tmp_path / "r.jsonl").write_text(json.dumps({"response": {"candidates": [{"content": {"parts": [{"inline": 1}, {"text": "hi"}]}}]}}) + "\n{}\n")
    assert [r.text for r in R.batch_replies(spark, str(tmp_path / "r.jsonl")).orderBy("position").collect()] == ["hi", None]
    f = R.fingerprints(spark, str(tmp_path / "r.jsonl")).first()
    assert f.lines == 2 and len(f.sha256) == 64


def test_writers(spark, tmp_path, rows):
    df = spark.createDataFrame([(1, "train", "é"), (2, "test", None)], "id int, split string, t string")
    W.write_splits(df, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s/split=train")).count() == 1
    assert W.append_new(df, str(tmp_path / "a"), ["id"], spark) == 2 and W.append_new(df, str(tmp_path / "a"), ["id"], spark) == 0
    W.write_with_rejects(df, "t is not null", str(tmp_path / "g"), str(tmp_path / "b"))
    assert spark.read.parquet(str(tmp_path / "g")).count() == 1
    assert rows(W.upserted(df, df.limit(1).withColumn("t", F.lit("new")), ["id"]), "id", "t") == [(1, "new"), (2, None)]
    W.swap(spark.read.parquet(str(tmp_path / "a")).filter("id = 1"), str(tmp_path / "a"), spark)
    assert spark.read.parquet(str(tmp_path / "a")).count() == 1
    assert [W.sized_name("eval", n) for n in (None, 1000, 250)] == ["eval_all", "eval_1k", "eval_250"]


def test_streams(spark, tmp_path, rows):
    hits = spark.createDataFrame([(i, "k", 1_700_000_040 + 60 * (i // 3)) for i in range(7)], "event_id long, key string, s long").select("event_id", "key", F.timestamp_seconds("s").alias("ts"))
    hits.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = T.latest(T.drained(T.window_counter(T.file_stream(spark, str(tmp_path / "in")), ["key"], "ts", 60, "1 day"), "update"), ["key", "window_start"])
    assert sorted(r.hits for r in out.collect()) == [1, 3, 3]
    assert T.drained(T.once(T.file_stream(spark, str(tmp_path / "in")), "event_id", "ts"), "append").count() == 7
    grow = lambda: T.resumed(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"), lambda x: x.filter("event_id % 2 = 0"))
    assert grow() == 4 and grow() == 4
    hits.withColumn("event_id", F.col("event_id") + 100).write.mode("append").parquet(str(tmp_path / "in"))
    assert grow() == 8


def test_store(spark, tmp_path, rows):
    for name in ("a/x.jsonl", "a/skip/y.jsonl", "b/z.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(f'{{"n": "{name}"}}\n')
    assert rows(R.store(spark, str(tmp_path), "n string", without=("skip",))) == [("a/x.jsonl",)]


def test_packed_documents_on_lines(spark, tmp_path, rows):
    """Many documents in one file, each with its own ids, and a file with a fault."""
    one = lambda n: json.dumps({"index": {"0": ["🔥", f"Fire{n}"], "1": ["💧", "Water"], "2": ["💨", "Steam"]}, "data": "0,1,2"})
    (tmp_path / "d.json").write_text("\n".join([one(1), "", one(2), "{broken"]))
    assert rows(R.packed_index(spark, str(tmp_path)), "input_a", "output") == [("Fire1", "Steam"), ("Fire2", "Steam")]


def test_swap_keeps_one_table(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    W.swap(spark.read.parquet(path).filter("id > 0"), path, spark)
    assert spark.read.parquet(path).count() == 2 and sorted(p.name for p in tmp_path.iterdir()) == ["t"]
    W.swap(spark.range(5), str(tmp_path / "new"), spark)
    assert spark.read.parquet(str(tmp_path / "new")).count() == 5


def test_refreshed(spark):
    now, loaded = [0.0], []

    def load():
        loaded.append(now[0])
        return spark.range(0 if now[0] < 5 else 3)

    kept = T.Refreshed(load, 300, lambda: now[0])
    assert kept.get().count() == kept.get().count() == 0 and len(loaded) == 2  # an empty table isn't kept
    now[0] = 10.0
    assert kept.get().count() == kept.get().count() == 3 and len(loaded) == 3
    now[0] = 311.0
    assert kept.get().count() == 3 and len(loaded) == 4
