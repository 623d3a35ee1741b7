"""Queries over runs, rankings, windows, leaderboards, lookups and preferences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tinctura.operators import arena as A
from tinctura.plans.base import Plans, key
from tinctura.storage import table

plans = Plans()
queries, oracle_sql = plans.queries, plans.oracle_sql

_RUNS = "r AS (SELECT event_id AS run_id, event_type AS model, strftime(ts, '%Y-%m-%d') AS day, value > 250 AS won, CAST(json_extract_string(props, '$.k') AS INTEGER) AS combinations, CAST(user_id % 20 + 1 AS INTEGER) AS depth FROM events)"
_DAILY = f"""{_RUNS}, dly AS (SELECT model, day, count(*) AS runs, count(*) FILTER (won) AS wins, avg(CASE WHEN won THEN 1.0 ELSE 0.0 END) AS win_rate, avg(CAST(combinations AS DOUBLE)) FILTER (won) AS avg_combinations FROM r GROUP BY 1, 2)"""


def _runs(spark: SparkSession, d: str) -> DataFrame:
    return A.runs(table(spark, d, "events"))


@plans.add(f"WITH {_DAILY} SELECT * FROM dly", fractions="win_rate avg_combinations")
def daily_standings(spark: SparkSession, d: str) -> DataFrame:
    """A9."""
    return A.standings(_runs(spark, d), "model", "day")


@plans.add(f"""WITH {_RUNS}, b AS (SELECT model, count(*) AS runs, count(*) FILTER (won) AS wins, avg(CASE WHEN won THEN 1.0 ELSE 0.0 END) AS win_rate, avg(CAST(combinations AS DOUBLE)) FILTER (won) AS avg_combinations FROM r WHERE depth BETWEEN 1 AND 10 GROUP BY 1)
    SELECT *, CAST(row_number() OVER (ORDER BY win_rate DESC, avg_combinations ASC NULLS LAST, model) AS INTEGER) AS place FROM b""", fractions="win_rate avg_combinations")
def ranking(spark: SparkSession, d: str) -> DataFrame:
    """A9, F11, F16, O2."""
    return A.ranked(A.standings(_runs(spark, d).filter("depth between 1 and 10"), "model"))


@plans.add(f"WITH {_RUNS} SELECT model, round(avg(combinations), 1) AS avg, count(*) AS wins FROM r WHERE won AND combinations > 60 GROUP BY 1 HAVING avg(combinations) IS NOT NULL", fractions="avg")
def efficiency(spark: SparkSession, d: str) -> DataFrame:
    """F21."""
    return A.efficiency(A.standings(_runs(spark, d).filter("not won or combinations > 60"), "model"))


@plans.add(f"""WITH {_DAILY} SELECT model, avg(win_rate) AS score, count(DISTINCT day) AS days, CAST(sum(runs) AS BIGINT) AS runs, CAST(sum(wins) AS BIGINT) AS wins, sum(avg_combinations * wins) FILTER (avg_combinations IS NOT NULL) / nullif(sum(wins) FILTER (avg_combinations IS NOT NULL), 0) AS avg_combinations FROM dly GROUP BY 1""", fractions="score avg_combinations")
def overall_board(spark: SparkSession, d: str) -> DataFrame:
    """A11, O3."""
    return A.overall(A.standings(_runs(spark, d), "model", "day"))


@plans.add(f"WITH {_DAILY} SELECT day, max(win_rate) FILTER (model = 'click') AS click, max(win_rate) FILTER (model = 'view') AS \"view\", max(win_rate) FILTER (model = 'purchase') AS purchase FROM dly GROUP BY 1", fractions="click view purchase")
def day_grid(spark: SparkSession, d: str) -> DataFrame:
    """J19."""
    return A.day_grid(A.standings(_runs(spark, d), "model", "day"), ["click", "view", "purchase"])


@plans.add(f"WITH {_DAILY} SELECT *, win_rate - lag(win_rate) OVER w AS change, max(win_rate) OVER (PARTITION BY model ORDER BY day ROWS UNBOUNDED PRECEDING) AS best FROM dly WINDOW w AS (PARTITION BY model ORDER BY day)", fractions="win_rate avg_combinations change best")
def daily_trend(spark: SparkSession, d: str) -> DataFrame:
    """The windows of 2.7: change from day to day, best so far."""
    return A.trend(A.standings(_runs(spark, d), "model", "day"))


@plans.add(f"WITH {_DAILY} SELECT DISTINCT day FROM dly WHERE regexp_matches(day, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') AND day <= '2024-01-20'")
def run_days(spark: SparkSession, d: str) -> DataFrame:
    """F12, O15."""
    return _runs(spark, d).filter(F.col("day").rlike(r"^\d{4}-\d{2}-\d{2}$") & (F.col("day") <= "2024-01-20")).select("day").distinct()


@plans.add(f"WITH {_RUNS} SELECT * FROM r ORDER BY day DESC, run_id DESC LIMIT 30")
def recent_runs(spark: SparkSession, d: str) -> DataFrame:
    """A top-k report."""
    return A.top(_runs(spark, d), 30, F.desc("day"), F.desc("run_id"))


@plans.add(f"WITH {_RUNS} SELECT run_id FROM r WHERE depth >= 3 AND (depth - 3) % 5 = 0")
def asked_rounds(spark: SparkSession, d: str) -> DataFrame:
    """F14."""
    return _runs(spark, d).filter(A.asked("depth")).select("run_id")


_BEST = "b AS (SELECT o_orderpriority AS goal, o_custkey AS user_id, unnest(list(struct_pack(s := o_totalprice, t := o_orderdate, k := o_orderkey) ORDER BY o_totalprice, o_orderdate, o_orderkey)[1:1]) AS x FROM orders GROUP BY 1, 2), f AS (SELECT goal, user_id, x.s AS o_totalprice, x.t AS o_orderdate, x.k AS o_orderkey FROM b)"


@plans.add(f"WITH {_BEST} SELECT * FROM f")
def best_scores(spark: SparkSession, d: str) -> DataFrame:
    """A10, K9."""
    rows = table(spark, d, "orders").select(F.col("o_orderpriority").alias("goal"), F.col("o_custkey").alias("user_id"), "o_totalprice", "o_orderdate", "o_orderkey")
    return A.best_scores(rows, ["goal", "user_id"], "o_totalprice", "o_orderdate", "o_orderkey")


@plans.add(f"WITH {_BEST} SELECT * FROM f WHERE goal = '1-URGENT' ORDER BY o_totalprice, o_orderdate, o_orderkey LIMIT 20")
def leaderboard(spark: SparkSession, d: str) -> DataFrame:
    """O1: a top-k report."""
    return A.top(best_scores(spark, d).filter("goal = '1-URGENT'"), 20, F.asc("o_totalprice"), F.asc("o_orderdate"), F.asc("o_orderkey"))


_STORED = """st AS (SELECT row_id, pair_id, input_a, input_b, o AS output, CAST(i AS INTEGER) AS rank, CASE WHEN row_id % 3 = 0 THEN 'final' WHEN row_id % 3 = 1 THEN 'web-generated-a' ELSE 'older' END AS dataset
    FROM (SELECT row_id, pair_id, input_a, input_b, unnest(known_outputs) AS o, unnest(range(1, len(known_outputs) + 1)) AS i FROM recipe_canonical_v0))"""


def _stored(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of the canonical pairs in three datasets, as the import makes them."""
    c = table(spark, d, "recipe_canonical_v0")
    name = F.when(F.col("row_id") % 3 == 0, "final").when(F.col("row_id") % 3 == 1, "web-generated-a").otherwise("older")
    return c.select("row_id", "pair_id", "input_a", "input_b", F.posexplode("known_outputs").alias("i", "output"), name.alias("dataset")).withColumn("rank", (F.col("i") + 1).cast("int")).drop("i")


@plans.add(f"WITH {_STORED} SELECT e.eval_id, st.output, st.rank FROM eval_records e JOIN st ON least(e.input_a, e.input_b) = st.input_a AND greatest(e.input_a, e.input_b) = st.input_b WHERE st.dataset = 'final' OR st.dataset LIKE 'web-generated%'")
def stored_candidates(spark: SparkSession, d: str) -> DataFrame:
    """J1, F15."""
    e = table(spark, d, "eval_records").select("eval_id", F.least("input_a", "input_b").alias("input_a"), F.greatest("input_a", "input_b").alias("input_b"))
    st = _stored(spark, d).filter("dataset = 'final' or dataset like 'web-generated%'")
    return e.join(st, ["input_a", "input_b"]).select("eval_id", "output", "rank")


@plans.add(f"WITH {_STORED}, u AS (SELECT input_a, input_b, output, rank, dataset FROM st UNION ALL SELECT input_a, input_b, output || ' again', rank, 'final' FROM st WHERE dataset = 'older') SELECT input_a, input_b, output, dataset FROM (SELECT *, row_number() OVER (PARTITION BY input_a, input_b ORDER BY dataset <> 'final', dataset, output) AS r FROM u WHERE rank = 1) WHERE r = 1")
def goal_pool(spark: SparkSession, d: str) -> DataFrame:
    """A8, J2."""
    st = _stored(spark, d).select("input_a", "input_b", "output", "rank", "dataset")
    more = st.filter("dataset = 'older'").withColumns({"output": F.concat("output", F.lit(" again")), "dataset": F.lit("final")})
    rows = st.unionByName(more).filter("rank = 1").select("input_a", "input_b", "output", "dataset")
    return A.distinct_on(rows, ["input_a", "input_b"], F.col("dataset") != "final", F.col("dataset"), F.col("output"))


@plans.add(f"WITH {_STORED}, u AS (SELECT input_a, input_b, output, rank, dataset FROM st UNION ALL SELECT input_a, input_b, output || ' again', rank, 'final' FROM st WHERE dataset = 'older'), b AS (SELECT *, first_value(dataset) OVER (PARTITION BY input_a, input_b ORDER BY dataset <> 'final', dataset) AS f FROM u) SELECT input_a, input_b, dataset, output, rank FROM b WHERE dataset = f")
def first_dataset(spark: SparkSession, d: str) -> DataFrame:
    """O5."""
    st = _stored(spark, d).select("input_a", "input_b", "output", "rank", "dataset")
    more = st.filter("dataset = 'older'").withColumns({"output": F.concat("output", F.lit(" again")), "dataset": F.lit("final")})
    return A.first_dataset(st.unionByName(more), "final")


@plans.add(f"""WITH {_STORED}, q AS (SELECT obs_id, {key('input_a')} AS x, {key('input_b')} AS y FROM recipe_observations WHERE input_a IS NOT NULL AND input_b IS NOT NULL)
    SELECT obs_id, s.output, s.output IS NULL AS missing FROM q LEFT JOIN (SELECT * FROM st WHERE rank = 1) s ON s.input_a = least(x, y) AND s.input_b = greatest(x, y)""")
def looked_up(spark: SparkSession, d: str) -> DataFrame:
    """D22."""
    from tinctura.functions.text import key as k

    q = table(spark, d, "recipe_observations").filter("input_a is not null and input_b is not null").select("obs_id", k("input_a").alias("x"), k("input_b").alias("y"))
    return A.looked_up(q, _stored(spark, d)).select("obs_id", "output", "missing")


@plans.add(f"""WITH {_STORED}, g AS (SELECT input_a, input_b, sampled_outputs[i] AS output, CAST(i + prediction_id * 100 AS INTEGER) AS rank FROM (SELECT input_a, input_b, prediction_id, sampled_outputs, unnest(range(1, len(sampled_outputs) + 1)) AS i FROM predictions)),
    u AS (SELECT input_a, input_b, output, CASE WHEN rank = 1 THEN 0 ELSE 2 END AS kind, rank FROM st UNION ALL SELECT input_a, input_b, output, 1, rank FROM g),
    c AS (SELECT *, lower(trim(regexp_replace(output, '[\\s\\x{{0b}}\\x{{85}}\\p{{Z}}]+', ' ', 'g'))) AS c FROM u), f AS (SELECT *, row_number() OVER (PARTITION BY input_a, input_b, c ORDER BY kind, rank, output) AS r FROM c WHERE c <> '')
    SELECT input_a, input_b, list(output ORDER BY kind, rank, output)[1:3] AS options FROM f WHERE r = 1 GROUP BY 1, 2 HAVING count(*) > 1""")
def blind_options(spark: SparkSession, d: str) -> DataFrame:
    """D23, D30."""
    p = table(spark, d, "predictions")
    g = p.select("input_a", "input_b", "prediction_id", F.posexplode("sampled_outputs").alias("i", "output")).withColumn("rank", F.col("i") + 1 + F.col("prediction_id") * 100)  # a long: ids go beyond an int
    return A.options(_stored(spark, d), g)


@plans.add("SELECT user_id, event_type, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, count(*) AS hits FROM events GROUP BY 1, 2, 3, 4")
def window_counts(spark: SparkSession, d: str) -> DataFrame:
    """A12, T1."""
    out = A.window_counts(table(spark, d, "events"), ["user_id", "event_type"], "ts", 3600)
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


@plans.add("""WITH h AS (SELECT event_id, event_type, ts, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY event_type, s // 86400 ORDER BY ts, event_id) AS nth FROM h)
    SELECT event_id, nth, nth <= 40 AS allowed, CASE WHEN nth > 40 THEN greatest(1, (s // 86400 + 1) * 86400 - s) END AS retry_after FROM n""")
def rate_limits(spark: SparkSession, d: str) -> DataFrame:
    """The limit itself is allowed."""
    return A.limited(table(spark, d, "events"), ["event_type"], "ts", 86400, 40).select("event_id", "nth", "allowed", "retry_after")


_PREFS = """p AS (SELECT event_id, user_id, event_type AS mode, list_transform(list_filter(range(1, 4), lambda i: list_position([k % 7, k % 5 + 7, k % 3 + 12], [k % 7, k % 5 + 7, k % 3 + 12][i]) = i), lambda i: [k % 7, k % 5 + 7, k % 3 + 12][i]) AS shown, ['known_recipe', 'model_generated', 'typed'][k % 3 + 1] AS source, k % 10 AS combination_index
    FROM (SELECT event_id, user_id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)), s AS (SELECT *, shown[event_id % 4 + 1] AS selected FROM p)"""


@plans.add(f"WITH {_PREFS} SELECT event_id, selected, list_filter(shown, lambda x: x <> selected) AS rejected FROM s WHERE mode IN ('click', 'purchase') AND source IN ('known_recipe', 'model_generated') AND combination_index > 0 AND len(shown) >= 2 AND list_contains(shown, selected)")
def preferences(spark: SparkSession, d: str) -> DataFrame:
    """F10, D24."""
    return A.valid_preferences(A.preference_events(table(spark, d, "events")), ("click", "purchase"), ("known_recipe", "model_generated")).select("event_id", "selected", "rejected")


@plans.add(f"WITH {_PREFS} SELECT event_id, list_transform(list_sort(list_transform(shown, lambda o: struct_pack(h := sha256(event_id || '|' || o), o := o))), lambda x: x.o)[1:2] AS two FROM s")
def drawn_options(spark: SparkSession, d: str) -> DataFrame:
    """O10."""
    return A.preference_events(table(spark, d, "events")).select("event_id", A.two_of(F.col("shown"), F.col("event_id")).alias("two"))


@plans.add("""WITH r AS (SELECT o_custkey AS owner, list(l_partkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS ids FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1), y AS (SELECT owner, unnest(ids) AS id, unnest(range(len(ids))) AS nth FROM r), x AS (SELECT owner, id, min(nth) AS nth FROM y GROUP BY 1, 2)
    SELECT owner, list(id ORDER BY nth)[1:6] AS ids FROM x WHERE id % 3 = owner % 3 GROUP BY 1""")
def picked_items(spark: SparkSession, d: str) -> DataFrame:
    """J16."""
    rows = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    asked = rows.groupBy(F.col("o_custkey").alias("owner")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_partkey"))), lambda x: x["l_partkey"]).alias("ids"))
    owned = rows.filter("l_partkey % 3 = o_custkey % 3").select(F.col("o_custkey").alias("owner"), F.col("l_partkey").alias("id")).distinct()
    return A.picked(asked, owned)


@plans.add("SELECT o_orderkey, c_name FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderdate >= TIMESTAMP '1996-01-01'")
def open_sessions(spark: SparkSession, d: str) -> DataFrame:
    """The shape of sessions with their users, those not yet over."""
    o = table(spark, d, "orders").filter("o_orderdate >= timestamp_ntz'1996-01-01'")
    return o.join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).select("o_orderkey", "c_name")
