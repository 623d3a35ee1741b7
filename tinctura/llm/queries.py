"""The queries of the training-data problems and, where SQL can express them, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tinctura.llm import answers, copies, leaks, lookalikes, overlaps, packing, stuffing, survivors, terms
from tinctura.storage import table

Query = Callable[[SparkSession, str], DataFrame]


def _observed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(spark, d, "recipe_observations"), table(spark, d, "source_trust"), table(spark, d, "emoji_reference")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return copies.hidden_copies(table(spark, d, "recipe_observations"))


def p1_collapsed(spark: SparkSession, d: str) -> DataFrame:
    return copies.collapsed(table(spark, d, "recipe_observations"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return overlaps.split_overlaps(table(spark, d, "eval_records"), table(spark, d, "recipe_canonical_v0"))


def p2_spans(spark: SparkSession, d: str) -> DataFrame:
    return overlaps.overlap_spans(table(spark, d, "eval_records"), table(spark, d, "recipe_canonical_v0"))


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return overlaps.overlap_report(table(spark, d, "eval_records"), table(spark, d, "recipe_canonical_v0"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    marked = terms.marked_terms(table(spark, d, "recipe_observations"), ["output", "input_a"])
    return marked.filter("mark is not null").select("field_name", "term", "mark")


def p3_terms(spark: SparkSession, d: str) -> DataFrame:
    return terms.marked_terms(table(spark, d, "recipe_observations"), ["output", "input_a"])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return survivors.best_rows(*_observed(spark, d))


def p4_voted(spark: SparkSession, d: str) -> DataFrame:
    return survivors.voted_values(*_observed(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    obs, _, reference = _observed(spark, d)
    return lookalikes.lookalikes(obs, reference)


def p5_emoji(spark: SparkSession, d: str) -> DataFrame:
    obs, _, reference = _observed(spark, d)
    return lookalikes.odd_emoji(obs, reference)


def p5_forms(spark: SparkSession, d: str) -> DataFrame:
    obs, _, reference = _observed(spark, d)
    return lookalikes.one_form(obs, reference)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return answers.defects(table(spark, d, "predictions"))


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.packed(table(spark, d, "documents"), table(spark, d, "context_windows"))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    windows = table(spark, d, "context_windows")
    return packing.packing_report(packing.packed(table(spark, d, "documents"), windows), windows)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_spans(spark, d).select("doc_id", "item_id").distinct()


def p8_spans(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked_passages(table(spark, d, "documents"), table(spark, d, "eval_passages"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return stuffing.stuffed(table(spark, d, "documents"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return stuffing.spam_shares(table(spark, d, "documents")).withColumn("share", F.col("spam_words") / F.col("words"))


def queries() -> dict[str, Query]:
    own = (p1_found, p1_collapsed, p2_found, p2_spans, p2_report, p3_found, p3_terms, p4_found, p4_voted, p5_found, p5_emoji, p5_forms, p6_found, p7_packed, p7_report, p8_found, p8_spans, p9_found, p9_shares)
    return {f.__name__: f for f in own}


def _key(c: str) -> str:
    return rf"regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}]', '', 'g')"


_KEYED = f"""
k AS (SELECT * FROM (SELECT *, {_key('output')} AS ko, least({_key('input_a')}, {_key('input_b')}) AS kl, greatest({_key('input_a')}, {_key('input_b')}) AS kh
      FROM recipe_observations WHERE output IS NOT NULL AND input_a IS NOT NULL AND input_b IS NOT NULL) WHERE ko <> '' AND kl <> '' AND kh <> '')"""

_EMOJI = (
    r"regexp_replace(regexp_replace({}, '[\s\p{{Z}}\p{{Cc}}\x{{ad}}\x{{34f}}\x{{61c}}\x{{115f}}\x{{1160}}\x{{17b4}}\x{{17b5}}\x{{180b}}-\x{{180f}}\x{{200b}}\x{{200c}}\x{{200e}}\x{{200f}}\x{{202a}}-\x{{202e}}"
    r"\x{{2060}}-\x{{206f}}\x{{2800}}\x{{3164}}\x{{fe00}}-\x{{fe0f}}\x{{feff}}\x{{ffa0}}]', '', 'g'), '^\x{{200d}}+|\x{{200d}}+$', '', 'g')"
)

_TERMS = r"""
t AS (SELECT 'output' AS field_name, obs_id, unnest(regexp_extract_all(lower(output), '[\p{L}\p{M}\p{N}]+')) AS term FROM recipe_observations
      UNION ALL SELECT 'input_a', obs_id, unnest(regexp_extract_all(lower(input_a), '[\p{L}\p{M}\p{N}]+')) FROM recipe_observations),
c AS (SELECT field_name, term, count(*) AS occurrences, count(DISTINCT obs_id) AS records FROM t GROUP BY 1, 2),
m AS (SELECT *, CASE WHEN records < 3 THEN 'rare' WHEN records > 0.01 * (SELECT count(*) FROM recipe_observations) THEN 'common' END AS mark FROM c)"""

_NEAR = f"""
e AS (SELECT eval_id, split, source, {_key('input_a')} AS a, {_key('input_b')} AS b, list_filter(list_transform(known_outputs, lambda x: {_key('x')}), lambda x: x <> '') AS o FROM eval_records),
r AS (SELECT row_id, {_key('input_a')} AS a, {_key('input_b')} AS b, list_filter(list_transform(known_outputs, lambda x: {_key('x')}), lambda x: x <> '') AS o FROM recipe_canonical_v0 WHERE split = 'train'),
p AS (SELECT eval_id, row_id, e.o AS eo, r.o AS ro FROM e JOIN r ON e.a <> '' AND e.b <> '' AND r.a <> '' AND r.b <> ''
      AND abs(length(e.a) + length(e.b) - length(r.a) - length(r.b)) <= 2
      AND ((damerau_levenshtein(e.a, r.a) <= 1 AND damerau_levenshtein(e.b, r.b) <= 1) OR (damerau_levenshtein(e.a, r.b) <= 1 AND damerau_levenshtein(e.b, r.a) <= 1))),
n AS (SELECT DISTINCT eval_id, row_id FROM (SELECT eval_id, row_id, x, unnest(ro) AS y FROM (SELECT eval_id, row_id, unnest(eo) AS x, ro FROM p)) WHERE damerau_levenshtein(x, y) <= 1)"""


def oracle_sql() -> dict[str, str]:
    placed = "coalesce(epoch_us(observed_at), -9223372036854775808)"
    survivors_sql = f"""
        WITH {_KEYED},
        listed AS (SELECT {_EMOJI.format('emoji')} AS key, bool_or(is_placeholder) AS ph FROM emoji_reference GROUP BY 1),
        s AS (SELECT k.*, coalesce(trust, 0) AS tr, coalesce(NOT ph, false) AS shows, {placed} AS seen_at, CASE WHEN observed_at IS NULL THEN 1 ELSE 0 END AS undated
              FROM k LEFT JOIN source_trust USING (source) LEFT JOIN listed ON listed.key = {_EMOJI.format('k.emoji_output')}),
        w AS (SELECT *, count(*) OVER g AS n, min(obs_id) OVER g AS first_obs_id,
                row_number() OVER (PARTITION BY ko, kl, kh ORDER BY seen_at DESC, tr DESC, obs_id) AS r_out,
                row_number() OVER (PARTITION BY ko, kl, kh ORDER BY shows DESC, tr DESC, seen_at DESC, obs_id) AS r_emoji,
                row_number() OVER (PARTITION BY ko, kl, kh ORDER BY tr DESC, undated, seen_at, obs_id) AS r_source
              FROM s WINDOW g AS (PARTITION BY ko, kl, kh))
        SELECT first_obs_id, max(CASE WHEN r_out = 1 THEN obs_id END) AS output_obs_id, max(CASE WHEN r_emoji = 1 AND shows THEN obs_id ELSE 0 END) AS emoji_obs_id,
               max(CASE WHEN r_source = 1 THEN obs_id END) AS source_obs_id
        FROM w WHERE n > 1 GROUP BY first_obs_id"""
    leaks_sql = r"""
        WITH i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_passages),
        g AS (SELECT DISTINCT item_id, array_to_string(w[k : k + 11], ' ') AS gram FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i)),
        d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
        h AS (SELECT doc_id, array_to_string(w[k : k + 11], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d))
        SELECT DISTINCT doc_id, item_id FROM h JOIN g USING (gram)"""
    voted_sql = f"""
        WITH {_KEYED}, listed AS (SELECT {_EMOJI.format('emoji')} AS key, min(emoji) AS emoji, bool_or(is_placeholder) AS ph FROM emoji_reference GROUP BY 1),
        s AS (SELECT ko, kl, kh, obs_id, output, listed.emoji AS shown, CASE WHEN trim(k.source) <> '' THEN k.source END AS source,
                (coalesce(trust, 0) + 1) * pow(0.5, coalesce(least((epoch_us((SELECT max(observed_at) FROM recipe_observations)) - epoch_us(observed_at)) / (86400000000.0 * 180), 60), 10)) AS vote
              FROM k LEFT JOIN source_trust USING (source) LEFT JOIN listed ON NOT ph AND listed.key = {_EMOJI.format('k.emoji_output')}),
        l AS (SELECT ko, kl, kh, 1 AS f, lower(trim(output)) AS norm, output AS value, vote FROM s UNION ALL SELECT ko, kl, kh, 2, shown, shown, vote FROM s WHERE shown IS NOT NULL UNION ALL SELECT ko, kl, kh, 3, source, source, vote FROM s WHERE source IS NOT NULL),
        v AS (SELECT ko, kl, kh, f, norm, min(value) AS value, round(sum(vote), 9) AS votes FROM l GROUP BY 1, 2, 3, 4, 5),
        w AS (SELECT ko, kl, kh, f, value FROM v QUALIFY row_number() OVER (PARTITION BY ko, kl, kh, f ORDER BY votes DESC, norm DESC) = 1),
        p AS (SELECT ko, kl, kh, max(CASE WHEN f = 1 THEN value END) AS output, max(CASE WHEN f = 2 THEN value END) AS emoji_output, max(CASE WHEN f = 3 THEN value END) AS source FROM w GROUP BY 1, 2, 3)
        SELECT min(obs_id) AS first_obs_id, count(*) AS n_copies, any_value(p.output) AS output, any_value(p.emoji_output) AS emoji_output, any_value(p.source) AS source FROM s JOIN p USING (ko, kl, kh) GROUP BY ko, kl, kh"""
    spans_sql = r"""
        WITH i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_passages),
        g AS (SELECT item_id, k, array_to_string(w[k : k + 11], ' ') AS gram FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i)),
        d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w, list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda x: length(x)) AS wl, list_transform(regexp_split_to_array(text, '[\p{L}\p{N}]+'), lambda x: length(x)) AS sl FROM documents),
        h AS (SELECT doc_id, p, array_to_string(w[p : p + 11], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS p FROM d)),
        m AS (SELECT doc_id, item_id, p, p - k AS line, p - row_number() OVER (PARTITION BY doc_id, item_id, p - k ORDER BY p) AS run FROM h JOIN g USING (gram)),
        r AS (SELECT doc_id, item_id, min(p) AS p, count(*) + 11 AS n FROM m GROUP BY doc_id, item_id, line, run),
        b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n DESC, p) = 1)
        SELECT doc_id, item_id, CAST(coalesce(list_sum(wl[1 : p - 1]), 0) + list_sum(sl[1 : p]) AS INTEGER) AS "start", CAST(list_sum(wl[1 : p + n - 1]) + list_sum(sl[1 : p + n - 1]) AS INTEGER) AS "end", CAST(n AS INTEGER) AS words FROM b JOIN d USING (doc_id)"""
    return {
        "p1_found": f"WITH {_KEYED} SELECT first_obs_id, obs_id AS copy_obs_id FROM (SELECT obs_id, min(obs_id) OVER (PARTITION BY ko, kl, kh) AS first_obs_id FROM k) WHERE obs_id <> first_obs_id",
        "p1_collapsed": f"WITH {_KEYED} SELECT min(obs_id) AS first_obs_id, count(*) AS n_copies FROM k GROUP BY ko, kl, kh",
        "p2_found": f"WITH {_NEAR} SELECT eval_id, row_id FROM n",
        "p2_report": f"""WITH {_NEAR}, q AS (SELECT eval_id, count(*) AS pairs FROM n GROUP BY 1)
            SELECT split, source, count(*) AS eval_rows, count(pairs) AS overlapping_rows, CAST(coalesce(sum(pairs), 0) AS BIGINT) AS pairs FROM eval_records LEFT JOIN q USING (eval_id) GROUP BY 1, 2""",
        "p3_found": f"WITH {_TERMS} SELECT field_name, term, mark FROM m WHERE mark IS NOT NULL",
        "p3_terms": f"WITH {_TERMS} SELECT field_name, term, occurrences, records, mark FROM m",
        "p4_found": survivors_sql,
        "p5_emoji": f"""WITH listed AS (SELECT {_EMOJI.format('emoji')} AS key, min(emoji) AS listed FROM emoji_reference WHERE emoji IS NOT NULL GROUP BY 1)
            SELECT obs_id, listed FROM recipe_observations o JOIN listed ON key <> '' AND key = {_EMOJI.format('o.emoji_output')} WHERE NOT EXISTS (SELECT 1 FROM emoji_reference e WHERE e.emoji = o.emoji_output)""",
        "p4_voted": voted_sql,
        "p8_found": leaks_sql,
        "p8_spans": spans_sql,
    }
