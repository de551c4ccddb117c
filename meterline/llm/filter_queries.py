"""Queries of the quality rules and line deduplication, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline.llm import line_dedup, repetition
from meterline.llm.registry import query
from meterline.llm.texts import table

_A_TO_Z = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP6_SQL = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\\x20\\x09-\\x0D]+', ''),
      '[\\x20\\x09-\\x0D]+$', ''), {_A_TO_Z}) AS key FROM l),
o AS (SELECT key, min(doc_id) AS owner FROM k GROUP BY key),
j AS (SELECT k.*, length(k.key) >= 10 AND k.doc_id <> o.owner AS gone FROM k JOIN o USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""


@query("op6_line_dedup", OP6_SQL)
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.drop_lines(docs).select(
        "doc_id", "n_lines", "n_dropped",
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def _covered_sql(n: int) -> str:
    return f"""
g{n} AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) > 1 AS twice
  FROM (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + {n - 1}), ' ') AS gram
        FROM w, LATERAL (SELECT unnest(generate_series(1, n_words - {n - 1})) AS i))),
c{n} AS (SELECT doc_id, count(*) AS words, sum(length(ws[p])) AS chars FROM (
  SELECT DISTINCT g.doc_id, unnest(generate_series(i, i + {n - 1})) AS p FROM g{n} g WHERE twice)
  JOIN w USING (doc_id) GROUP BY doc_id)"""


OP7_SQL = f"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, ws, len(ws) AS n_words FROM (SELECT doc_id, text,
  regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents)),
ln AS (SELECT doc_id, count(*) - count(DISTINCT line) AS dups, sum(length(line)) AS chars,
  sum(length(line)) - sum(length(line)) FILTER (first) AS dup_chars FROM (
    SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line) = 1 AS first FROM (
      SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w)
    WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')) GROUP BY doc_id),
{_covered_sql(3)}, {_covered_sql(5)}, {_covered_sql(7)}, {_covered_sql(10)},
m AS (SELECT w.doc_id, n_words, length(array_to_string(ws, '')) AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dups, 0) AS n_dup_lines,
  coalesce(c3.words, 0) AS n_repeat_words, coalesce(dup_chars, 0) AS dup_line_chars,
  coalesce(ln.chars, 0) AS line_chars, coalesce(c5.chars, 0) AS dup5_chars,
  coalesce(c7.chars, 0) AS dup7_chars, coalesce(c10.chars, 0) AS dup10_chars
  FROM w LEFT JOIN ln USING (doc_id) LEFT JOIN c3 USING (doc_id) LEFT JOIN c5 USING (doc_id)
  LEFT JOIN c7 USING (doc_id) LEFT JOIN c10 USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 10 * dup_line_chars <= 3 * line_chars
  AND 10 * n_symbols <= n_words AND 100 * dup5_chars <= 30 * word_chars
  AND 100 * dup7_chars <= 28 * word_chars AND 100 * dup10_chars <= 25 * word_chars AS kept
FROM m
"""


@query("op7_repetition", OP7_SQL)
def op7_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repetition.judge(repetition.repetition(table(spark, sf_dir, "documents")))
    for n in repetition.MAX_COVERED:
        out = out.withColumn(f"dup{n}_chars", F.col("covered")[n])
    return out.drop("covered")
