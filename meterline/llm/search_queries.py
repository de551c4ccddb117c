"""Queries that look phrases up in documents, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline.llm import decontaminate, licenses
from meterline.llm.registry import query
from meterline.llm.texts import table

_A_TO_Z = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WORDS = f"""regexp_extract_all(translate(coalesce(text, ''), {_A_TO_Z}),
  '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"""

OP2_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(list_slice(ws, i, i + 9), ' ') AS gram
  FROM b, LATERAL (SELECT unnest(generate_series(1, greatest(len(ws) - 9, 1))) AS i) WHERE len(ws) > 0),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS gram
  FROM d CROSS JOIN lens, LATERAL (SELECT unnest(generate_series(1, len(ws) - n + 1)) AS i)),
m AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, gram)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (
  SELECT DISTINCT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (
  SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m WHERE item_id IS NOT NULL) GROUP BY doc_id),
st AS (SELECT DISTINCT item_id, ws[f + 1:f + {decontaminate.SLOP}] AS part FROM b, LATERAL (SELECT unnest(list_append(
  generate_series(0, greatest(len(ws) - {decontaminate.SLOP}, 0), {decontaminate.SLOP}),
  greatest(len(ws) - {decontaminate.SLOP}, 0))) AS f) WHERE len(ws) > 0),
sw AS (SELECT DISTINCT item_id, part, unnest(part) AS word FROM st),
pw AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM d),
pc AS (SELECT doc_id, word, pos FROM pw WHERE word IN (SELECT word FROM sw)),
fw AS (SELECT word, count(*) AS n FROM pc GROUP BY word),
rw AS (SELECT item_id, part, word, row_number() OVER (PARTITION BY item_id, part ORDER BY coalesce(n, 0), word) AS place,
  count(*) OVER (PARTITION BY item_id, part) AS terms FROM sw LEFT JOIN fw USING (word)),
lead AS (SELECT item_id, part, doc_id, pos FROM rw JOIN pc USING (word) WHERE place = 1 AND terms >= {decontaminate.NEAR_TERMS}),
nn AS (SELECT DISTINCT l.doc_id, l.item_id FROM lead l JOIN rw r ON r.item_id = l.item_id AND r.part = l.part
    AND r.place BETWEEN 2 AND {decontaminate.NEAR_TERMS}
  JOIN pc p ON p.doc_id = l.doc_id AND p.word = r.word AND abs(p.pos - l.pos) <= {decontaminate.SLOP}
  GROUP BY l.doc_id, l.item_id, l.part, l.pos HAVING count(DISTINCT r.place) = {decontaminate.NEAR_TERMS} - 1),
nr AS (SELECT doc_id, count(*) AS n_near, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS near_names
  FROM nn GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near,
  sha256(coalesce(near_names, '')) AS near_sha256
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id) LEFT JOIN nr USING (doc_id)
"""


@query("op2_decontamination", OP2_SQL)
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = decontaminate.build_index(table(spark, sf_dir, "documents"))
    names = lambda c: F.array_sort(F.transform(c, lambda x: x.cast("string")))
    return decontaminate.search(index, table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(names("items"), ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"), F.size("near").cast("bigint").alias("n_near"),
        F.sha2(F.array_join(names("near"), ","), 256).alias("near_sha256"))


_INDEX = ", ".join(f"({t}, {i}, '{w}', {k})" for t, i, w, k in licenses.index_rows())
_NAMES = ", ".join(f"({t}, '{x[0]}', {x[3]})" for t, x in enumerate(licenses.TEMPLATES))

OP1_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
ix(t, place, word, key) AS (VALUES {_INDEX}),
names(t, label, base) AS (VALUES {_NAMES}),
w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS pos FROM d),
h AS (SELECT * FROM w WHERE word IN (SELECT word FROM ix)),
df AS (SELECT word, count(DISTINCT doc_id) AS df FROM h GROUP BY word),
wx AS (SELECT t, place, word, key, round(1000 * ln(((SELECT count(*) FROM d) + 1.0)
  / (coalesce(df, 0) + 1.0)))::BIGINT + 1 AS weight FROM ix LEFT JOIN df USING (word)),
tot AS (SELECT t, sum(weight) AS total, count(*) FILTER (key) AS keys FROM wx GROUP BY t),
v AS (SELECT doc_id, t, pos - place AS start, sum(weight) AS weight, count(*) FILTER (key) AS n_key
  FROM h JOIN wx USING (word) GROUP BY ALL),
f AS (SELECT doc_id, start, label, base, weight::DOUBLE / total::DOUBLE AS share
  FROM v JOIN tot USING (t) JOIN names USING (t) WHERE n_key = keys AND weight >= {licenses.COVERAGE}::DOUBLE * total),
r AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word,
  max(start) FILTER (base) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
  string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM f GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0::DOUBLE) AS score
FROM d LEFT JOIN r USING (doc_id)
"""


@query("op1_license_scan", OP1_SQL)
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))
