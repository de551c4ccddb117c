"""Queries that choose, place or repair rows: hard negatives, packing, conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline.llm import conversations, hard_negatives, packing
from meterline.llm.registry import query
from meterline.llm.texts import table

OP11_SQL = """
WITH v AS (SELECT row_number() OVER () AS rid, vec_id,
    CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND NOT coalesce(list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x))), false)),
s AS (SELECT a.rid, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
    list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.rid <> b.rid WHERE a.vec_id % 50 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS r FROM s WHERE same),
w AS (SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, n.vec_id AS negative_id,
    n.score AS negative_score,
    row_number() OVER (PARTITION BY p.rid, p.r ORDER BY n.score DESC, n.vec_id) AS rank
  FROM p JOIN s n ON n.rid = p.rid AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
  WHERE p.r <= 5)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM w WHERE rank <= 3
"""


@query("op11_hard_negatives", OP11_SQL)
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some labels are moved on by one first, so that they disagree with the vectors."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", moved.alias("label"), "embedding")
    return hard_negatives.mine(rows, F.col("vec_id") % 50 == 0)


@query("op12_best_fit_packing")
def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "piece", "start", F.col("length").cast("bigint").alias("length"),
                         F.crc32("ids").alias("ids_crc32"), "sequence_id", F.col("offset").cast("bigint").alias("offset"))


OP13_SQL = r"""
WITH RECURSIVE c AS (
  SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
crc AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(4294967295::UBIGINT, list_reduce(
    list_prepend(4294967295::UBIGINT, list_transform(string_split(k, ''), lambda x: ascii(x)::UBIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)::UBIGINT[]),
      lambda h, i: xor(h >> 1, 3988292384::UBIGINT * (h & 1))))) % 20 AS damage FROM c),
damaged AS (
  SELECT conv_id, turn, CASE WHEN damage = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN damage = 1 THEN '' WHEN damage = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM crc, LATERAL (SELECT unnest(generate_series(1, CASE damage WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)))),
placed AS (
  SELECT *, left(role, 1) AS ini, rtrim(text, E' \t\n\x0b\x0c\r') AS seen,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged),
r AS (
  SELECT *, CASE WHEN seen = '' THEN 'blank'
    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN right(seen, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
    lag(ini) OVER (PARTITION BY conv_id ORDER BY i) || ini AS two FROM placed),
counts AS (
  SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (two IS NOT NULL AND two NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id),
-- Tops: 0 nothing yet, 1 after system, 2 after user, 3 after a pair.
ins(p, t, k, made) AS (VALUES (0, 0, '', ''), (1, 1, '', ''), (2, 2, '', ''), (3, 3, '', ''),
  (0, 2, 'I', E'\nuser:'), (1, 2, 'I', E'\nuser:'), (3, 2, 'I', E'\nuser:'), (2, 3, 'I', E'\nassistant:'),
  (0, 3, 'II', E'\nuser:\nassistant:'), (1, 3, 'II', E'\nuser:\nassistant:')),
op(t, q, edit, ini, price, name) AS (VALUES (0, 0, 'D', NULL, 3, NULL), (1, 1, 'D', NULL, 3, NULL), (2, 2, 'D', NULL, 3, NULL),
  (3, 3, 'D', NULL, 3, NULL), (0, 1, 'K', 's', 0, NULL), (0, 2, 'K', 'u', 0, NULL), (1, 2, 'K', 'u', 0, NULL),
  (3, 2, 'K', 'u', 0, NULL), (2, 3, 'K', 'a', 0, NULL), (0, 2, 'R', NULL, 2, 'user'), (1, 2, 'R', NULL, 2, 'user'),
  (3, 2, 'R', NULL, 2, 'user'), (2, 3, 'R', NULL, 2, 'assistant')),
steps AS (
  SELECT ins.p, op.q, op.ini, op.edit, ins.k || op.edit AS edits, 2 * len(ins.k) + op.price AS price, ins.made, op.name
  FROM ins JOIN op USING (t)),
dp AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS top, {'cost': 0::BIGINT, 'audit': '', 'made': ''} AS best FROM counts
  UNION ALL
  SELECT d.conv_id, d.i + 1, s.q, min({'cost': d.best.cost + s.price
      + CASE WHEN r.fault = 'truncated' AND s.edit <> 'D' THEN 1 ELSE 0 END, 'audit': d.best.audit || s.edits,
      'made': d.best.made || s.made || CASE s.edit WHEN 'D' THEN ''
        ELSE E'\n' || coalesce(s.name, r.role) || ':' || r.text END})
  FROM dp d JOIN r ON r.conv_id IS NOT DISTINCT FROM d.conv_id AND r.i = d.i + 1
  JOIN steps s ON s.p = d.top AND (s.ini IS NULL OR s.ini = r.ini)
    AND (s.edit = 'D' OR r.fault IS NULL OR r.fault = 'truncated')
  GROUP BY d.conv_id, d.i, s.q),
ends(top, k, made) AS (VALUES (0, '', ''), (3, '', ''), (2, 'I', E'\nassistant:'), (1, 'II', E'\nuser:\nassistant:')),
repaired AS (
  SELECT c.conv_id, min({'cost': d.best.cost + 2 * len(e.k), 'audit': d.best.audit || e.k, 'made': d.best.made || e.made}) AS best
  FROM counts c JOIN dp d ON d.conv_id IS NOT DISTINCT FROM c.conv_id AND d.i = c.n JOIN ends e USING (top) GROUP BY c.conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0) AS cost,
  coalesce(best.audit, '') AS audit, sha256(coalesce(substr(best.made, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN repaired p ON p.conv_id IS NOT DISTINCT FROM o.conv_id
"""


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with turns lost, emptied, cut, repeated or given to the user, by a hash of their number."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hashed = F.pmod(F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")), F.lit(20))
    marked = rows.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), hashed.alias("damage"))
    copies = F.when(F.col("damage") == 3, 2).otherwise(1)
    return marked.filter("damage <> 0").select(
        "conv_id", "turn", F.when(F.col("damage") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("damage") == 1, "").when(F.col("damage") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text")).alias("text"), F.explode(F.sequence(F.lit(1), copies)).alias("copy")).drop("copy")


@query("op13_conversation_repair", OP13_SQL)
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    found = conversations.digests(damaged(rows)).withColumnRenamed("conv_id", "c")
    zero = F.lit(0).cast("bigint")
    every = rows.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    return every.select("conv_id", *[F.coalesce(c, zero).alias(c) for c in
                                     ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                        F.coalesce("audit", F.lit("")).alias("audit"),
                        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
