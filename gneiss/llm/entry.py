"""Queries of the training-data operators, bound to the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm import chat_tools, decontam, embed_graph, licenses, line_dedup, packing, passages, sharding, simhash, toxicity

#: Vocabulary of the packing query; a parameter of the operator.
VOCABULARY = "word_bpe_49k.json"


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.tag(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary())


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_graph.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(line_dedup.dedup_lines(table(spark, sf_dir, "documents")))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_chat_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_tools.format_conversations(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_decontamination, op3_packing, op4_embedding_dedup, op5_substring_dedup,
        op6_sharding, op7_licenses, op8_line_dedup, op9_simhash, op10_chat_tools,
    )
}

_WORDS = "list_filter(string_split_regex(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"

ORACLE_SQL: dict[str, str] = {
    "op2_decontamination": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format("coalesce(text, '')")} AS w FROM benchmark),
win AS (
  SELECT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS key
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
occ AS (
  SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS key
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT o.r, o.i, o.n, win.item_id FROM occ o JOIN win ON o.key = win.key AND o.n = win.n),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
items AS (
  SELECT r, count(DISTINCT item_id) AS n_items,
         array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS listed FROM hits GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)""",
    "op8_line_dedup": """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
l AS (
  SELECT r, doc_id, i, lines[i] AS line,
         translate(trim(lines[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT r, doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT r, doc_id, string_split(text, chr(10)) AS lines FROM d))),
f AS (SELECT key FROM l WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(f.key) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN f.key IS NULL THEN line END, chr(10) ORDER BY i), '')) AS kept_sha256
FROM l LEFT JOIN f ON l.key = f.key GROUP BY r, doc_id""",
    "op4_embedding_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (
  SELECT * FROM v WHERE label IS NOT NULL AND vec_id IS NOT NULL AND e IS NOT NULL AND len(e) > 0
  AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, least(a, min(b)) AS c FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, coalesce(c.c, vec_id) AS component_id, coalesce(c.c, vec_id) = vec_id AS kept
FROM v LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id""",
    "op10_chat_tools": """
WITH e AS (
  SELECT conv_id, turn, role, text, CASE WHEN conv_id IS NULL OR turn IS NULL THEN 'message' WHEN role = 'user' THEN 'call' WHEN role = 'assistant' THEN 'result' ELSE 'message' END AS kind
  FROM conversations),
k AS (SELECT *, CASE kind WHEN 'call' THEN conv_id || ':' || turn WHEN 'result' THEN conv_id || ':' || (turn - 1) END AS call_id FROM e),
s AS (SELECT conv_id, call_id, bool_or(kind = 'call') AS has_call, min(turn) FILTER (WHERE kind = 'result') AS answered FROM k WHERE call_id IS NOT NULL GROUP BY 1, 2)
SELECT k.conv_id, k.turn, CAST(0 AS INTEGER) AS seq, k.role, k.kind, k.call_id,
  CASE k.kind WHEN 'call' THEN s.answered IS NOT NULL WHEN 'result' THEN s.has_call END AS linked,
  CASE WHEN k.kind = 'call' THEN true END AS valid,
  CASE WHEN k.kind = 'call' THEN k.turn < 2 OR coalesce(d.has_call AND d.answered < k.turn, false) END AS ordered,
  CASE WHEN k.kind = 'call' THEN false END AS cyclic, k.turn AS place_turn, CAST(0 AS INTEGER) AS place_seq, CAST(0 AS INTEGER) AS place_hops,
  CASE k.kind WHEN 'call' THEN '{"arguments":{"prompt":' || CAST(to_json(coalesce(k.text, '')) AS VARCHAR) || ',"turn":' || k.turn || '},"id":"' || k.call_id || '","name":"reply","role":"user"}'
  ELSE '{"content":' || CAST(to_json(coalesce(k.text, '')) AS VARCHAR) || coalesce(',"role":' || CAST(to_json(k.role) AS VARCHAR), '') || coalesce(',"tool_call_id":"' || k.call_id || '"', '') || '}' END AS json
FROM k LEFT JOIN s ON s.conv_id = k.conv_id AND s.call_id = k.call_id
LEFT JOIN s d ON d.conv_id = k.conv_id AND k.kind = 'call' AND k.turn >= 2 AND d.call_id = k.conv_id || ':' || (k.turn - 2)""",
}
