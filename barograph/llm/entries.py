"""Thin queries that apply each operator to the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, chroma, jaccard_join, language_id, mixing, ngram_lm, packing, pseudonyms, token_count, vector_search
from .shared import table

#: The key of the queries' pseudonyms; a deployment passes its own secret.
DEMO_KEY = b"barograph demonstration key 0001"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return chat_format.format_preferences(chat_format.with_swapped_answer(chat_format.conversations(turns)))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), mixing.cyclic_weights(3), 3)
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), 4096, 1)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"), DEMO_KEY, "text", "n_pseudonyms")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_groups(table(spark, sf_dir, "documents"), 4, 85, 100)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return vector_search.top_k(vectors, vectors.where("id % 100 = 0"), 10, 1024)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.fold(F.col("doc_id")) == 2)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.stupid_backoff(table(spark, sf_dir, "documents")).withColumn("score", F.round("score", 6))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no audio: a text's UTF-8 bytes stand in as the samples of its recording."""
    sound = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.encode("text", "UTF-8").alias("audio"))
    out = chroma.align_recordings(sound, F.col("id") % 100 == 0)
    return out.withColumnRenamed("id", "doc_id").withColumn("bit_error", F.round("bit_error", 6))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_preference_format": op1,
        "op2_mix_sources": op2,
        "op3_pack_best_fit": op3,
        "op4_pseudonyms": op4,
        "op5_token_counts": op5,
        "op6_jaccard_groups": op6,
        "op7_exact_top_k": op7,
        "op8_language_id": op8,
        "op9_stupid_backoff": op9,
        "op10_chroma_align": op10,
    }


OP1_SQL = """
WITH clean AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, regexp_replace(coalesce(text, ''), '<\\|im_(start|end)\\|>', '<| im_\\1|>', 'g') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM clean),
answers AS (
  SELECT conv_id, max(i) AS last, count(*) AS n, arg_min(role, i) AS role, arg_min(text, i) AS text
  FROM placed WHERE role = 'assistant' GROUP BY conv_id),
chosen AS (SELECT p.conv_id, p.i, p.role, p.text FROM placed p JOIN answers a USING (conv_id) WHERE p.i <= a.last),
rejected AS (
  SELECT p.conv_id, p.i, p.role, p.text FROM placed p JOIN answers a USING (conv_id) WHERE p.i < a.last
  UNION ALL SELECT conv_id, last, role, text FROM answers WHERE n > 1),
lens AS (
  SELECT a.conv_id, least(
    coalesce((SELECT min(coalesce(c.i, r.i)) - 1 FROM (SELECT * FROM chosen c0 WHERE c0.conv_id = a.conv_id) c
      FULL JOIN (SELECT * FROM rejected r0 WHERE r0.conv_id = a.conv_id) r ON c.i = r.i
      WHERE c.i IS NULL OR r.i IS NULL OR c.role <> r.role OR c.text <> r.text), a.last), a.last) AS k
  FROM answers a),
sides AS (
  SELECT conv_id, 'c' AS side, i, role, text FROM chosen UNION ALL SELECT conv_id, 'r', i, role, text FROM rejected),
parts AS (
  SELECT s.conv_id, CASE WHEN s.i <= l.k THEN 'p' ELSE s.side END AS part, s.i,
    '<|im_start|>' || s.role || chr(10) || s.text || '<|im_end|>' || chr(10) AS shown,
    CASE WHEN s.role = 'assistant' THEN '0x' || (length(s.role) + 13) || ' 1x' || (length(s.text) + 11)
      ELSE '0x' || (length(s.role) + length(s.text) + 24) END AS runs
  FROM sides s JOIN lens l USING (conv_id) WHERE s.side = 'c' OR s.i > l.k),
texts AS (SELECT conv_id, part, string_agg(shown, '' ORDER BY i) AS shown, string_agg(runs, ' ' ORDER BY i) AS runs FROM parts GROUP BY conv_id, part)
SELECT l.conv_id, CAST(l.k AS INTEGER) AS n_shared, coalesce(p.shown, '') AS prompt,
  coalesce(c.shown, '') AS chosen, coalesce(c.runs, '') AS chosen_mask, coalesce(r.shown, '') AS rejected, coalesce(r.runs, '') AS rejected_mask
FROM lens l
LEFT JOIN texts p ON p.conv_id = l.conv_id AND p.part = 'p'
LEFT JOIN texts c ON c.conv_id = l.conv_id AND c.part = 'c'
LEFT JOIN texts r ON r.conv_id = l.conv_id AND r.part = 'r'
"""

OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q, v c WHERE q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


_WORDS = "list_filter(string_split_regex({text}, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')"

OP6_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, {_WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
g AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS g FROM w),
x AS (SELECT doc_id, len(g) AS n, unnest(g) AS s FROM g),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS k FROM x a JOIN x b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM shared WHERE 100 * k >= 85 * (na + nb - k)),
sym AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, s.b FROM reach r JOIN sym s ON r.b = s.a)
SELECT g.doc_id, CAST(len(g.g) AS BIGINT) AS n_shingles, (SELECT min(b) FROM reach r WHERE r.a = g.doc_id) AS component_id FROM g
"""

OP9_SQL = f"""
WITH w AS (SELECT doc_id, list_concat([''], {_WORDS.format(text="coalesce(text, '')")}) AS w FROM documents),
o AS (SELECT doc_id, len(w) - 1 AS len, unnest(range(2, len(w) + 1)) AS i, w FROM w),
bi AS (SELECT doc_id, w[i - 1] AS b, w[i] AS c, count(*) AS tf FROM o GROUP BY ALL),
uni AS (SELECT doc_id, u, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS u FROM w WHERE len(w) > 1) GROUP BY ALL),
nb AS (SELECT b, c, sum(tf) AS n FROM bi GROUP BY ALL),
nu AS (SELECT u, sum(tf) AS n FROM uni GROUP BY ALL),
size AS (SELECT doc_id, len(w) - 1 AS len FROM w),
total AS (SELECT sum(len) AS n FROM size),
s AS (
  SELECT bi.doc_id, bi.tf, CASE
    WHEN nb.n > bi.tf THEN ln(nb.n - bi.tf) - ln(ub.n - tb.tf)
    WHEN uc.n > tc.tf THEN ln(0.4) + ln(uc.n - tc.tf) - ln(greatest(total.n - size.len, 1))
    ELSE 2 * ln(0.4) - ln(greatest(total.n - size.len, 1)) END AS v
  FROM bi JOIN nb USING (b, c) JOIN nu ub ON ub.u = bi.b JOIN nu uc ON uc.u = bi.c
  JOIN uni tb ON tb.doc_id = bi.doc_id AND tb.u = bi.b JOIN uni tc ON tc.doc_id = bi.doc_id AND tc.u = bi.c
  JOIN size ON size.doc_id = bi.doc_id, total)
SELECT size.doc_id, size.len AS n_words, round(sum(s.tf * s.v) / size.len, 6) AS score
FROM size LEFT JOIN s ON s.doc_id = size.doc_id GROUP BY size.doc_id, size.len
"""


def oracle_sql() -> dict[str, str]:
    """SQL where it can express the operator at all; the others are tested against brute force."""
    return {"op1_preference_format": OP1_SQL, "op6_jaccard_groups": OP6_SQL, "op7_exact_top_k": OP7_SQL, "op9_stupid_backoff": OP9_SQL}
