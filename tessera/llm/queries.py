"""Registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import (bpe, chat, hamming, line_rules, merkle, oracles, packing, phrases, pii, prefix_trie, probminhash,
                         rule_ensemble, toxicity, url_rules)
from tessera.llm.common import table


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op6_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.digests(table(spark, sf_dir, "documents"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    own = spark.range(2).select(
        F.lit(-7).alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat.digests(turns.union(own))


def op8_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.verdicts(table(spark, sf_dir, "documents"))


def op2_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_ensemble.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probminhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op10_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return hamming.search(vectors, vectors.filter("vec_id % 20 = 0"))


def op11_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = url_rules.rule_table(spark, (
        ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
        ("allow", "com", "/fr/"), ("block", "com", "/de/")))
    return url_rules.judge(table(spark, sf_dir, "pages"), rules)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.nodes(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_rule_ensemble": op2_rule_ensemble,
    "op3_probminhash": op3_probminhash,
    "op4_pii_boosting": op4_pii_boosting,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_phrase_automata": op6_phrase_automata,
    "op7_chat_format": op7_chat_format,
    "op8_toxicity_grammar": op8_toxicity_grammar,
    "op9_line_rules": op9_line_rules,
    "op10_hamming_topk": op10_hamming_topk,
    "op11_url_rules": op11_url_rules,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_prefix_trie": op13_prefix_trie,
}
_OP7 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), stepped AS (
  SELECT *, lag(role, 1, 'start') OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), ''))
         AS loss_sha256,
       CAST(sum(15 + length(role) + length(text)
                + length(regexp_replace(text, '[^\\<#]', '', 'g'))) AS BIGINT) AS formatted_chars,
       bool_and((before, role) IN (('start', 'system'), ('start', 'user'), ('system', 'user'),
                                   ('user', 'assistant'), ('assistant', 'user')))
         AND arg_max(role, (turn, role, text)) IN ('user', 'assistant') AS valid
FROM stepped GROUP BY conv_id
"""

_OP6 = r"""
WITH cut AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, unnest(range(1, len(w) - 18)) AS s, w FROM cut WHERE len(w) >= 20
), keyed AS (
  SELECT doc_id, s, sha256(array_to_string(w[s:s + 19], ' ')) AS k FROM windows
), covered AS (
  SELECT doc_id, s FROM keyed QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, s) > 1
), words AS (
  SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM cut
), gone AS (
  SELECT DISTINCT doc_id, s + j AS i FROM covered, (SELECT unnest(range(20)) AS j)
), kept AS (
  SELECT doc_id, i, word FROM words ANTI JOIN gone USING (doc_id, i)
), rest AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS kept FROM kept GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM cut LEFT JOIN rest USING (doc_id)
"""

_OP9 = r"""
WITH cut AS (
  SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         string_split(coalesce(text, ''), chr(10)) AS l
  FROM documents
), windows AS (
  SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM cut WHERE len(w) >= 3
), doubled AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM windows
), covered AS (
  SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words
  FROM doubled, (SELECT unnest([0, 1, 2]) AS j) WHERE n >= 2 GROUP BY doc_id
), line AS (
  SELECT doc_id, host, unnest(l) AS line FROM cut
), worded AS (
  SELECT doc_id, host, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words,
         array_to_string(regexp_extract_all(regexp_replace(
           translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]', '0', 'g'),
           '[^\x20\x09-\x0D]+'), ' ') AS normal
  FROM line WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), dup AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM worded GROUP BY doc_id
), frequent AS (
  SELECT host, normal FROM worded JOIN (SELECT host, count(DISTINCT doc_id) AS docs FROM cut GROUP BY host) USING (host)
  GROUP BY host, normal, docs HAVING count(DISTINCT doc_id) > greatest(20, 0.02 * docs)
), lost AS (
  SELECT doc_id, sum(words) AS n_lost FROM worded JOIN frequent USING (host, normal) GROUP BY doc_id
), base AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         CAST(coalesce(n_lost, 0) AS BIGINT) AS n_lost
  FROM cut LEFT JOIN dup USING (doc_id) LEFT JOIN covered USING (doc_id) LEFT JOIN lost USING (doc_id)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_lost <= 0.5 * n_words AS kept
FROM base
"""

_OP10 = f"""
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbour) AS rank FROM (
    SELECT q.vec_id, e.vec_id AS neighbour,
           {" + ".join(f"((q.embedding[{i}] > 0) <> (e.embedding[{i}] > 0))::INT" for i in range(1, 65))} AS distance
    FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0)
) WHERE rank <= 10
"""

ORACLES: dict[str, str] = {
    "op6_phrase_automata": _OP6,
    "op7_chat_format": _OP7,
    "op9_line_rules": _OP9,
    "op10_hamming_topk": _OP10,
    "op11_url_rules": oracles.URL_RULES,
    "op12_merkle_manifest": oracles.merkle(),
    "op13_prefix_trie": oracles.TRIE,
}
