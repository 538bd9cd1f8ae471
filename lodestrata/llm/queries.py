"""The registered queries of this subpackage."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import cap_filters, chat_format
from . import collocations as phrases
from .bpe import bpe_digests
from .conversation_repair import repair_conversations
from .exact_dedup import exact_dedup
from .packing import pack_documents
from .quality_rules import quality_rules
from .recompression import remove_repeated_words
from .simhash import simhash_components
from .suffix_dedup import remove_repeated_bytes
from .token_counts import token_counts
from .warc import archive_pages


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_bytes(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_words(table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_chats(table(spark, sf_dir, "conversations"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(table(spark, sf_dir, "conversations"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cap_filters.near_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_quality_rules, op3_suffix_dedup, op4_warc, op5_substring_dedup,
        op6_bpe, op7_exact_dedup, op8_packing, op9_simhash, op10_chat_format,
        op11_conversation_repair, op12_collocations, op13_near_vectors,
    )
}

ORACLE_SQL = {
    "op3_suffix_dedup": r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
w AS (SELECT doc_id, s, substr(h, 2 * s - 1, 100) AS part FROM d, unnest(range(1, n - 48)) AS t(s)),
f AS (SELECT part, min(doc_id) AS least FROM w GROUP BY part),
gone AS (SELECT doc_id, s, s - lag(s, 1, -100) OVER (PARTITION BY doc_id ORDER BY s) > 50 AS new FROM w JOIN f USING (part) WHERE least < doc_id),
numbered AS (SELECT doc_id, s, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY s) AS span FROM gone),
spans AS (SELECT doc_id, min(s) AS lo, max(s) + 49 AS hi FROM numbered GROUP BY doc_id, span),
edges AS (SELECT doc_id, lo, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) + 1 AS a, hi FROM spans
  UNION ALL SELECT d.doc_id, n + 1, coalesce(max(hi), 0) + 1, n FROM d LEFT JOIN spans USING (doc_id) GROUP BY d.doc_id, n),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * a - 1, 2 * (lo - a)), '' ORDER BY lo) AS k FROM edges JOIN d USING (doc_id) GROUP BY doc_id),
counts AS (SELECT doc_id, sum(hi - lo + 1) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(k)) AS kept_sha256 FROM d JOIN kept USING (doc_id) LEFT JOIN counts USING (doc_id)
""",
    "op4_warc": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(encode(coalesce(html, ''))) AS h FROM pages),
digits AS (SELECT *, list_transform(range(8), lambda i: list_sum(list_transform(range(5), lambda k: (strpos('0123456789abcdef', substr(h, CAST(5 * i + k + 1 AS BIGINT), 1)) - 1) * 16 ** (4 - k)))::BIGINT) AS v FROM p),
coded AS (SELECT *, array_to_string(list_transform(v, lambda x: array_to_string(list_transform([32768, 1024, 32, 1], lambda q: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((x // q) % 32 + 1 AS BIGINT), 1)), '')), '') AS payload_digest FROM digits),
keepers AS (SELECT body, max(page_id) AS top FROM p GROUP BY body)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM coded JOIN keepers USING (body)
""",
    "op5_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (SELECT doc_id, s, array_to_string(words[s:s + 12], ' ') AS part FROM d, unnest(range(1, len(words) - 11)) AS t(s)),
f AS (SELECT part, min(doc_id) AS least FROM w GROUP BY part),
gone AS (SELECT DISTINCT doc_id, s + k AS i FROM w JOIN f USING (part), range(13) AS t(k) WHERE least < doc_id),
cut AS (SELECT doc_id, s AS i, words[s] AS word FROM d, unnest(range(1, len(words) + 1)) AS t(s)),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS k FROM cut ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
""",
    "op7_exact_dedup": r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare FROM documents),
ranked AS (SELECT *, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS r FROM d WINDOW w AS (PARTITION BY bare ORDER BY n DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, CAST(count(*) OVER (PARTITION BY bare) AS BIGINT) AS group_size, r = 1 AS kept, sha256(bare) AS text_sha256 FROM ranked
""",
    "op10_chat_format": chat_format.ORACLE_SQL,
    "op12_collocations": phrases.ORACLE_SQL,
    "op13_near_vectors": cap_filters.ORACLE_SQL,
}
