"""The operators' queries over the whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, chat, decontaminate, exact_dedup, language_id, secrets, token_counts, token_files, url_filter
from ._stash import Stash
from .near_dedup import near_duplicates

URL_RULES = [url_filter.Rule(*r) for r in (
    ("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"),
)]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_codec(most: int = byte_bpe.MEMO) -> byte_bpe.Codec:
    return byte_bpe.Codec(byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN, most)


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).select("doc_id", "n_shingles", F.array_sort("items").alias("items"), "contaminated")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"), URL_RULES)


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(_table(spark, sf_dir, "conversations"))


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_table(spark, sf_dir, "documents"))
    digest = F.sha2(secrets.spelled(F.col("base")), 256)
    return found.select("doc_id", "n_assign", "n_access", "n_hex", digest.alias("base_sha256"), secrets.spelled(F.col("found")).alias("spans"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encoded(_table(spark, sf_dir, "documents"), byte_codec())


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = Stash(spark, "token-files").path("corpus")
    token_files.write(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), folder)
    return token_files.read(spark, folder).drop("ids")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicates(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_benchmark_decontamination, op2_token_counts, op3_url_filters, op4_chat_formatting, op5_secret_scans,
        op6_byte_bpe, op7_language_id, op8_minhash_near_dedup, op9_token_files, op10_exact_dedup,
    )
    return {f.__name__: f for f in found}


#: The distinct five-word runs of each text of a table, a short text's whole sequence as one.
SHINGLES = """{name} AS (
  SELECT {key}, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                              WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
  FROM (SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM {table}))"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_benchmark_decontamination": f"""WITH {SHINGLES.format(name="d", key="doc_id", table="documents")},
{SHINGLES.format(name="b", key="item_id", table="benchmark")},
x AS (SELECT doc_id, unnest(s) AS g FROM d), y AS (SELECT item_id, len(s) AS q, unnest(s) AS g FROM b),
hits AS (SELECT doc_id, item_id FROM x JOIN y USING (g) GROUP BY doc_id, item_id, q HAVING 100 * count(*) >= 75 * q),
found AS (SELECT doc_id, list(item_id ORDER BY item_id) AS items FROM hits GROUP BY doc_id)
SELECT doc_id, len(s)::BIGINT AS n_shingles, coalesce(items, []) AS items, items IS NOT NULL AS contaminated FROM d LEFT JOIN found USING (doc_id)""",
        "op4_chat_formatting": """WITH c AS (SELECT conv_id, list({'turn': turn, 'role': role, 'text': text} ORDER BY turn) AS l FROM conversations GROUP BY conv_id),
p AS (SELECT DISTINCT l[1:k] AS l FROM (SELECT l, unnest(range(1, len(l))) AS k FROM c)),
kept AS (SELECT min(conv_id) AS conv_id FROM c WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.l = c.l) GROUP BY l)
SELECT conv_id, turn, role, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS rendered FROM conversations JOIN kept USING (conv_id)""",
        "op10_exact_dedup": """SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    }
