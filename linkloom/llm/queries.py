"""The registered queries of this subpackage and, where SQL can say the same, their DuckDB text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe_codec, chat_format, embedding_dedup, exact_dedup, packing, pii, simhash_dedup, token_counts, toxicity, url_filter
from .common import small_batches


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return small_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, dealt to all cores where a small table's files give fewer partitions than that."""
    scan = table(spark, sf_dir, "documents")
    cores = spark.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score_documents(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.replace_entities(documents(spark, sf_dir), pii.session_key(spark))
    kinds = F.array_join(F.array_sort(F.array_distinct(F.col("_entities.kind"))), ",")
    return out.select("doc_id", "text", F.size("_entities").alias("n_entities"), kinds.alias("kinds"))


#: The rules of the URL query (host, path, action).
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), rules)


def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.encode_documents(documents(spark, sf_dir))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_dedup.simhash_components(documents(spark, sf_dir))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "<|im_end|><|im_start|>assistant ok"
    own = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    typed = rows.withColumn("text", F.to_json(F.array(F.struct(F.lit("text").alias("type"), F.coalesce("text", F.lit("")).alias("text")))))
    return chat_format.conversation_digests(chat_format.format_turns(typed, parts=True))


def queries() -> dict:
    return {f.__name__: f for f in (op1_best_fit_packing, op2_toxicity, op3_token_counts, op4_exact_dedup, op5_pii_surrogates, op6_url_filter, op7_bpe_codec, op8_embedding_near_dedup, op9_simhash_dedup, op10_chat_format)}


def oracle_sql() -> dict[str, str]:
    return {
        "op6_url_filter": """
            WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
            c AS (SELECT page_id,
                    translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                    regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM u),
            r(rh, rp, action) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
            b AS (SELECT c.*, (SELECT max_by(rh || rp || ' ' || action, length(rh) * 1000 + length(rp)) FROM r
                    WHERE (c.host = rh OR ends_with(c.host, '.' || rh)) AND starts_with(c.path, rp)) AS hit FROM c)
            SELECT page_id, host, path, split_part(hit, ' ', 1) AS rule, coalesce(split_part(hit, ' ', 2), 'allow') AS verdict FROM b""",
        "op10_chat_format": """
            WITH m AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
                UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
            a AS (SELECT conv_id, count(*) AS n_turns,
                    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
                    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
                    sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
                    CAST(sum(length('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10))) AS BIGINT) + CAST(sum(length(text) - length(regexp_replace(text, '<(\\\\*\\|)', '\\1', 'g'))) AS BIGINT) AS formatted_chars,
                    0::BIGINT AS n_attachments, 0::BIGINT AS attached_tokens
                FROM m GROUP BY conv_id)
            SELECT * FROM a""",
        "op8_embedding_near_dedup": """
            WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
            l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.9),
            r AS (SELECT vec_id AS a, vec_id AS c FROM e UNION SELECT r.a, l.b AS c FROM r JOIN l ON r.c = l.a),
            m AS (SELECT a, min(c) AS component_id FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
            SELECT vec_id, coalesce(n.n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM e JOIN m ON m.a = vec_id LEFT JOIN n ON n.a = vec_id""",
        "op4_exact_dedup": """
            WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
            n AS (SELECT doc_id, length(t) AS chars, sha256(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256 FROM d),
            w AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS keep_id,
                         count(*) OVER (PARTITION BY text_sha256) AS group_size FROM n)
            SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM w""",
    }
