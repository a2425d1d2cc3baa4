"""Views that several registered queries start from, in Spark and in DuckDB's SQL."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import tokens
from ..functions.words import STOPWORDS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, for queries that write before they read; where that is unset, a
    temporary one, in local mode only. It goes when the application ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = os.path.join(tempfile.gettempdir(), "checkpoints")
    path = f"{base}/{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def spread(scan: DataFrame) -> DataFrame:
    """A scan dealt to all cores if its files give fewer partitions than there are (a small table in one
    file); tables of more partitions than cores stay as they are."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: A word, quoted for SQL.
WORD = "'[a-zA-Z0-9]+(?:[''’][a-zA-Z]+)*'"
STOP = "(" + ", ".join(f"'{w}'" for w in sorted(set(STOPWORDS))) + ")"
#: Sentences of column text.
SENTENCES = r"""list_filter(list_transform(string_split(replace(regexp_replace(text, '([.!?])(\s)', '\1' || chr(1) || '\2', 'g'), chr(10) || chr(10), chr(1)), chr(1)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')"""
#: CTEs: sentences with their words (doc_id, sent_idx, w).
SENTENCE_WORDS = f"""
    sx AS (SELECT doc_id, {SENTENCES} AS ss FROM documents),
    se AS (SELECT doc_id, unnest(ss) AS sentence, unnest(range(len(ss))) AS sent_idx FROM sx),
    sw AS (SELECT doc_id, sent_idx, regexp_extract_all(sentence, {WORD}) AS w FROM se)"""
#: And their n-grams of up to three words (doc_id, sent_idx, n, i, ws).
GRAMS = SENTENCE_WORDS + """,
    gn AS (SELECT doc_id, sent_idx, w, unnest([1, 2, 3]) AS n FROM sw),
    gi AS (SELECT doc_id, sent_idx, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM gn),
    grams AS (SELECT doc_id, sent_idx, n, i, list_slice(w, i, i + n - 1) AS ws FROM gi)"""
#: Markdown marks for replacement by their groups, in the order of the scanner's rules.
MARKS = r"(?s)---\n.*?\n---\n?|```.*?```|`[^`\n]+`|!\[[^\]]*\]\([^)]*\)|\[\[[^\]|]+\|([^\]]+)\]\]|\[\[([^\]]+)\]\]|\[([^\]]*)\]\([^)]*\)|<[^>]+>|https?://[^\s)]+|#{1,6}\s|\*{1,3}|_{1,2}"
NORM = "trim(strip_accents(regexp_replace(regexp_replace(lower({0}), '\\s+', ' ', 'g'), '''s\\b', '', 'g')))"
#: The titles of titles_of_documents.
TITLES = f"titles AS (SELECT array_to_string(list_slice(w, 1, 3), ' ') AS title, min(doc_id) AS ord FROM (SELECT doc_id, regexp_extract_all(text, {WORD}) AS w FROM documents) WHERE len(w) >= 3 GROUP BY 1)"


def titles_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(title, ord): the first three words of every document that has three."""
    w = tokens(F.col("text"))
    rows = documents(spark, sf_dir).select("doc_id", F.slice(w, 1, 3).alias("w")).where(F.size("w") == 3)
    return rows.groupBy(F.array_join("w", " ").alias("title")).agg(F.min("doc_id").alias("ord"))


def decorated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(note_id, title, content): documents with frontmatter, a heading, links and a footer around them."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name").where(F.col("p_partkey").between(-48, 50))  # no other key is met below
    docs = documents(spark, sf_dir)
    a, b = (parts.select(F.col("p_partkey").alias(f"k{x}"), F.col("p_name").alias(x)) for x in "ab")
    rows = docs.join(F.broadcast(a), F.col("doc_id") % 50 + 1 == F.col("ka")).join(F.broadcast(b), F.col("doc_id") % 49 + 2 == F.col("kb"))
    content = F.concat(F.lit("---\ntags: x\n---\n# "), F.initcap("a"), F.lit("\n\n"), F.col("text"), F.lit(" [["), F.initcap("a"), F.lit("]] ![[img.png]] [["), F.col("b"), F.lit("|see it]] [["), F.col("b"), F.lit("#part]]\n```\n[[code]]\n```\n%% wiki footer\n[[foot]]"))
    return rows.select(F.col("doc_id").alias("note_id"), F.initcap("a").alias("title"), content.alias("content"))


DECORATED = """
    nd AS (SELECT doc_id AS note_id, text, list_aggregate(list_transform(string_split(a.p_name, ' '), lambda x: upper(x[1]) || lower(x[2:])), 'string_agg', ' ') AS title, b.p_name AS other
        FROM documents JOIN part a ON a.p_partkey = doc_id % 50 + 1 JOIN part b ON b.p_partkey = doc_id % 49 + 2),
    notes AS (SELECT note_id, title, other, text, '---' || chr(10) || 'tags: x' || chr(10) || '---' || chr(10) || '# ' || title || chr(10) || chr(10) || text || ' [[' || title || ']] ![[img.png]] [[' || other || '|see it]] [[' || other || '#part]]' || chr(10)
        || '```' || chr(10) || '[[code]]' || chr(10) || '```' || chr(10) || '%% wiki footer' || chr(10) || '[[foot]]' AS content FROM nd)"""
