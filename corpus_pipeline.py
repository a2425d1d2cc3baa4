"""Corpus pipeline: documents -> toxicity -> exact dedup -> near dedup -> surrogates -> packing.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns a
DataFrame; stages are written as Parquet to the shared folder and read again, so a lost executor costs
a stage at most. All but the last return the columns of documents.

Defined cases of all stages: null texts are texts without words (equal to empty ones in the dedups, where one
of them stays; clean; packed as the end id alone); rows that repeat an id are judged by their own text; of rows
that repeat in full one stays; ties are won by the smallest id; null ids lose to all others; other columns pass
through whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from linkloom.llm import exact_dedup, packing, pii, queries, simhash_dedup, toxicity
from linkloom.llm.common import small_batches, work_table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier scores as toxic."""
    model = toxicity.fit(docs, small_batches(spark).read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, model)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each set of equal texts."""
    return exact_dedup.keep_unique(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group linked by five-word shingles alike to 0.8: those that
    SimHash fingerprints within 3 bits bring together, by Golay keys, then what fingerprints miss; all checked exactly."""
    return simhash_dedup.keep_one_each(docs, width=5, similarity=0.8)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by surrogates; n_chars follows the new text."""
    out = pii.replace_entities(docs, pii.session_key(spark)).select(docs.columns)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of at most 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_dedup_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("pii_surrogates", pii_stage),
    ("best_fit_packing", packing_stage),
]

#: SQL can express neither the classifier nor the fingerprints; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = work_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
