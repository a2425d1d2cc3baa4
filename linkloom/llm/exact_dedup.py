"""Exact dedup by a tree merge of sorted digest runs, in DataFrame functions only.

Every row is digested once (SHA-256 of the normalised text, with its length and a second hash as
verifier) and dealt to one of a number of runs (one for each `rows_per_run` rows, a power of `fan_in`) by a hash
of its row number, so a group of copies that holds a third of all rows is spread over all runs. A run keeps one row per digest: the best row so far and
how many rows it stands for. Rounds of a `fan_in`-way merge join runs 0..f-1, f..2f-1, ... until one
is left; each round aggregates on (run, digest), so it is a merge of digest-sorted runs without any
task that sees a whole run. Rows whose digest agrees but whose verifier doesn't are not merged. The
winners then descend: digest -> the at most `runs` rows of the first level -> the documents.

Defined cases: null text counts as empty; a null id loses to any id; of rows that repeat in full one
stays; an empty table gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import fresh, work_table

#: The white space that doesn't count, [\x20\x09-\x0D] (fixed by the contract).
BLANKS = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for c in BLANKS:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One narrow row per document; the only pass over the texts."""
    rows = docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        F.monotonically_increasing_id().alias("row"),
        F.length(F.coalesce(docs[text_col], F.lit(""))).cast("long").alias("chars"),
        normalised(docs[text_col]).alias("norm"),
    )
    return rows.select("doc_id", "row", "chars", F.unhex(F.sha2("norm", 256)).alias("digest"), F.octet_length("norm").alias("bytes"), F.xxhash64("norm").alias("check"))


KEY = ["digest", "bytes", "check"]


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: int | None = None, fan_in: int = 4, rows_per_run: int = 1 << 20) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, row, chars for every row of docs.

    kept marks exactly one row of each group: most code points, then smallest id, then first row.
    """
    rows = work_table(digests(docs, id_col, text_col), "digests")
    if runs is None:
        runs, n = fan_in * fan_in, rows.count()
        while runs * rows_per_run < n:
            runs *= fan_in
    rows = rows.withColumn("run", F.pmod(F.xxhash64("row"), F.lit(runs)))
    best = F.struct("chars", F.bitwise_not("doc_id").alias("neg_id"), F.bitwise_not("row").alias("neg_row"))
    first = rows.groupBy("run", *KEY).agg(F.max(best).alias("best"), F.count(F.lit(1)).alias("n"))
    first = work_table(first, "runs")
    level, left = first, runs
    while left > 1:
        level = level.groupBy(F.floor(F.col("run") / fan_in).alias("run"), *KEY).agg(F.max("best").alias("best"), F.sum("n").alias("n"))
        left = -(-left // fan_in)
    won = level.select(*KEY, F.col("best").alias("won"), F.col("n").alias("group_size"))
    down = first.join(won, KEY).select("run", *KEY, "won", "group_size")
    out = rows.join(down, ["run", *KEY])
    return out.select(
        "doc_id",
        F.bitwise_not("won.neg_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.bitwise_not("won.neg_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "row",
        "chars",
    )


def keep_unique(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that exact_dedup keeps, with all their columns, whatever their names.

    The texts are joined on (id, digest) with the kept rows; rows that repeat in full are told apart
    by a counter only where the table has any.
    """
    judged = work_table(exact_dedup(docs, id_col, text_col), "judged")
    k_id, k_sha, k_chars = fresh(docs, "_k_id", "_k_sha", "_k_chars")
    kept = judged.where("kept").select(F.col("doc_id").alias(k_id), F.col("text_sha256").alias(k_sha), F.col("chars").alias(k_chars))
    same = judged.groupBy("doc_id", "text_sha256", "chars").count().where("count > 1").limit(1)
    sha = F.sha2(normalised(docs[text_col]), 256)
    on = docs[id_col].cast("long").eqNullSafe(F.col(k_id)) & (sha == F.col(k_sha)) & (F.length(F.coalesce(docs[text_col], F.lit(""))).cast("long") == F.col(k_chars))
    out = docs.join(kept.hint("shuffle_hash"), on, "left_semi")  # texts are not sorted
    return out.dropDuplicates([id_col, text_col]) if not same.isEmpty() else out
