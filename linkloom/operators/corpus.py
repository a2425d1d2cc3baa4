"""Corpora and vocabularies: cleaning, filters, ordered dedup, quotas, reservoirs, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.random import uniform
from ..functions.text import ascii_ratio, corpus_sentences, count_upper, is_stopword

# Title prefixes that mark pages which are no articles.
NAMESPACES = ("File:", "Category:", "Template:", "Wikipedia:", "Help:", "Portal:", "Draft:", "Module:", "MediaWiki:", "User:", "Talk:", "Special:")
SKIPPED = ("wikipedia:", "file:", "template:", "category:", "portal:", "help:", "mediawiki:", "list of", "index of", "outline of", "glossary of", "history of", "timeline of")
# What a label may start with.
LABEL_PREFIXES = ("Concept:", "concept:", "Label:", "label:", "Answer:", "answer:", "Common concept:", "Common theme:", "Common thread:", "Theme:")


def clean_title(raw: Column) -> Column:
    """Title without underscores, or null if it is no article title worth keeping."""
    s = F.trim(F.replace(raw, F.lit("_"), F.lit(" ")))
    solid = F.regexp_replace(s, "[ \t]", "")
    bad = (
        (F.length(s) < 3) | (F.length(s) > 80) | s.rlike("^[0-9]+$") | F.lower(s).contains("(disambiguation)")
        | s.rlike("(?i)^(list|index|outline) of ") | (F.length(solid) == 0)
    )
    for p in NAMESPACES:
        bad = bad | s.startswith(p)
    ratio = F.length(F.regexp_replace(solid, r"[^\x00-\x7F]", "")) / F.length(solid)
    return F.when(~bad & (ratio >= 0.8), s)


def short_phrase(raw: Column, max_tokens: int = 5, max_chars: int = 60, shortest: int = 2, bare: bool = False) -> Column:
    """Lower-case phrase of few words, or null; with bare, bracketed parts and hyphens go first."""
    s = F.lower(F.replace(F.trim(raw), F.lit("_"), F.lit(" ")))
    if bare:
        s = F.regexp_replace(F.replace(F.replace(raw, F.lit("_"), F.lit(" ")), F.lit("-"), F.lit(" ")), r"\([^)]*\)", "")
        s, shortest = F.lower(F.trim(F.regexp_replace(s, r"(?U)\s{2,}", " "))), 1
    words = F.size(F.filter(F.split(s, r"(?U)\s+"), lambda w: w != ""))
    return F.when((F.length(s) >= shortest) & (F.length(s) <= max_chars) & ~s.rlike(r"[(\[{<]") & words.between(1, max_tokens), s)


def wiki_phrase(raw: Column) -> Column:
    s = F.lower(F.replace(F.trim(raw), F.lit("_"), F.lit(" ")))
    bad = s.endswith("(disambiguation)")
    for p in SKIPPED:
        bad = bad | s.startswith(p)
    return F.when(~bad, short_phrase(raw))


def concept(raw: Column) -> Column:
    return F.lower(F.replace(raw, F.lit("_"), F.lit(" ")))


def valid_concept(c: Column) -> Column:
    return F.length(c).between(2, 64) & c.rlike("[a-z]") & c.rlike(r"^[a-z0-9 \-']+$") & ~is_stopword(c)


def keep_sentence(s: Column, shortest: int = 30, longest: int = 200) -> Column:
    return F.length(F.trim(s)).between(shortest, longest) & s.rlike("[a-zA-Z]")


def clean_label(raw: Column) -> Column:
    """First line of a labeller's answer without one known prefix and one pair of quotes; null unless 3..80 long."""
    s = F.trim(F.element_at(F.split(F.trim(raw), "\n"), 1))
    start = F.lit(None).cast("string")
    for p in reversed(LABEL_PREFIXES):
        start = F.when(s.startswith(p), F.lit(p)).otherwise(start)
    s = F.when(start.isNotNull(), F.trim(F.substr(s, F.length(start) + 1))).otherwise(s)
    quoted = (F.length(s) >= 2) & s.rlike("^[\"']") & (F.substring(s, 1, 1) == F.right(s, F.lit(1)))
    s = F.when(quoted, F.trim(F.substr(s, F.lit(2), F.length(s) - 2))).otherwise(s)
    return F.when(F.length(s).between(3, 80), s)


def dedup_lines(lines: DataFrame, *order: str) -> DataFrame:
    """One line per lower-case key, the first casing; trimmed, without blanks. lines: (line, <order>)."""
    rows = lines.withColumn("line", F.trim("line")).where("line <> ''")
    return rows.groupBy(F.lower("line").alias("key")).agg(F.min_by("line", F.struct(*order)).alias("line"), F.min(F.struct(*order)).alias("first"))


def dedup_prefer_cased(lines: DataFrame, *order: str) -> DataFrame:
    """One line per lower-case key: the one with most capitals A-Z, the first of equals."""
    return lines.groupBy(F.lower("line").alias("key")).agg(F.min_by("line", F.struct(-count_upper(F.col("line")), *order)).alias("line"))


def quota_union(phrases: DataFrame, quotas: dict[str, int]) -> DataFrame:
    """Ordered sources without what an earlier one has, each up to its quota. phrases: (source, ord, phrase).

    The quota counts what is left after the removal. Sources come in the order of quotas.
    """
    rank = F.create_map(*[F.lit(x) for i, s in enumerate(quotas) for x in (s, i)])
    limit = F.create_map(*[F.lit(x) for s, q in quotas.items() for x in (s, q)])
    placed = phrases.where(F.col("source").isin(*quotas)).withColumn("source_ord", F.element_at(rank, F.col("source")))
    first = placed.groupBy("phrase").agg(F.min(F.struct("source_ord", "ord", "source")).alias("f")).select("phrase", "f.*")
    w = Window.partitionBy("source").orderBy("ord", "phrase")
    most = max(quotas.values(), default=0)  # lets tasks cut a source before its rows are brought together
    ranked = first.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)
    return ranked.where(F.col("n") <= F.element_at(limit, F.col("source"))).select("source", "source_ord", "ord", "phrase", "n")


def reservoir(items: DataFrame, capacity: int, seed: int) -> DataFrame:
    """Reservoir sample of items (i, item), i = 1, 2, ... in stream order: (slot, i, item).

    Item i > capacity draws slot floor(u * i) from draw i - capacity of the generator and takes it if it is
    below capacity. The draws don't depend on each other, so the last taker of each slot is an aggregate.
    """
    i = F.col("i").cast("long")
    drawn = F.floor(uniform(seed, i - capacity) * i)
    slot = F.when(i <= capacity, i - 1).otherwise(drawn)
    return items.select(slot.cast("long").alias("slot"), i.alias("i"), "item").where(F.col("slot") < capacity).groupBy("slot").agg(F.max("i").alias("i"), F.max_by("item", "i").alias("item"))


def _drawn(seed: int, key: str) -> Column:
    return F.md5(F.concat_ws(" ", F.lit(seed).cast("string"), F.col(key).cast("string")))


def first_unseen(phrases: DataFrame, seen: DataFrame, quota: int) -> DataFrame:
    """(phrase, ord): the first `quota` distinct phrases in order that are not in seen (phrase). phrases: (phrase, ord)."""
    new = phrases.where("phrase is not null").groupBy("phrase").agg(F.min("ord").alias("ord"))
    return new.join(seen.select("phrase").distinct(), "phrase", "left_anti").orderBy("ord", "phrase").limit(quota)


def split_train(rows: DataFrame, key: str, seed: int = 0, share: float = 0.002, most: int = 4096) -> DataFrame:
    """rows with is_val: min(most, max(1, floor(n * share))) of them by a seeded hash order."""
    n = rows.count()
    n_val = min(most, max(1, int(n * share)))
    picked = rows.select(key).orderBy(_drawn(seed, key), key).limit(n_val).withColumn("is_val", F.lit(True))
    return rows.join(picked, key, "left").withColumn("is_val", F.coalesce("is_val", F.lit(False)))


def sample_rows(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement, in a seeded hash order."""
    return rows.orderBy(_drawn(seed, key), key).limit(n)


def sentence_corpus(abstracts: DataFrame, text_col: str = "abstract", most: int = 1_000_000) -> DataFrame:
    """Kept sentences of abstracts, one per lower-case key, in order: (line, ord, place)."""
    rows = abstracts.select("ord", F.posexplode(corpus_sentences(F.col(text_col))).alias("place", "line")).where(keep_sentence(F.col("line")))
    return dedup_lines(rows, "ord", "place").orderBy("first").limit(most).select("line", "first.ord", "first.place")


def manifest(corpus: DataFrame) -> DataFrame:
    """Counts per source of what was seen, kept by the filter and distinct. corpus: (source, line, kept)."""
    return corpus.groupBy("source").agg(F.count(F.lit(1)).alias("seen"), F.count_if("kept").alias("kept"), F.countDistinct(F.when(F.col("kept"), F.lower("line"))).alias("distinct_lines"))


def mostly_latin(text: Column, share: float = 0.8) -> Column:
    return ascii_ratio(text) >= share
