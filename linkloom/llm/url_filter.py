"""URL filter: a blocked Bloom filter of the listed canonical URLs in front of an exact hash join.

A rule is (host, path, action). It fits its host and every subdomain of it if the URL's path starts
with the rule's; of several the one with the longest host, then the longest path, wins, and a tie goes
to allow. A URL's lookup keys are its host's suffixes times its path's prefixes of the lengths that
rules have. Each key is tested against the filter: one 512-bit block, found by one hash, holds all of a
key's bits. Keys that pass are joined exactly with the rules, which removes the false positives; no
key of a rule is ever lost. Only distinct (host, path start) pairs with a possible hit are joined, so a
host that has a third of all pages is looked up once per path start, and the answers of the most frequent
pairs are sent to the pages instead of the pages to them. Without a rule a URL is not listed: allowed.

The filter has `bits_per_key` bits per rule up to `max_filter_bytes` (beyond that only its false
positives grow); it is built by a distributed bitwise-or and sent as one literal of proven size.

Defined cases: null URLs and those without "://" have an empty host and path and no rule; rules with a
null or empty host are ignored, a null path is empty; repeated rules count once, rows are judged each;
empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import discard, join_classes, work_table

#: Upper and lower case letters that a host folds.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits set per key inside its block.
PROBES = 6


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffixes(host: Column) -> Column:
    """The host itself and what follows each of its dots, longest first."""
    parts = F.split(host, r"\.")
    n = F.size(parts)
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, i, n - i + 1), ".")))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _bit(key: Column, i: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(i), key), F.lit(512)).cast("int")


def build_filter(keys: DataFrame, n: int, bits_per_key: int = 16, max_filter_bytes: int = 4 << 20) -> tuple[int, dict[int, list[int]]]:
    """(number of blocks, words of the blocks that have any bit): eight 64-bit words a block."""
    blocks = max(1, min(-(-n * bits_per_key // 512), max_filter_bytes // 64))
    bits = keys.select(_block(F.col("key"), blocks).alias("block"), F.explode(F.array(*[_bit(F.col("key"), i) for i in range(PROBES)])).alias("bit"))
    words = [F.bit_or(F.when(F.floor(F.col("bit") / 64) == w, F.expr("shiftleft(1L, bit % 64)")).otherwise(F.lit(0).cast("long"))).alias(f"w{w}") for w in range(8)]
    return blocks, {r["block"]: [r[f"w{w}"] for w in range(8)] for r in bits.groupBy("block").agg(*words).collect()}


def may_hold(key: Column, blocks: int, words: Column) -> Column:
    """False only for keys that are surely not in the filter; words: array of all blocks' words."""
    at = _block(key, blocks) * 8
    out = F.lit(True)
    for i in range(PROBES):
        bit = _bit(key, i)
        word = F.get(words, at + F.floor(bit / 64).cast("int"))
        out = out & (F.call_function("getbit", word, bit % 64) == 1)
    return out


def filter_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", id_col: str = "page_id", bits_per_key: int = 16, max_filter_bytes: int = 4 << 20, broadcast_rules: int = 10_000) -> DataFrame:
    """page_id, host, path, rule, verdict per row of pages; rules: (host, path, action)."""
    spark = pages.sparkSession
    listed = rules.select(F.translate("host", UPPER, LOWER).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"), "action").where("r_host <> ''")
    listed = listed.groupBy("r_host", "r_path").agg(F.min("action").alias("action"))  # allow before block
    listed = work_table(listed.withColumn("key", F.concat("r_host", F.lit("\n"), "r_path")), "rules")
    n = listed.count()
    lengths = sorted(r[0] for r in listed.select(F.length("r_path")).distinct().collect())  # lengths of paths, not paths
    blocks, filled = build_filter(listed, n, bits_per_key, max_filter_bytes)
    flat = [w for b in range(blocks) for w in filled.get(b, [0] * 8)]

    rows = pages.select(pages[id_col].alias("page_id"), host_of(pages[url_col]).alias("host"), path_of(pages[url_col]).alias("path"))
    if not n:
        return rows.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    start = F.substring("path", 1, max(lengths))  # all that a rule can look at
    words = spark.createDataFrame([(flat,)], "words array<long>")
    hosted = rows.where("host <> ''").withColumn("start", start)
    distinct = work_table(hosted.groupBy("host", "start").agg(F.count(F.lit(1)).alias("n")), "hosts")
    prefixes = F.array(*[F.when(F.length("start") >= k, F.substring("start", 1, k)) for k in lengths])
    keys = F.flatten(F.transform(suffixes(F.col("host")), lambda h: F.transform(F.filter(prefixes, lambda p: p.isNotNull()), lambda p: F.concat(h, F.lit("\n"), p))))
    tried = distinct.withColumn("keys", keys).crossJoin(F.broadcast(words))  # one row of at most max_filter_bytes
    hits = tried.select("host", "start", F.explode(F.filter("keys", lambda k: may_hold(k, blocks, F.col("words")))).alias("key"))
    small = F.broadcast(listed) if n <= broadcast_rules else listed.hint("shuffle_hash")
    rank = F.struct(F.length("r_host"), F.length("r_path"), F.col("r_host"), F.col("r_path"))
    sure = hits.join(small, "key").groupBy("host", "start").agg(F.max_by(F.struct(F.concat("r_host", "r_path").alias("rule"), "action"), rank).alias("hit"))
    answers = work_table(distinct.join(sure, ["host", "start"], "left").select("host", "start", "n", "hit"), "answers")
    discard(distinct, listed)
    nowhere = rows.where("host = ''").select("page_id", "host", "path", F.lit(None).cast(answers.schema["hit"].dataType).alias("hit"))
    out = join_classes(hosted, answers, ["host", "start"], "n").drop("start").unionByName(nowhere)
    return out.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.action", F.lit("allow")).alias("verdict"))
