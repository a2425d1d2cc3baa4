"""Helpers shared by the training-data operators: durable work tables, tokenizer access, components.

Every helper is deterministic given its input table, so a task that is run again on another
executor after a loss yields the same rows.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

SPECIAL = "<|endoftext|>"


def work_dir(spark: SparkSession) -> str:
    """The application's folder below the shared one that spark.checkpoint.dir names.

    Where that is unset, a temporary one, but only in local mode (tests): on a cluster the executors would
    each write to their own disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = os.path.join(tempfile.gettempdir(), "checkpoints")
    return f"{base}/linkloom-{spark.sparkContext.applicationId}"


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def work_table(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends in durable files.

    The folder of an application's tables goes when the application ends; discard() removes a table before.
    """
    spark = df.sparkSession
    fs, at = _file_system(spark, work_dir(spark))
    fs.deleteOnExit(at)
    path = f"{work_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    object.__setattr__(out, "_work_path", path)
    return out


def discard(*tables: DataFrame) -> None:
    """Removes work tables that nothing reads any more."""
    for t in tables:
        fs, at = _file_system(t.sparkSession, t.__dict__["_work_path"])
        fs.delete(at, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores added for as long as df has a column that Spark takes for the same."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def join_classes(rows: DataFrame, classes: DataFrame, keys: list[str], size: str, how: str = "inner", most: int = 1000) -> DataFrame:
    """rows joined with classes (one row per key, size: how many rows have it), whatever part of the rows has
    one key: at most `most` classes that are larger than their share are sent to the rows, the others are
    joined by key. Columns: those of rows, then those of classes but keys and size."""
    others = [c for c in classes.columns if c not in keys and c != size]
    share = max(1000, (classes.agg(F.sum(size)).first()[0] or 0) // most)  # so fewer than `most` are larger
    names = fresh(rows, *(f"_{k}" for k in keys))
    named = classes.select(*(F.col(k).alias(n) for k, n in zip(keys, names)), *others, F.col(size).alias("_size"))
    on = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names)]
    hot, rest = F.broadcast(named.where(F.col("_size") > share).drop("_size")), named.where(F.col("_size") <= share).drop("_size")
    picked = [*rows.columns, *others]
    a = rows.join(hot, on).select(picked)
    cold = rows.join(hot.select(names), on, "left_anti")
    return a.unionByName(cold.join(rest, on, how).select(picked))


@lru_cache(maxsize=2)
def bpe(ranks_path: str):
    """Byte-level BPE of a rank file with the published split pattern, without special tokens."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def special_id(json_path: str) -> int:
    """Id of the end-of-text token in a tokenizers file."""
    import json

    with open(json_path, encoding="utf-8") as f:
        return next(t["id"] for t in json.load(f)["added_tokens"] if t["content"] == SPECIAL)


def encode(text: str, enc, special: int) -> list[int]:
    """Ids as the tokenizers library gives them without extra special tokens: the special string,
    where a text holds it, is one id."""
    if SPECIAL not in text:
        return enc.encode_ordinary(text)
    out: list[int] = []
    for i, part in enumerate(text.split(SPECIAL)):
        if i:
            out.append(special)
        out += enc.encode_ordinary(part)
    return out


def texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id long, text) of docs. Python tasks cut what they are sent with byte_batches."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def give_back() -> None:
    """Returns unused memory of this process to the system."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def small_batches(spark: SparkSession) -> SparkSession:
    """For applications, which own their session: sends Python few rows and bytes at a time, so that executors
    need little memory. Operators work with any batches and leave settings alone."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    return spark


def _slices(sizes: int, rows: int, limit: int) -> Iterator[tuple[int, int]]:
    parts = max(1, min(rows, -(-sizes // limit)))
    step = max(1, -(-rows // parts))
    for i in range(0, rows, step):
        yield i, step


def byte_batches(batches, column: str, limit: int = 4 << 20):
    """Cuts record batches so that the texts of one slice stay near limit bytes, whatever a batch holds. Behind
    the last one the task gives back the memory that it no longer uses, as its process goes on to other tasks."""
    for batch in batches:
        for i, n in _slices(batch.column(column).nbytes if batch.num_rows else 0, batch.num_rows, limit):
            yield batch.slice(i, n)
        batch = None
    give_back()


def byte_slices(array, limit: int = 4 << 20):
    """The same of a single column, as lists of Python values."""
    for i, n in _slices(array.nbytes if len(array) else 0, len(array), limit):
        yield array.slice(i, n).to_pylist()


#: Odd multipliers of a bijective mixing of 64-bit numbers, and their inverses.
MIX = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)
UNMIX = tuple(pow(m, -1, 1 << 64) for m in MIX)


def mixed(x: np.ndarray) -> np.ndarray:
    """Numbers in an order that has nothing to do with theirs; one to one."""
    x = x.view(np.uint64)
    for m in MIX:
        x = (x ^ (x >> np.uint64(33))) * np.uint64(m)
    return (x ^ (x >> np.uint64(33))).view(np.int64)


def unmixed(x: np.ndarray) -> np.ndarray:
    x = x.view(np.uint64)
    for m in reversed(UNMIX):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(m)
    return (x ^ (x >> np.uint64(33))).view(np.int64)


def _mapped(change, names: list[str]):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(change(c.to_numpy(zero_copy_only=False))) for c in b.columns], names=names)

    return run


#: So many links at most are brought together in one task.
MOST_LINKS = 200_000


def _local_forest(loops: bool = False):
    """Replaces the links of one partition by a spanning forest of stars (root, member); the root is the smallest.
    With loops, (root, root) is among them."""

    def run(batches):
        import pyarrow as pa

        parent: dict[int, int] = {}

        def find(x: int) -> int:
            root = x
            while parent[root] != root:
                root = parent[root]
            while parent[x] != root:
                parent[x], x = root, parent[x]
            return root

        for b in batches:
            for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                parent.setdefault(u, u)
                parent.setdefault(v, v)
                a, c = find(u), find(v)
                if a != c:
                    parent[max(a, c)] = min(a, c)
        out = [(r, x) for x in parent if (r := find(x)) != x or loops]
        for i in range(0, len(out), 50_000):
            part = out[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in part], pa.int64()), pa.array([p[1] for p in part], pa.int64())], names=["u", "v"])

    return run


def components(links: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, root) for every node of links: root is the smallest node reachable.

    Every task first replaces its links by a spanning forest; if at most MOST_LINKS are left, one task joins them.
    Otherwise links contract: every node points to its smallest neighbour, pointers are followed twice, links are
    redrawn between the targets, until few enough are left; then the maps are composed and every component takes
    its smallest node. "Smallest" is meant after a one-to-one mixing of the numbers while links contract, so
    whatever order nodes have along a chain, a round leaves a fixed part of them at most and the rounds
    are logarithmic in the number of nodes. All joins are on nodes of the shrinking graph; min() combines before
    the shuffle, so hubs don't gather in a task. Links whose ends are null or equal are ignored.
    """
    forest = lambda df, loops=False: df.mapInArrow(_local_forest(loops), "u long, v long")
    edges = links.select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v")).where("u is not null and v is not null and u <> v")
    edges = work_table(forest(edges), "links")
    if edges.count() <= MOST_LINKS:
        out = work_table(forest(edges.coalesce(1), True).select(F.col("v").alias("node"), F.col("u").alias("root")), "roots")
        discard(edges)
        return out
    plain, edges = edges, work_table(forest(edges.mapInArrow(_mapped(mixed, ["u", "v"]), "u long, v long")), "links")
    discard(plain)
    maps: list[DataFrame] = []
    while edges.count() > MOST_LINKS:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        near = work_table(near, "near")
        up = near.select(F.col("u").alias("k"), F.col("m").alias("mm"))
        hop = work_table(near.join(up, F.col("m") == F.col("k")).select("u", F.col("mm").alias("m")), "hop")
        maps.append(hop)
        a = hop.select(F.col("u").alias("k1"), F.col("m").alias("m1"))
        c = hop.select(F.col("u").alias("k2"), F.col("m").alias("m2"))
        redrawn = edges.join(a, F.col("u") == F.col("k1")).join(c, F.col("v") == F.col("k2"))
        redrawn = redrawn.select(F.least("m1", "m2").alias("u"), F.greatest("m1", "m2").alias("v")).where("u <> v").distinct()
        left = work_table(forest(redrawn), "links")
        discard(edges, near)
        edges = left
    maps.append(work_table(forest(edges.coalesce(1), True).select(F.col("v").alias("u"), F.col("u").alias("m")), "hop"))
    discard(edges)
    out = maps[0].select(F.col("u").alias("node"), F.col("m").alias("root"))
    for later in maps[1:]:
        nxt = later.select(F.col("u").alias("k"), F.col("m").alias("up"))
        out = out.join(nxt, F.col("root") == F.col("k"), "left").select("node", F.coalesce("up", "root").alias("root"))
    out = work_table(out.mapInArrow(_mapped(unmixed, ["node", "root"]), "node long, root long"), "members")
    least = work_table(out.groupBy("root").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("n")), "least")
    named = work_table(join_classes(out, least, ["root"], "n").select("node", F.col("least").alias("root")), "roots")
    discard(*maps, out, least)
    return named


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)
