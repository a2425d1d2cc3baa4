"""Embedding near-dedup by Euclidean p-stable hashing with exact cosine checks.

Vectors are scaled to length 1, so cosine and distance say the same. A table hashes a vector by k
quantised random projections, floor((a.x + b) / w); vectors that agree in all k share a bucket. Several
tables make it likely that two vectors within the threshold meet at least once. k follows the number of
vectors so that a bucket of unrelated ones stays near `bucket` rows, and the number of tables follows k so
that a pair just at the threshold is found with probability `recall` (closer pairs are found more surely).

Equal vectors are one class from the start and count by their number. In a bucket all pairs are compared
in double precision by matrix products; what leaves it is a sum of links per vector and a spanning forest,
never the pairs. A pair that shares several tables is counted in the first one only: projections are done
in whole numbers, so a task can tell the other tables' buckets exactly, without being sent them. Buckets
with more than `block` rows are cut into blocks that meet two by two, so no task holds more.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing;
vectors of different lengths link with nothing of another length; equal vectors under different ids link
with each other, and so do rows that repeat an id; a null id takes part but is never the name of a
component; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import components, discard, join_classes, work_table
from .simhash_dedup import _cells, runs_of

#: Width of a projection's cells, for distances between vectors of length 1.
WIDTH = 1.8
#: Fixed-point scales of components, projections and their products.
X_BITS, A_BITS = 20, 16


def collision(distance: float, width: float = WIDTH) -> float:
    """Probability that one projection puts two vectors at this distance into one cell."""
    r = width / distance
    phi = 0.5 * math.erfc(r / math.sqrt(2))
    return 1 - 2 * phi - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def parameters(n: int, cosine: float, recall: float = 0.995, bucket: int = 256) -> tuple[int, int]:
    """(projections per table, tables) for n vectors."""
    near, far = collision(math.sqrt(2 - 2 * cosine)), collision(math.sqrt(2))
    k = max(4, math.ceil(math.log(max(n, 2) / bucket) / -math.log(far)))
    return k, math.ceil(math.log(1 - recall) / math.log1p(-(near**k)))


@lru_cache(maxsize=4)
def _projections(dims: int, k: int, tables: int, seed: int = 7):
    g = np.random.Generator(np.random.PCG64([seed, dims]))
    a = np.rint(g.standard_normal((dims, tables * k)) * 2**A_BITS)
    return a, g.integers(0, int(WIDTH * 2 ** (X_BITS + A_BITS)), tables * k)


def bucket_keys(units: np.ndarray, k: int, tables: int) -> np.ndarray:
    """(n, tables) bucket keys of unit vectors. All sums are of whole numbers below 2**53, so they are exact."""
    a, b = _projections(units.shape[1], k, tables)
    h = np.floor_divide((np.rint(units * 2**X_BITS) @ a).astype(np.int64) + b, int(WIDTH * 2 ** (X_BITS + A_BITS)))
    out = np.broadcast_to(np.arange(tables, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), (len(units), tables)).copy()
    h = h.reshape(len(units), tables, k).view(np.uint64)
    for i in range(k):
        out = (out ^ h[:, :, i]) * np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def _units(data: list[bytes], dtype: str) -> np.ndarray:
    x = np.frombuffer(b"".join(data), dtype).astype(np.float64).reshape(len(data), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _dealt(k: int, tables: int, dtype: str):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            ids, dims = b.column("cid").to_numpy(), b.column("dims").to_numpy()
            n, data = b.column("n").to_numpy(), np.array(b.column("v").to_pylist(), object)
            for d in np.unique(dims):
                at = np.nonzero(dims == d)[0]
                for i in range(0, len(at), 500):
                    rows = at[i : i + 500]
                    keys = bucket_keys(_units(data[rows].tolist(), dtype), k, tables)
                    m = len(rows) * tables
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys.ravel()), pa.array(np.tile(np.arange(tables, dtype=np.int32), len(rows))), pa.array(np.full(m, d, np.int32)), *(pa.array(np.repeat(c[rows], tables)) for c in (ids, n)), pa.array(np.repeat(data[rows], tables), pa.binary())],
                        names=["key", "tab", "dims", "cid", "n", "v"],
                    )

    return run


def _compared(k: int, tables: int, cosine: float, dtype: str, step: int = 1024):
    def bucket(tab: int, cell: int, cid: np.ndarray, n: np.ndarray, blk: np.ndarray, data: list[bytes]):
        """Rows (a, b, n): links of a (b is -1) and forest links (n is 0)."""
        units, size = _units(data, dtype), len(cid)
        keys = bucket_keys(units, k, tables)[:, :tab] if tab else None
        links, label, forest = np.zeros(size, np.int64), np.arange(size), []
        near = np.zeros((size, size), bool)
        for i in range(0, size, step):
            s = units[i : i + step] @ units.T
            close = np.abs(s - cosine) < 1e-12  # as near as rounding: by the plain formula
            for x, y in zip(*np.nonzero(close)):
                s[x, y] = math.fsum(units[i + x] * units[y])
            near[i : i + step] = s >= cosine
        near[label, label] = False
        for i in range(0, size, step):
            x, y = np.nonzero(near[i : i + step])
            x = x + i
            own = (blk[x] != blk[y]) | (blk[x] * 65536 + blk[x] == cell)
            for j in range(0, len(x), 200_000):
                p, q, ok = x[j : j + 200_000], y[j : j + 200_000], own[j : j + 200_000].copy()
                if keys is not None:
                    ok &= ~(keys[p] == keys[q]).any(1)
                np.add.at(links, p[ok], n[q[ok]])
        left = np.ones(size, bool)
        while left.any():
            queue = [int(np.argmax(left))]
            left[queue[0]] = False
            while queue:
                x = queue.pop()
                hit = np.nonzero(near[x] & left)[0]
                left[hit] = False
                forest += [(x, y) for y in hit.tolist()]
                queue += hit.tolist()
        some = np.nonzero(links)[0]
        out = [(cid[some], np.full(len(some), -1), links[some])]
        if forest:
            a, b = np.array(forest).T
            out.append((cid[a], cid[b], np.zeros(len(a), np.int64)))
        return out

    def run(batches):
        import pyarrow as pa

        for starts, (_, cell, tab, _, cid, n, blk, v) in runs_of(batches, 4):
            out = []
            for a, z in zip(starts, np.append(starts[1:], len(cid))):
                if z - a > 1:
                    out += bucket(int(tab[a]), int(cell[a]), cid[a:z], n[a:z], blk[a:z], v[a:z].tolist())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[i] for o in out]).astype(np.int64)) for i in range(3)], names=["u", "v", "n"])

    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9, recall: float = 0.995, block: int = 2048) -> DataFrame:
    """vec_id, n_links, component_id, kept per row of vectors."""
    v = vectors[vector_col]
    dtype = "<f4" if dict(vectors.dtypes)[vector_col] == "array<float>" else "<f8"
    kind = "float" if dtype == "<f4" else "double"
    x = lambda e: e.cast("double")
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(x(e)) & (F.abs(x(e)) < float("inf"))) & F.exists(v, lambda e: e != 0)
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), F.when(F.coalesce(fine, F.lit(False)), v.cast(f"array<{kind}>")).alias("vec"))
    found = rows.where("vec is not null").groupBy("vec").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first"))
    classes = work_table(found.select(F.monotonically_increasing_id().alias("cid"), "vec", "n", "first"), "classes")
    k, tables = parameters(classes.count(), cosine, recall)

    def packed(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("cid"), b.column("n"), pa.array([len(e) for e in b.column("vec")], pa.int32()), pa.array([np.asarray(e.values.to_numpy(zero_copy_only=False), dtype).tobytes() for e in b.column("vec")], pa.binary())], names=["cid", "n", "dims", "v"])

    bodies = classes.select("cid", "n", "vec").mapInArrow(packed, "cid long, n long, dims int, v binary")
    dealt = bodies.mapInArrow(_dealt(k, tables, dtype), "key long, tab int, dims int, cid long, n long, v binary")
    hot = work_table(classes.select("cid", "n", "vec").mapInArrow(packed, "cid long, n long, dims int, v binary").mapInArrow(_dealt(k, tables, dtype), "key long, tab int, dims int, cid long, n long, v binary").groupBy("key", "tab", "dims").count().where(F.col("count") > block), "hot_buckets")
    if hot.isEmpty():
        dealt = dealt.select("key", F.lit(0).alias("cell"), "tab", "dims", "cid", "n", F.lit(0).alias("blk"), "v")
    else:
        size = F.coalesce("count", F.lit(1))
        own = F.pmod(F.xxhash64("cid"), F.ceil(size / F.lit(block)).cast("int")).cast("int")
        dealt = dealt.join(hot, ["key", "tab", "dims"], "left").select("key", _cells(size, "cid", block).alias("cell"), "tab", "dims", "cid", "n", own.alias("blk"), "v")
    dealt = dealt.repartition("key", "cell", "tab", "dims").sortWithinPartitions("key", "cell", "tab", "dims")
    got = work_table(dealt.mapInArrow(_compared(k, tables, cosine, dtype), "u long, v long, n long"), "links")
    degree = got.where("v < 0").groupBy(F.col("u").alias("d_cid")).agg(F.sum("n").alias("others"))
    roots = components(got.where("v >= 0"))
    named = classes.select("cid", "vec", "n", "first").join(degree, F.col("cid") == F.col("d_cid"), "left").join(roots, F.col("cid") == F.col("node"), "left")
    named = work_table(named.select("vec", "n", "first", F.coalesce("root", "cid").alias("root"), (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links")), "named")
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    told = work_table(named.join(smallest, "root").select("vec", "n", "n_links", "component_id"), "told")
    discard(classes, got, named)
    linked = join_classes(rows.where("vec is not null"), told, ["vec"], "n").drop("vec")
    alone = rows.where("vec is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.unionByName(alone)
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
