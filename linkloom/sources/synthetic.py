"""Synthetic concept mixtures: vectors near sums of two of a few unit vectors, from a counter-based generator."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..functions.random import gaussian_at, uniform_at


def concepts(n: int = 48, dims: int = 16, seed: int = 0xA5A5A5) -> np.ndarray:
    x = np.array([[gaussian_at(seed, r * dims + c + 1) for c in range(dims)] for r in range(n)])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def mixtures(spark: SparkSession, rows: int = 4096, n_concepts: int = 48, dims: int = 16, noise: float = 0.05, seed: int = 0xA5A5A5) -> DataFrame:
    """(id, v, a, b): v = w1 * concept a + w2 * concept b + noise, of length 1. Row i depends on i alone."""
    base = concepts(n_concepts, dims, seed)

    def run(batches):
        for batch in batches:
            ids = batch.column("id").to_pylist()
            out, aa, bb = [], [], []
            for i in ids:
                s = seed ^ (i + 1) * 0x9E3779B1 & 0xFFFFFFFF
                a, b = int(uniform_at(s, 1) * n_concepts), int(uniform_at(s, 2) * n_concepts)
                v = (0.5 + uniform_at(s, 3)) * base[a] + 0.5 * uniform_at(s, 4) * base[b] + noise * np.array([gaussian_at(s, 10 + d) for d in range(dims)])
                out.append(v / np.linalg.norm(v))
                aa.append(a)
                bb.append(b)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.list_(pa.float64())), pa.array(aa, pa.int32()), pa.array(bb, pa.int32())], names=["id", "v", "a", "b"])

    return spark.range(rows).mapInArrow(run, "id long, v array<double>, a int, b int")
