"""Binary files of vectors and weights (layouts are fixed by their readers), and a raw matrix with a manifest."""

from __future__ import annotations

import hashlib
import json
import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..operators.sae import Weights

# Magic words and version of the two layouts.
VECTORS_MAGIC, VECTORS_VERSION, WEIGHTS_MAGIC = b"NXEB", 1, b"SAE1"


def dump_vectors(vectors: dict[str, np.ndarray], dim: int) -> bytes:
    """Header (magic, version, dim, count), then per entry its text's length, its text and dim floats."""
    out = [VECTORS_MAGIC, struct.pack("<III", VECTORS_VERSION, dim, len(vectors))]
    for text, v in vectors.items():
        if len(v) != dim:
            raise ValueError(f"vector of {text!r} has {len(v)} dimensions, not {dim}")
        raw = text.encode()
        out += [struct.pack("<I", len(raw)), raw, np.asarray(v, "<f4").tobytes()]
    return b"".join(out)


def load_vectors(data: bytes) -> tuple[int, dict[str, np.ndarray]]:
    if len(data) < 16:
        raise ValueError("vector file is too short")
    if data[:4] != VECTORS_MAGIC:
        raise ValueError("vector file has another magic word")
    version, dim, count = struct.unpack_from("<III", data, 4)
    if version != VECTORS_VERSION:
        raise ValueError(f"vector file has version {version}")
    out, at = {}, 16
    for _ in range(count):
        (n,) = struct.unpack_from("<I", data, at)
        end = at + 4 + n
        if end + 4 * dim > len(data):
            raise ValueError("vector file is too short")
        out[data[at + 4 : end].decode()] = np.frombuffer(data, "<f4", dim, end).copy()
        at = end + 4 * dim
    return dim, out


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(text, v) of vector files; each file is parsed whole in a task."""
    return parse_vectors(spark.read.format("binaryFile").load(path).select("content"))


def parse_vectors(files: DataFrame) -> DataFrame:
    """(text, v) of the contents (content) of vector files."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for data in b.column("content").to_pylist():
                _, m = load_vectors(data)
                yield pa.RecordBatch.from_arrays([pa.array(list(m), pa.string()), pa.array([v.tolist() for v in m.values()], pa.list_(pa.float32()))], names=["text", "v"])

    return files.select("content").mapInArrow(run, "text string, v array<float>")


def dump_weights(w: Weights) -> bytes:
    """Magic, header length, JSON header padded with spaces to four bytes, then the arrays as floats."""
    head = json.dumps({"dModel": w.enc.shape[1], "dHidden": w.enc.shape[0], "k": w.k}, separators=(",", ":")).encode()
    head += b" " * (-(8 + len(head)) % 4)
    arrays = (w.enc, w.enc_bias, w.pre_bias, w.dec.T, w.dec_bias)
    return b"".join([WEIGHTS_MAGIC, struct.pack("<I", len(head)), head, *(np.ascontiguousarray(a, "<f4").tobytes() for a in arrays)])


def load_weights(data: bytes, atoms_as_rows: bool = False) -> Weights:
    """Weights of a file; atoms_as_rows for files whose decoder is stored atom by atom."""
    if data[:4] != WEIGHTS_MAGIC:
        raise ValueError("weights file has another magic word")
    (n,) = struct.unpack_from("<I", data, 4)
    head = json.loads(data[8 : 8 + n])
    m, h = head["dModel"], head["dHidden"]
    sizes = [h * m, h, m, m * h, m]
    if len(data) - 8 - n < 4 * sum(sizes):
        raise ValueError("weights file is too short")
    parts = np.split(np.frombuffer(data, "<f4", sum(sizes), 8 + n), np.cumsum(sizes)[:-1])
    dec = parts[3].reshape(h, m) if atoms_as_rows else parts[3].reshape(m, h).T
    return Weights(parts[0].reshape(h, m), parts[1], parts[2], dec, parts[4], head["k"])


def manifest(model: str, dims: int, lines: list[str], written: int = 0) -> dict:
    """What a raw matrix of embeddings belongs to; a run resumes only if all but rowsWritten agree."""
    return {"model": model, "dims": dims, "totalRows": len(lines), "rowsWritten": written, "inputSha256": hashlib.sha256("\n".join(lines).encode()).hexdigest(), "complete": written == len(lines)}


def resume_row(old: dict | None, new: dict, size: int) -> int:
    """Row to go on from: the file's size counts, not the manifest's number; 0 if anything differs."""
    same = old and all(old.get(k) == new[k] for k in ("model", "dims", "totalRows", "inputSha256"))
    row = 4 * new["dims"]
    return size // row if same and size % row == 0 and size // row <= new["totalRows"] else 0


def read_matrix(spark: SparkSession, path: str, dims: int) -> DataFrame:
    """(id, v) of the rows of a raw matrix file, numbered from 0; the file is split between tasks by its records."""
    records = spark.sparkContext.binaryRecords(path, 4 * dims).zipWithIndex().map(lambda r: (r[1], bytearray(r[0])))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = np.frombuffer(b"".join(b.column("raw").to_pylist()), "<f4")
            offsets = pa.array(np.arange(0, len(rows) + 1, dims), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.ListArray.from_arrays(offsets, pa.array(rows))], names=["id", "v"])

    return spark.createDataFrame(records, "id long, raw binary").mapInArrow(run, "id long, v array<float>")


def load_matrix(data: bytes, dims: int) -> np.ndarray:
    return np.frombuffer(data, "<f4").reshape(-1, dims)
