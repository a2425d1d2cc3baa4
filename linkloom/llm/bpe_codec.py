"""BPE encoding with reuse of content-defined chunks, and decoding.

A rolling hash over 8-byte windows cuts every text into chunks whose borders depend on the nearby
bytes only, so texts that share a passage share its chunks wherever it stands. Chunks are counted over
all documents; those seen again and worth most are encoded once into a shared dictionary, and each task
also remembers the chunks it has met (both bounded in bytes; a chunk in neither is encoded in place, so
the ids never depend on what is remembered).

Joins are repaired by re-encoding. A lone space between two letters or digits always starts a token
group of the split pattern, whatever stands around it, and so does a punctuation mark (no apostrophe) behind a letter
or digit, which texts without spaces have too; to its right and left the ids of a chunk
alone and of the whole text agree. Between the last such place of one chunk and the first of the
next, the text is encoded again; a chunk that has none is taken into the re-encoded part, which grows
until a place of agreement follows. The end-of-text string is cut out first, as added tokens are.

Decoding joins the vocabulary's bytes and reads them as UTF-8 with replacement of invalid bytes.

Defined cases: null text counts as empty (no ids); repeated rows are encoded each; very long texts are
handled in chunks; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections import OrderedDict
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import SPECIAL, bpe, byte_batches, special_id, texts, tokenizer_path, work_table

#: Average, smallest and largest chunk in bytes.
MASK_BITS, SMALLEST, LARGEST = 10, 256, 8192
GEAR = np.uint64(0x9E3779B97F4A7C15)
#: Where ids of a part and of the whole agree: behind a match.
AGREE = re.compile(r"[^\W_](?= [^\W_]|[-.,;:!?()\[\]{}<>/\"。、，．！？：；・「」『』（）【】《》…—–،؛؟।])")


def borders(data: bytes) -> list[int]:
    """Ends of the chunks of a UTF-8 text, never inside a character."""
    n = len(data)
    if n <= SMALLEST:
        return [n] if n else []
    raw = np.frombuffer(data, np.uint8)
    windows = np.ndarray((n - 7,), "<u8", buffer=data, strides=(1,))
    hit = (windows * GEAR) >> np.uint64(64 - MASK_BITS) == 0
    at = np.nonzero(hit)[0] + 8
    at = at[at < n]
    at = at[(raw[at] & 0xC0) != 0x80]
    out, last = [], 0
    for e in at.tolist():
        if e - last < SMALLEST:
            continue
        while e - last > LARGEST:
            last = _character(raw, last + LARGEST)
            out.append(last)
        if e - last >= SMALLEST:
            out.append(e)
            last = e
    while n - last > LARGEST:
        last = _character(raw, last + LARGEST)
        out.append(last)
    return [*out, n]


def _character(raw: np.ndarray, at: int) -> int:
    while raw[at] & 0xC0 == 0x80:
        at -= 1
    return at


def chunks(text: str) -> list[bytes]:
    data = text.encode("utf-8", "surrogatepass")
    out, last = [], 0
    for e in borders(data):
        out.append(data[last:e])
        last = e
    return out


def digest(chunk: bytes) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(chunk)


def parts(chunk: str, enc) -> tuple[str, list[int] | None, str]:
    """Head, ids of the middle, tail: the middle lies between the first and last place of agreement."""
    first = AGREE.search(chunk)
    if first is None:
        return chunk, None, ""
    a = at = first.end()
    size = 64
    while size < 4 * len(chunk):  # the last place, looked for in ever longer ends
        for m in AGREE.finditer(chunk, max(a, len(chunk) - size)):
            at = m.end()
        if at > a:
            break
        size *= 4
    return chunk[:a], enc.encode_ordinary(chunk[a:at]), chunk[at:]


def _cost(entry: tuple) -> int:
    """About how many bytes a remembered chunk takes."""
    return 400 + len(entry[0]) + len(entry[2]) + 8 * len(entry[1] or ())


class Encoder:
    """Encodes texts chunk by chunk; `known` holds shared chunks, `limit` bounds the bytes remembered."""

    def __init__(self, enc, special: int, known: dict[bytes, tuple] | None = None, limit: int = 32 << 20):
        self.enc, self.special, self.known, self.limit = enc, special, known or {}, limit
        self.seen: OrderedDict[bytes, tuple] = OrderedDict()
        self.held = self.reused = 0

    def _parts(self, chunk: bytes) -> tuple:
        key = digest(chunk)
        got = self.known.get(key)
        if got is not None:
            self.reused += 1
            return got[0], None if got[1] is None else np.asarray(got[1]).tolist(), got[2]
        got = self.seen.get(key)
        if got is not None:
            self.reused += 1
            return got
        got = self.seen[key] = parts(chunk.decode("utf-8", "surrogatepass"), self.enc)
        self.held += _cost(got)
        while self.held > self.limit and self.seen:
            self.held -= _cost(self.seen.popitem(last=False)[1])
        return got

    def _ordinary(self, text: str) -> list[int]:
        if len(text) <= SMALLEST:
            return self.enc.encode_ordinary(text)
        out: list[int] = []
        open_: list[str] = []
        for chunk in chunks(text):
            head, ids, tail = self._parts(chunk)
            open_.append(head)
            if ids is not None:
                out += self.enc.encode_ordinary("".join(open_))
                out += ids
                open_ = [tail]
        return out + self.enc.encode_ordinary("".join(open_))

    def __call__(self, text: str) -> list[int]:
        out: list[int] = []
        for i, part in enumerate(text.split(SPECIAL)):
            if i:
                out.append(self.special)
            out += self._ordinary(part)
        return out


@lru_cache(maxsize=2)
def vocabulary(json_path: str) -> tuple[bytes, ...]:
    """The bytes of every id of a byte-level tokenizers file."""
    import json

    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in keep)}
    with open(json_path, encoding="utf-8") as f:
        j = json.load(f)
    out = [b""] * (1 + max([*j["model"]["vocab"].values(), *(t["id"] for t in j["added_tokens"])]))
    for piece, i in j["model"]["vocab"].items():
        out[i] = bytes(byte_of[c] for c in piece) if all(c in byte_of for c in piece) else piece.encode()
    for t in j["added_tokens"]:
        out[t["id"]] = t["content"].encode()
    return tuple(out)


def decode(ids: list[int], vocab: tuple[bytes, ...]) -> str:
    return b"".join([vocab[i] for i in ids]).decode("utf-8", "replace")


def _counted(batches):
    import pyarrow as pa

    for b in byte_batches(batches, "text"):
        n: dict[bytes, list[int]] = {}
        for text in b.column("text").to_pylist():
            for part in (text or "").split(SPECIAL):
                if len(part) > SMALLEST:
                    for c in chunks(part):
                        n.setdefault(digest(c), [0, len(c)])[0] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array([v[0] for v in n.values()], pa.int64()), pa.array([v[1] for v in n.values()], pa.int64())], names=["digest", "n", "bytes"])


def _fetched(wanted: frozenset[bytes]):
    def run(batches):
        import pyarrow as pa

        sent: set[bytes] = set()
        for b in byte_batches(batches, "text"):
            out: dict[bytes, bytes] = {}
            for text in b.column("text").to_pylist():
                for part in (text or "").split(SPECIAL):
                    if len(part) > SMALLEST:
                        for c in chunks(part):
                            if (d := digest(c)) in wanted and d not in sent:
                                sent.add(d)
                                out[d] = c
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.binary()), pa.array(list(out.values()), pa.binary())], names=["digest", "chunk"])

    return run


def _once(ranks_path: str):
    def run(batches):
        import pyarrow as pa

        enc = bpe(ranks_path)
        for b in batches:
            got = [parts(c.decode("utf-8", "surrogatepass"), enc) for c in b.column("chunk").to_pylist()]
            ids = [None if g[1] is None else np.array(g[1], "<u4").tobytes() for g in got]
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array([g[0] for g in got], pa.string()), pa.array(ids, pa.binary()), pa.array([g[2] for g in got], pa.string())], names=["digest", "head", "ids", "tail"])

    return run


def dictionary(rows: DataFrame, ranks_path: str, most_chunks: int = 8192) -> dict[bytes, tuple]:
    """The chunks that save most when encoded once: at most most_chunks, so at most most_chunks * LARGEST
    bytes of text (64 MB; some 8 MB at the usual chunk length), whatever the size of the table. Ids are kept
    as packed 32-bit numbers."""
    counted = rows.mapInArrow(_counted, "digest binary, n long, bytes long").groupBy("digest").agg(F.sum("n").alias("n"), F.max("bytes").alias("bytes"))
    best = counted.where("n > 1").orderBy(((F.col("n") - 1) * F.col("bytes")).desc(), "digest").limit(most_chunks).collect()
    wanted = frozenset(bytes(r["digest"]) for r in best)
    if not wanted:
        return {}
    found = rows.mapInArrow(_fetched(wanted), "digest binary, chunk binary").groupBy("digest").agg(F.min("chunk").alias("chunk"))
    encoded = found.mapInArrow(_once(ranks_path), "digest binary, head string, ids binary, tail string")
    return {bytes(r["digest"]): (r["head"], None if r["ids"] is None else np.frombuffer(r["ids"], "<u4"), r["tail"]) for r in work_table(encoded, "chunks").collect()}


def _coded(ranks_path: str, json_path: str, shared, keep_ids: bool):
    def run(batches):
        import pyarrow as pa

        vocab = vocabulary(json_path)
        names = [str(i) for i in range(len(vocab))]
        encoder = Encoder(bpe(ranks_path), special_id(json_path), shared.value)
        for b in byte_batches(batches, "text"):
            n, a, z, kept = [], [], [], []
            for text in b.column("text").to_pylist():
                ids = encoder(text or "")
                n.append(len(ids))
                a.append(hashlib.sha256(",".join([names[i] for i in ids]).encode()).hexdigest())
                z.append(hashlib.sha256(decode(ids, vocab).encode()).hexdigest())
                if keep_ids:
                    kept.append(ids)
            cols = [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(z, pa.string())]
            yield pa.RecordBatch.from_arrays(cols + ([pa.array(kept, pa.list_(pa.int32()))] if keep_ids else []), names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * keep_ids)

    return run


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", json_path: str | None = None, ranks_path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids, array<int>, if asked for) per row of docs."""
    ranks_path = ranks_path or tokenizer_path("byte_bpe_50k.tiktoken")
    json_path = json_path or tokenizer_path("byte_bpe_50k.json")
    rows = texts(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(dictionary(rows, ranks_path))
    return rows.mapInArrow(_coded(ranks_path, json_path, shared, keep_ids), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids)
