"""SimHash near-dedup by Golay-code fuzzy hashing.

Fingerprints are 64-bit majorities over XXH64 of word shingles. Equal fingerprints are one class from
the start, so copies cost nothing further on. The 64 bits are cut into segments of 22, 21 and 21 bits,
each read as a word of the perfect (23, 12) Golay code. If two fingerprints differ in at most 3 bits,
at least two of the three segments differ in at most one bit each (pigeonhole). A word lies within 3
of exactly one codeword c0, and a word one bit away lies within 4 of that same c0, so c0 of one is
always among the codewords within 4 of the other: one of them, or six when c0 is 3 away. Each
fingerprint therefore gives, for each of the three pairs of segments, the keys
{within 4 of a} x {c0 of b} on one side and {c0 of a} x {within 4 of b} on the other, about 32 in all;
fingerprints that should meet always share a key. Rows of a key are checked by exact Hamming distance
and leave a spanning forest of their links, never all pairs. Keys with many rows are cut into blocks
that meet block by block. No link within the distance is lost.

Defined cases: null text counts as empty; no words gives fingerprint zero, linked like any other;
fewer words than a shingle hash as one shingle; repeated rows share a class; an empty table gives an
empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import byte_batches, components, discard, fresh, join_classes, popcount, texts, work_table

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Bits of the three segments (start, width).
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial of the binary Golay code, x^11+x^10+x^6+x^5+x^4+x^2+1.
GOLAY = 0b110001110101


def shingle_hashes(text: str | None, width: int) -> list[int]:
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return []
    if len(words) < width:
        return [xxh64_intdigest(b" ".join(words), 42)]
    if width == 3:
        return [xxh64_intdigest(b"%b %b %b" % t, 42) for t in zip(words, words[1:], words[2:])]
    return [xxh64_intdigest(b" ".join(words[i : i + width]), 42) for i in range(len(words) - width + 1)]


def fingerprint(text: str | None, width: int = 3) -> int:
    """64-bit majority; a bit is set if it is set in more than half the hashes."""
    h = shingle_hashes(text, width)
    if not h:
        return 0
    counts = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        part = np.array(h[i : i + (1 << 16)], "<u8")
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        while len(bits) > 255:  # sums of up to 255 rows fit a byte
            cut = len(bits) // 255 * 255
            counts += bits[cut:].sum(0, dtype=np.int64)
            counts += bits[:cut].reshape(-1, 255, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
            bits = bits[:0]
        counts += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view("<u8")[0])


def _fingerprints(width: int):
    def run(batches):
        import pyarrow as pa

        for b in byte_batches(batches, "text"):
            fps = np.array([fingerprint(t, width) for t in b.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return run


@lru_cache(maxsize=1)
def _golay():
    """Syndromes of single bytes, and for each syndrome the error patterns of weight up to 3 (first column)
    and, if that is 3, the five of weight 4 (else -1)."""

    def rem(x: int) -> int:
        for i in range(22, 10, -1):
            if x >> i & 1:
                x ^= GOLAY << (i - 11)
        return x

    unit = [rem(1 << i) for i in range(23)]
    by_byte = np.zeros((3, 256), np.int64)
    for part in range(3):
        for v in range(256):
            for bit in range(8):
                if v >> bit & 1 and part * 8 + bit < 23:
                    by_byte[part, v] ^= unit[part * 8 + bit]
    near: list[list[int]] = [[] for _ in range(2048)]
    for weight in range(5):
        for places in combinations(range(23), weight):
            s = 0
            for p in places:
                s ^= unit[p]
            if weight < 4 or near[s][0].bit_count() == 3:
                near[s].append(sum(1 << p for p in places))
    table = np.full((2048, 6), -1, np.int64)
    for s, patterns in enumerate(near):
        table[s, : len(patterns)] = patterns
    return by_byte, table


def near_codewords(words: np.ndarray) -> np.ndarray:
    """(n, 6) indices of the codewords within distance 4, the nearest first, -1 where there are fewer."""
    by_byte, table = _golay()
    s = by_byte[0][words & 255] ^ by_byte[1][words >> 8 & 255] ^ by_byte[2][words >> 16 & 255]
    e = table[s]
    return np.where(e < 0, -1, (words[:, None] ^ e) >> 11)


def golay_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, key) rows of an array of unsigned fingerprints; key bits: pair, codeword, codeword."""
    segs = [near_codewords(((fps >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64)) for at, width in SEGMENTS]
    where, keys = [], []
    for p, (a, b) in enumerate(((0, 1), (0, 2), (1, 2))):
        for wide, key in ((segs[a], lambda x, n: p << 24 | x << 12 | segs[b][n, 0]), (segs[b], lambda x, n: p << 24 | segs[a][n, 0] << 12 | x)):
            n, j = np.nonzero(wide >= 0)
            if wide is segs[b]:
                n, j = n[j > 0], j[j > 0]  # (c0, c0) is there once
            where.append(n)
            keys.append(key(wide[n, j], n))
    return np.concatenate(where), np.concatenate(keys)


def _keyed(batches):
    import pyarrow as pa

    for b in batches:
        fps = b.column("fp").to_numpy(zero_copy_only=False)
        for i in range(0, len(fps), 20_000):
            part = fps[i : i + 20_000]
            n, keys = golay_keys(part.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[n])], names=["key", "fp"])


def forest(values: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the distinct unsigned values, joined where few enough bits differ."""
    left, out = np.unique(values), []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            hit = popcount(left ^ x) <= distance
            if hit.any():
                near = left[hit]
                out += [(x, y) for y in near]
                queue += list(near)
                left = left[~hit]
    return out


def _array(column) -> np.ndarray:
    """A column of numbers, or of lists of SKETCH / 64 numbers."""
    import pyarrow as pa

    if pa.types.is_list(column.type):
        return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, SKETCH // 64)
    return column.to_numpy(zero_copy_only=False)


def runs_of(batches, keys: int):
    """Whole runs of equal leading columns from key-sorted batches, as (starts, columns) of many runs at a time."""
    kept = None
    for b in batches:
        cols = [_array(c) for c in b.columns]
        if kept is not None:
            cols = [np.concatenate([k, c]) for k, c in zip(kept, cols)]
        if not len(cols[0]):
            continue
        new = np.ones(len(cols[0]), bool)
        new[1:] = np.any([c[1:] != c[:-1] for c in cols[:keys]], axis=0)
        starts = np.nonzero(new)[0]
        kept = [c[starts[-1] :] for c in cols]
        if len(starts) > 1:
            yield starts[:-1], [c[: starts[-1]] for c in cols]
    if kept is not None:
        yield np.array([0]), kept


def _linked(distance: int):
    def run(batches):
        import pyarrow as pa

        for starts, (_, _, fp) in runs_of(batches, 2):
            fp = fp.view(np.uint64)
            ends = np.append(starts[1:], len(fp))
            size = ends - starts
            run_of = np.repeat(np.arange(len(starts)), size)
            small, a, c = size <= 16, [], []
            for lag in range(1, int(size[small].max(initial=1))):
                i = np.nonzero((run_of[lag:] == run_of[:-lag]) & small[run_of[:-lag]])[0]
                i = i[popcount(fp[i] ^ fp[i + lag]) <= distance]
                a.append(fp[i])
                c.append(fp[i + lag])
            for r in np.nonzero(~small)[0]:
                if links := forest(fp[starts[r] : ends[r]], distance):
                    a.append(np.array([x for x, _ in links], np.uint64))
                    c.append(np.array([y for _, y in links], np.uint64))
            if a:
                a, c = np.concatenate(a), np.concatenate(c)
                a, c = a[keep := a != c], c[keep]
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(c.view(np.int64))], names=["u", "v"])

    return run


def near_links(fps: DataFrame, distance: int = 3, block: int = 8192) -> DataFrame:
    """Links (u, v) between distinct fingerprints (column fp, long) that span all those within the distance.

    A key with more than `block` rows is cut into blocks; each two of its blocks meet in a group of their
    own, so a group never holds more than about two blocks.
    """
    if distance > 3:
        raise ValueError("the segment argument holds up to 3 differing bits")
    keyed = fps.select("fp").mapInArrow(_keyed, "key long, fp long")
    hot = work_table(keyed.groupBy("key").count().where(F.col("count") > block), "hot_keys")
    if hot.isEmpty():
        dealt = keyed.select("key", F.lit(0).alias("cell"), "fp")
    else:
        n = F.ceil(F.col("count") / F.lit(block)).cast("int")
        mine = F.pmod(F.xxhash64("fp"), n).cast("int")
        cells = F.transform(F.sequence(F.lit(0), n - 1), lambda o: F.least(o, mine) * 65536 + F.greatest(o, mine))
        dealt = keyed.join(hot, "key", "left").select("key", "fp", F.explode(F.when(F.col("count").isNull(), F.array(F.lit(0))).otherwise(cells)).alias("cell")).select("key", "cell", "fp")
    dealt = dealt.repartition("key", "cell").sortWithinPartitions("key", "cell")
    return dealt.mapInArrow(_linked(distance), "u long, v long")


def rooted(classes: DataFrame, distance: int = 3) -> DataFrame:
    """classes (one row per fingerprint, column fp) with root: the smallest fingerprint reachable by links."""
    roots = components(near_links(classes, distance))
    return classes.join(roots, classes.fp == roots.node, "left").select(*classes.columns, F.coalesce("root", "fp").alias("root"))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, distance: int = 3) -> DataFrame:
    """doc_id, fp (long), component_id (smallest id reachable; null ids lose to others) per row of docs."""
    rows = texts(docs, id_col, text_col)
    rows = work_table(rows.mapInArrow(_fingerprints(width), "doc_id long, fp long"), "fingerprints")
    classes = work_table(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "classes")
    grouped = work_table(rooted(classes, distance), "grouped")
    named = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    named = work_table(grouped.join(named, "root").select("fp", "n", "component_id"), "named")
    discard(classes, grouped)
    return join_classes(rows, named, ["fp"], "n")


# ---- grouping by shingle similarity -----------------------------------------------------------
#
# First come the links of fingerprints above: what they bring together is compared with one row of it, on whole
# texts. One line that is repeated can give any number of unlike texts one fingerprint, so no more than that is
# compared here. Texts that are alike may have fingerprints further apart, too. A second search follows for all that
# this leaves; its clusters that are one group already are not checked again.
#
# The search for pairs of sets alike to t is complete. Under any order of all shingles that is the same
# for every set, two such sets share one of the first n - ceil(t n) + 1 shingles of each (prefix
# filtering). At the first one they share, at places i and j, no more than 1 + min(n - i - 1, m - j - 1)
# can be common, which must reach t / (1 + t) of n + m. The parities of how many shingles fall into
# each of SKETCH slots differ in at most as many slots as the sets differ in shingles, which must be
# within (1 - t) / (1 + t) of n + m. Pairs that meet at a shingle and stay within these bounds are
# candidates. Sets of more shingles than slots look alike to a sketch of SKETCH slots, so clusters of candidates are
# parted by wide sketches, whose slots grow with the set, before they are checked on their texts. The order puts shingles last that
# a sample of documents shows to be common: it decides how many rows meet, never which pairs are found.
# Rows whose sets are equal are one class from the start, of which one row takes part in the search.

#: Slots of a sketch, and the most that a wide one has.
SKETCH, WIDEST = 1024, 1 << 20
#: One document in so many is sampled for common shingles; at most so many shingles are put last.
SAMPLE, COMMON = 16, 1 << 16
#: Words of a shingle of fingerprints here, as in simhash_components().
PRINT_WIDTH = 3
#: Words of 64 bits, a power of two, of the filter of rows whose texts are checked; more rows fill it up, they never get lost.
FILTER = 1 << 18
#: Bounds are loosened by this much against rounding.
SLACK = 1e-6


def prefix(values: np.ndarray, similarity: float, common: np.ndarray) -> np.ndarray:
    """The first shingles of a set in the order of the search; common: sorted by value, with ranks (2, n)."""
    if not len(values):
        return np.zeros(1, np.uint64)  # empty sets meet one another
    count = len(values) - int(np.ceil(similarity * len(values) - SLACK)) + 1
    if not common.shape[1]:
        return values[:count]
    at = np.minimum(np.searchsorted(common[0], values), common.shape[1] - 1)
    rank = np.where(common[0][at] == values, common[1][at], 0)
    return values[np.argsort(rank, kind="stable")][:count]


def sketch(values: np.ndarray) -> np.ndarray:
    """Parities of the number of shingles by slot, as SKETCH / 64 words."""
    parity = np.bincount((values & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(parity.astype(np.uint8)).view("<u8")


def wide_sketch(values: np.ndarray) -> np.ndarray:
    """The same with a number of slots, a power of two, of at least twice the number of shingles."""
    slots = SKETCH
    while slots < min(2 * len(values), WIDEST):
        slots *= 2
    parity = np.bincount((values & np.uint64(slots - 1)).astype(np.int64), minlength=slots) & 1
    return np.packbits(parity.astype(np.uint8)).view("<u8")


def folded(wide: np.ndarray) -> np.ndarray:
    """Wide sketches (rows) with half as many slots: a slot's parity is that of the two that fall into it."""
    half = wide.shape[1] // 2
    return wide[:, :half] ^ wide[:, half:]


def _shingled(width: int):
    def run(batches):
        import pyarrow as pa

        for b in byte_batches(batches, "text"):
            for text in b.column("text").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(text, width).view(np.int64))], names=["key"])

    return run


def common_shingles(body: DataFrame, width: int) -> np.ndarray:
    """(2, n) values and ranks of the shingles most common in a sample of the documents, sorted by value."""
    some = body.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0)
    counts = some.mapInArrow(_shingled(width), "key long").groupBy("key").count().where("count > 2")
    top = counts.orderBy(F.col("count").desc(), "key").limit(COMMON).collect()
    values = np.array([r["key"] for r in reversed(top)], np.int64).view(np.uint64)
    order = np.argsort(values)
    return np.stack([values[order], np.arange(1, len(values) + 1, dtype=np.uint64)[order]])


def _signed(width: int, similarity: float, common: np.ndarray):
    def run(batches):
        import pyarrow as pa
        from xxhash import xxh3_128_intdigest

        lists = pa.list_(pa.int64())
        for b in byte_batches(batches, "text"):
            sets = [shingle_set(t, width) for t in b.column("text").to_pylist()]
            keys = [prefix(s, similarity, common).view(np.int64) for s in sets]
            sketches = [sketch(s).view(np.int64) for s in sets]
            wide = [wide_sketch(s).view(np.int64) if len(s) > SKETCH // 2 else None for s in sets]
            whole = [xxh3_128_intdigest(s.tobytes()) for s in sets]
            fps = pa.array(np.array([fingerprint(t, PRINT_WIDTH) for t in b.column("text").to_pylist()], np.uint64).view(np.int64))
            h = [pa.array(np.array([x >> at & (1 << 64) - 1 for x in whole], np.uint64).view(np.int64)) for at in (0, 64)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("hash"), pa.array([len(s) for s in sets], pa.int32()), *h, pa.array(keys, lists), pa.array(sketches, lists), pa.array(wide, lists), fps], names=["doc_id", "hash", "size", "h0", "h1", "keys", "sketch", "wide", "fp"])

    return run


def _candidates(similarity: float):
    def run(batches):
        import pyarrow as pa

        def near(i, j, size, pos, sk) -> np.ndarray:
            """Which of the pairs of rows (i, j) stay within the bounds."""
            n, m = size[i], size[j]
            out = np.minimum(n, m) >= similarity * np.maximum(n, m) - SLACK
            out &= np.minimum(n - pos[i], m - pos[j]) >= similarity / (1 + similarity) * (n + m) - SLACK
            at = np.nonzero(out)[0]
            i, j = np.broadcast_arrays(i, j)
            apart = popcount(sk[i[at]] ^ sk[j[at]]).sum(1, dtype=np.int64)
            out[at] = apart <= (1 - similarity) / (1 + similarity) * (n + m)[at] + SLACK
            return out

        for starts, (_, _, doc, size, pos, sk) in runs_of(batches, 2):
            sk = sk.view(np.uint64)  # bits of negative numbers are counted by their absolute value
            ends = np.append(starts[1:], len(doc))
            count = ends - starts
            run_of = np.repeat(np.arange(len(starts)), count)
            small, a, c = count <= 32, [], []
            for lag in range(1, int(count[small].max(initial=1))):
                i = np.nonzero((run_of[lag:] == run_of[:-lag]) & small[run_of[:-lag]])[0]
                i = i[near(i, i + lag, size, pos, sk)]
                a.append(doc[i])
                c.append(doc[i + lag])
            for r in np.nonzero(~small)[0]:
                left = np.arange(starts[r], ends[r])
                while len(left) > 1:
                    queue, left = [left[0]], left[1:]
                    while queue and len(left):
                        x = np.array([queue.pop()])
                        hit = near(x, left, size, pos, sk)
                        if hit.any():
                            a.append(np.repeat(doc[x], hit.sum()))
                            c.append(doc[left[hit]])
                            queue += left[hit].tolist()
                            left = left[~hit]
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(c))], names=["u", "v"])

    return run


def _parted(similarity: float):
    """Links that span all pairs of a group's rows (cluster, cell, row, size, sketch) within the bounds."""

    def spanning(rows: list[int], sizes: list[int], sketches: list[np.ndarray]) -> list[tuple[int, int]]:
        size, ids, out = np.array(sizes), np.array(rows), []
        words = np.array([len(x) for x in sketches])
        at = {w: np.nonzero(words == w)[0] for w in np.unique(words).tolist()}
        place = np.zeros(len(rows), np.int64)
        stack, half = {}, {}
        for w, rows_ in at.items():
            place[rows_] = np.arange(len(rows_))
            stack[w] = np.stack([sketches[i] for i in rows_])
            half[w] = folded(stack[w]) if 2 * w in at or w // 2 in at else None
        left = np.ones(len(rows), bool)

        def near(x: int) -> np.ndarray:
            w, hits = int(words[x]), []
            for other in (w // 2, w, 2 * w):  # alike sets have sizes within a factor of 1 / similarity
                if other in at:
                    some = at[other][left[at[other]]]
                    a = stack[w][place[x]] if other >= w else half[w][place[x]]
                    b = half[other][place[some]] if other > w else stack[other][place[some]]
                    total = size[x] + size[some]
                    ok = np.minimum(size[x], size[some]) >= similarity * np.maximum(size[x], size[some]) - SLACK
                    ok[ok] = popcount(b[ok] ^ a).sum(1, dtype=np.int64) <= (1 - similarity) / (1 + similarity) * total[ok] + SLACK
                    hits.append(some[ok])
            return np.concatenate(hits)

        for start in range(len(rows)):
            if not left[start]:
                continue
            left[start], queue = False, [start]
            while queue:
                x = queue.pop()
                hit = near(x)
                left[hit] = False
                out += [(int(ids[x]), int(ids[y])) for y in hit]
                queue += hit.tolist()
        return out

    def run(batches):
        group, rows, sizes, sketches = None, [], [], []
        for b in batches:
            for key, row, size, words in zip(zip(b.column("cluster").to_pylist(), b.column("cell").to_pylist()), b.column("row").to_pylist(), b.column("size").to_pylist(), b.column("sketch")):
                if key != group:
                    if len(rows) > 1:
                        yield _links(spanning(rows, sizes, sketches))
                    group, rows, sizes, sketches = key, [], [], []
                rows.append(row)
                sizes.append(size)
                sketches.append(words.values.to_numpy(zero_copy_only=False).view(np.uint64))
        if len(rows) > 1:
            yield _links(spanning(rows, sizes, sketches))

    return run


def shingle_set(text: str | None, width: int) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, width), np.uint64))


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets have at least this Jaccard similarity; empty ones are alike."""
    n, m = len(a), len(b)
    if not n or not m:
        return n == m
    if min(n, m) < similarity * max(n, m) - SLACK:
        return False
    both = int((b[np.minimum(np.searchsorted(b, a), m - 1)] == a).sum())
    return both >= similarity * (n + m - both)


class Overlaps:
    """Sets of shingles, indexed: which of them are alike to another."""

    def __init__(self, sets: list[np.ndarray], similarity: float):
        self.similarity, self.sizes = similarity, np.array([len(s) for s in sets])
        every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        order = np.argsort(every, kind="stable")
        self.values = every[order]
        self.owner = np.repeat(np.arange(len(sets), dtype=np.int32), self.sizes)[order]

    def alike(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.nonzero(self.sizes == 0)[0]
        start, end = np.searchsorted(self.values, x), np.searchsorted(self.values, x, "right")
        n = end - start
        at = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())
        both = np.bincount(self.owner[at], minlength=len(self.sizes))
        return np.nonzero((both >= self.similarity * (self.sizes + len(x) - both)) & (both > 0))[0]


def _grouped(batches, keys: tuple[str, ...]):
    """(key, role, row, text) of key-sorted batches."""
    for b in byte_batches(batches, "text"):
        key = zip(*(b.column(k).to_pylist() for k in keys))
        yield from zip(key, b.column("role").to_pylist(), b.column("m_row").to_pylist(), b.column("text").to_pylist())


def _links(pairs: list[tuple[int, int]]):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names=["u", "v"])


def _to_pivot(width: int, similarity: float):
    """Links of the rows of a group with its first row, the pivot (role 0); a task holds two sets."""

    def run(batches):
        group, pivot, pivot_set, out = None, None, None, []
        for key, role, row, text in _grouped(batches, ("cluster", "cell")):
            if key != group:
                group, pivot, pivot_set = key, row, shingle_set(text, width)
            elif row != pivot and alike(pivot_set, shingle_set(text, width), similarity):
                out.append((pivot, row))
                if len(out) >= 10_000:
                    yield _links(out)
                    out = []
        yield _links(out)

    return run


def _to_rest(width: int, similarity: float):
    """Links of the rows of a group (role 1) with its block of rest rows (role 0), which is held indexed.

    A row gives one link at most, to the first rest row that it is like; the others that it is like are linked with
    that one, where they aren't yet. So a group leaves no more links than it has rows.
    """

    def run(batches):
        group, ids, sets, index, out, part = None, [], [], None, [], np.zeros(0, np.int64)
        for key, role, row, text in _grouped(batches, ("cluster", "rest", "cell")):
            if key != group:
                group, ids, sets, index = key, [], [], None
            x = shingle_set(text, width)
            if role == 0:
                if row not in ids[-1:]:  # rows that repeat in full come one behind the other
                    ids.append(row)
                    sets.append(x)
                continue
            if index is None:
                index, sets, part = Overlaps(sets, similarity), [], np.arange(len(ids))
            hit = index.alike(x)
            if not len(hit):
                continue
            parts, one = np.unique(part[hit], return_index=True)
            if ids[hit[0]] != row:
                out.append((ids[hit[0]], row))
            if len(parts) > 1:
                out += [(ids[hit[0]], ids[i]) for i in hit[one] if part[i] != part[hit[0]]]
                part[np.isin(part, parts)] = parts[0]
            if len(out) >= 10_000:
                yield _links(out)
                out = []
        yield _links(out)

    return run


def _cells(count, id_column, block: int):
    """Cells (pairs of blocks) that a row of a group of count rows goes to; one cell for small groups."""
    n = F.ceil(count / F.lit(block)).cast("int")
    mine = F.pmod(F.xxhash64(id_column), n).cast("int")
    cells = F.transform(F.sequence(F.lit(0), n - 1), lambda o: F.least(o, mine) * 65536 + F.greatest(o, mine))
    return F.explode(F.when(n <= 1, F.array(F.lit(0))).otherwise(cells))


def _candidate_links(live: DataFrame, similarity: float, key_block: int) -> DataFrame:
    """Links (u, v) of rows (row, size, keys, sketch) that span all pairs within the bounds."""
    keyed = live.select("row", "size", F.posexplode("keys").alias("pos", "key"))
    shared = work_table(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "n", F.col("n").alias("count")), "shared_keys")
    met = join_classes(keyed, shared, ["key"], "n").join(live.select("row", "sketch"), "row")
    dealt = met.select("key", _cells(F.col("count"), "row", key_block).alias("cell"), "row", "size", "pos", "sketch")
    dealt = dealt.repartition("key", "cell").sortWithinPartitions("key", "cell")
    return dealt.mapInArrow(_candidates(similarity), "u long, v long")


def _print_clusters(live: DataFrame) -> DataFrame:
    """(m_row, cluster) of the rows (row, fp) whose fingerprints are linked with those of others."""
    rows = work_table(live.select("row", "fp"), "row_prints")
    prints = work_table(rows.groupBy("fp").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n")), "prints")
    grouped = work_table(rooted(prints), "grouped")
    shared = grouped.groupBy("root").agg(F.min("first").alias("cluster"), F.sum("n").alias("rows")).where("rows > 1")
    named = work_table(grouped.join(shared, "root").select("fp", "n", "cluster"), "named")
    out = work_table(join_classes(rows, named, ["fp"], "n").select(F.col("row").alias("m_row"), "cluster"), "print_clusters")
    discard(rows, prints, grouped, named)
    return out


def _narrowed(body: DataFrame, rows: DataFrame) -> DataFrame:
    """body without most of the texts whose hash is not among m_hash of rows: a filter of one bit a hash is sent
    to the texts, so that they needn't be shuffled to be found."""
    word, bit = (lambda h: F.pmod(h, F.lit(FILTER))), (lambda h: F.shiftrightunsigned(h, 58))
    held = rows.select(word(F.col("m_hash")).alias("word"), F.expr("shiftleft(1L, cast(shiftrightunsigned(m_hash, 58) as int))").alias("bit"))
    held = held.groupBy("word").agg(F.bit_or("bit").alias("bits"))
    on = (word(F.col("hash")) == held.word) & (F.call_function("getbit", held.bits, bit(F.col("hash")).cast("int")) == 1)
    return body.join(F.broadcast(held), on, "left_semi")


def _checked(body: DataFrame, members: DataFrame, width: int, similarity: float, block: int, volume: int, rest: bool = True) -> DataFrame:
    """(node, root) of the members (m_row, cluster, m_id, m_hash, size) that are alike, by their whole texts.

    A cluster's members are compared with one of them, the pivot, which sends every text once; those like it are
    one group. The rest meets all members of its cluster, in blocks of about `block` rows or `volume` shingles
    that a task holds while the members stream by. So every link has an end in the rest, or both of its ends
    are like the pivot. Without rest, only the pivots' links are found, for a work in proportion to the members.
    """
    near = _narrowed(body, members)
    on = near.doc_id.eqNullSafe(F.col("m_id")) & (F.col("hash") == F.col("m_hash"))
    told = lambda rows, *keys: near.join(rows, on).select(*keys, "role", "m_row", "text").repartition(*keys).sortWithinPartitions(*keys, "role", "m_row")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = lambda n: F.pmod(F.xxhash64("m_row"), F.col(n)).cast("int")
    sizes = members.groupBy("cluster").agg(F.min("m_row").alias("pivot"), F.count(F.lit(1)).alias("n"))
    sizes = work_table(sizes.withColumn("cells", F.ceil(F.col("n") / F.lit(block)).cast("int")), "pivots")
    rows = join_classes(members, sizes, ["cluster"], "n").withColumn("role", F.when(F.col("m_row") == F.col("pivot"), 0).otherwise(1))
    placed = F.explode(F.when(F.col("role") == 0, F.sequence(F.lit(0), F.col("cells") - 1)).otherwise(F.array(one("cells")))).alias("cell")
    dealt = work_table(rows.select("cluster", "m_row", "m_id", "m_hash", "role", placed), "dealt")
    links = work_table(told(dealt, "cluster", "cell").mapInArrow(_to_pivot(width, similarity), "u long, v long"), "to_pivot")
    discard(dealt)
    if not rest:
        out = components(links)
        discard(sizes, links)
        return out
    done = links.select(F.col("v").alias("m_row")).unionByName(sizes.select(F.col("pivot").alias("m_row")))
    left = work_table(members.join(done, "m_row", "left_anti"), "left")
    others = left.groupBy("cluster").agg(F.count(F.lit(1)).alias("left"), F.sum(F.col("size").cast("long")).alias("shingles"))
    blocks = F.ceil(F.greatest(F.col("left") / F.lit(block), F.col("shingles") / F.lit(volume))).cast("int")
    plan = sizes.select("cluster", "n", F.ceil(F.col("n") / F.lit(block)).cast("int").alias("cells")).join(others.select("cluster", blocks.alias("blocks")), "cluster")
    plan = work_table(plan, "plan")
    tables = [links]
    if not plan.isEmpty():
        cols = ["cluster", "m_row", "m_id", "m_hash"]
        held = join_classes(left, plan, ["cluster"], "n").select(*cols, F.lit(0).alias("role"), one("blocks").alias("rest"), every("cells").alias("cell"))
        by = join_classes(members, plan, ["cluster"], "n").select(*cols, F.lit(1).alias("role"), every("blocks").alias("rest"), one("cells").alias("cell"))
        dealt = work_table(held.unionByName(by.select(held.columns)), "dealt")
        tables.append(work_table(told(dealt, "cluster", "rest", "cell").mapInArrow(_to_rest(width, similarity), "u long, v long"), "to_rest"))
        discard(dealt)
    out = components(tables[0] if len(tables) == 1 else tables[0].unionByName(tables[1]))
    discard(sizes, left, plan, *tables)
    return out


def _refined(clustered: DataFrame, signed: DataFrame, similarity: float, block: int, volume: int) -> DataFrame:
    """clustered (m_row, cluster) with clusters of more than two rows that hold a wide sketch parted into what wide
    sketches leave alike. Large clusters meet in blocks of sketches, two by two."""
    rows = clustered.join(signed.select("row", "size", "sketch", "wide"), F.col("m_row") == F.col("row"))
    sizes = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("size").cast("long")).alias("shingles"), F.count("wide").alias("wides"))
    blocks = F.ceil(F.greatest(F.col("n") / F.lit(block), F.col("shingles") / F.lit(32 * volume))).cast("int")
    mixed_ = work_table(sizes.where("n > 2 and wides > 0").select("cluster", "n", blocks.alias("blocks")), "mixed")
    if mixed_.isEmpty():
        return clustered
    met = join_classes(rows.select("m_row", "cluster", "size", F.coalesce("wide", "sketch").alias("sketch")), mixed_, ["cluster"], "n")
    dealt = met.select("cluster", _cells(F.col("blocks"), "m_row", 1).alias("cell"), F.col("m_row").alias("row"), "size", "sketch")
    links = dealt.repartition("cluster", "cell").sortWithinPartitions("cluster", "cell").mapInArrow(_parted(similarity), "u long, v long")
    parts = components(links).select(F.col("node").alias("m_row"), F.col("root").alias("cluster"))
    whole = join_classes(clustered, sizes.where("n <= 2 or wides = 0").select("cluster", "n"), ["cluster"], "n")
    return whole.select("m_row", "cluster").unionByName(parts)


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, block: int = 1000, key_block: int = 8192, volume: int = 1 << 20) -> DataFrame:
    """(doc_id, hash, row, first_id, first_hash, first_row) of the rows of docs that have a near duplicate.

    Rows are linked if the Jaccard similarity of their sets of word shingles is at least `similarity`; first is
    the row of a group that stays: smallest id, null ids last, then first row. hash is that of the text, so
    (doc_id, hash) tells rows apart unless they repeat in full.
    """
    body = texts(docs, id_col, text_col).withColumn("hash", F.xxhash64("text"))
    common = common_shingles(body, width)
    told = body.mapInArrow(_signed(width, similarity, common), "doc_id long, hash long, size int, h0 long, h1 long, keys array<long>, sketch array<long>, wide array<long>, fp long")
    signed = work_table(told.withColumn("row", F.monotonically_increasing_id()), "signed")
    classes = signed.groupBy("h0", "h1").agg(F.min("row").alias("kept"), F.count(F.lit(1)).alias("n")).where("n > 1")
    classes = work_table(classes, "classes")
    copies = work_table(join_classes(signed.select("row", "h0", "h1"), classes, ["h0", "h1"], "n").where("row <> kept").select("row", "kept"), "copies")
    live = signed.join(copies.select("row"), "row", "left_anti")

    def checked(clustered: DataFrame, rest: bool = True) -> DataFrame:
        members = clustered.join(signed.select("row", "doc_id", "hash", "size"), F.col("m_row") == F.col("row")).select("m_row", "cluster", F.col("doc_id").alias("m_id"), F.col("hash").alias("m_hash"), "size")
        members = work_table(members, "members")
        out = _checked(body, members, width, similarity, block, volume, rest)
        discard(members)
        return out

    by_print = checked(_print_clusters(live), rest=False)
    clustered = components(_candidate_links(live, similarity, key_block)).select(F.col("node").alias("m_row"), F.col("root").alias("cluster"))
    clustered = work_table(_refined(clustered, signed, similarity, block, volume), "clustered")
    known = clustered.join(by_print, F.col("m_row") == F.col("node"), "left").select("cluster", F.coalesce("root", "m_row").alias("part"))
    parts = known.groupBy("cluster").agg(F.min("part").alias("least"), F.max("part").alias("most"), F.count(F.lit(1)).alias("n"))
    parted = work_table(parts.where("least < most").select("cluster", "n"), "parted")
    by_shingles = checked(join_classes(clustered, parted, ["cluster"], "n"))
    found = components(by_print.unionByName(by_shingles), "node", "root")
    kept = classes.select("kept", "n").join(found, F.col("kept") == F.col("node"), "left").select("kept", "n", F.coalesce("root", "kept").alias("root"))
    kept = work_table(kept, "class_roots")
    alone = kept.where("root = kept").select(F.col("kept").alias("node"), "root")  # also in found if others are alike
    roots = found.unionByName(alone).distinct().unionByName(join_classes(copies, kept, ["kept"], "n").select(F.col("row").alias("node"), "root"))
    named = roots.join(signed.select("row", "doc_id", "hash"), F.col("node") == F.col("row")).select("doc_id", "hash", "row", "root")
    named = work_table(named, "grouped")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row", "hash")).alias("f")
    first = work_table(named.groupBy("root").agg(least, F.count(F.lit(1)).alias("n")).select("root", "n", F.col("f.doc_id").alias("first_id"), F.col("f.hash").alias("first_hash"), F.col("f.row").alias("first_row")), "firsts")
    out = work_table(join_classes(named, first, ["root"], "n").drop("root"), "groups")
    discard(signed, classes, copies, clustered, parted, by_print, by_shingles, kept, named, first)
    return out


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, block: int = 1000, key_block: int = 8192) -> DataFrame:
    """(node, root) of the ids of documents that have a near duplicate: root is the smallest id of the group."""
    return similar_groups(docs, id_col, text_col, width, similarity, block, key_block).select(F.col("doc_id").alias("node"), F.col("first_id").alias("root"))


def keep_one_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs without those that have a near duplicate which comes first (smallest id, null ids
    last); all columns, whatever their names. Rows are told apart by id and text, so another text under the id
    of a row that goes stays; of rows that repeat both, one stays."""
    groups = similar_groups(docs, id_col, text_col, width, similarity)
    same = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("hash") == F.col("first_hash"))
    id_, hash_ = fresh(docs, "_id", "_hash")
    named = groups.select(F.col("doc_id").alias(id_), F.col("hash").alias(hash_), same.alias("same"), (F.col("row") == F.col("first_row")).alias("first"))
    on = lambda keys: docs[id_col].cast("long").eqNullSafe(keys[id_]) & (F.xxhash64(docs[text_col].cast("string")) == keys[hash_])
    gone = work_table(named.where("not same").select(id_, hash_).distinct(), "gone")
    again = work_table(named.where("same and not first").select(id_, hash_).distinct(), "again")
    out = docs.join(gone, on(gone), "left_anti")
    if again.isEmpty():
        return out
    once = docs.join(again, on(again), "left_semi").dropDuplicates([id_col, text_col])
    return out.join(again, on(again), "left_anti").unionByName(once)
