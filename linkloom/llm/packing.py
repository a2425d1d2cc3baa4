"""Best-fit packing with Martello-Toth dominance reduction, on a histogram of lengths.

Documents become pieces of 1..capacity tokens. Only how many pieces have each length matters for how
full sequences can be, so the plan is made on at most `capacity` counts, whatever the number of pieces:

1. Reduction. For the largest lengths, a set {j}, {j, a} or {j, a, b} that provably dominates every
   other feasible set with j (each of those maps into it part by part) is closed as a sequence for
   good, as often as its lengths are there; the instance shrinks, and passes repeat until nothing
   changes.
2. Best fit on the remainder in decreasing order: sequences of equal contents are one group with a
   multiplicity, and each length fills the fullest groups that fit before new ones are opened, which
   is what item-by-item best fit does.

The plan (some thousands of groups at most, bounded by the capacity, not by the data) is sent to the
executors; a piece finds its place by its rank within its length. Ranks come from counts of
(length, salt) cells and a row number within a cell, so one frequent length is spread over many tasks.

Defined cases: null or empty text is the single end id; repeated rows are packed each; an empty table
gives an empty result; longer documents are cut from the back into full pieces, so the first piece may
be shorter.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from .common import bpe, byte_batches, encode, special_id, texts, tokenizer_path, work_table


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens."""
    head = n % capacity or capacity
    return [(0, min(head, n))] + [(s, capacity) for s in range(head, n, capacity)]


def _pieces(ranks_path: str, json_path: str, capacity: int, end_id: int):
    def run(batches):
        import pyarrow as pa

        enc, special = bpe(ranks_path), special_id(json_path)
        for b in byte_batches(batches, "text"):
            out: list[tuple] = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                ids = np.array(encode(text or "", enc, special) + [end_id], "<u4")
                out += [(doc, i, s, n, zlib.crc32(ids[s : s + n].tobytes())) for i, (s, n) in enumerate(cut(len(ids), capacity))]
            cols = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


@dataclass
class Group:
    """`count` sequences of equal contents: (length, copies, offset of the first copy) in order."""

    items: list[tuple[int, int, int]]
    count: int
    used: int


def _top(counts: np.ndarray, most: int) -> int:
    """Largest length up to most that is there, or 0."""
    at = np.nonzero(counts[1 : most + 1])[0] if most > 0 else ()
    return int(at[-1]) + 1 if len(at) else 0


def _two_smallest(counts: np.ndarray, above: int) -> tuple[int, int]:
    at = np.nonzero(counts[above + 1 :])[0][:2] + above + 1
    if not len(at):
        return 0, 0
    return int(at[0]), int(at[0] if counts[at[0]] > 1 else at[1] if len(at) > 1 else 0)


def _best_pair(counts: np.ndarray, room: int) -> int:
    """Largest sum of two items within room, or 0."""
    at = np.nonzero(counts[: room + 1])[0]
    i, j, best = 0, len(at) - 1, 0
    while i <= j:
        a, b = int(at[i]), int(at[j])
        if a + b > room:
            j -= 1
        else:
            if i < j or counts[a] > 1:
                best = max(best, a + b)
            i += 1
    return best


def dominating_set(counts: np.ndarray, j: int, capacity: int) -> tuple[int, ...] | None:
    """The other items of a set with j that dominates every feasible set with j; None if none is proved.

    counts: items other than this j. With at most k items fitting beside j: k = 0 leaves {j}; for k = 1,
    or if j and the largest a that fits fill the capacity, or if a is at least any fitting pair (k = 2),
    {j, a} dominates; for k = 2, {j, a, b} with b the largest beside both dominates when no fitting pair
    has both items over b, since then one item of any pair fits into a's place and the other into b's.
    """
    room = capacity - j
    a = _top(counts, room)
    if not a:
        return ()
    s1, s2 = _two_smallest(counts, 0)
    if a == room or not s2 or s1 + s2 > room:
        return (a,)
    at = np.nonzero(counts[: room + 1])[0]
    three, need = 0, 3
    for s in at[:3]:
        take = min(need, int(counts[s]))
        three, need = three + take * int(s), need - take
    if need == 0 and three <= room:
        return None  # three or more may fit
    if a >= _best_pair(counts, room):
        return (a,)
    counts[a] -= 1
    b = _top(counts, room - a)
    counts[a] += 1
    x, y = _two_smallest(counts, b)
    return (a, b) if b and (not y or x + y > room) else None


def reduce_instance(counts: np.ndarray, capacity: int) -> tuple[list[Group], np.ndarray]:
    """Groups fixed by dominance, and the counts that remain."""
    counts, fixed, changed = counts.copy(), [], True
    while changed:
        changed = False
        for j in range(capacity, 0, -1):
            while counts[j]:
                counts[j] -= 1
                others = dominating_set(counts, j, capacity)
                counts[j] += 1
                if others is None:
                    break
                use: dict[int, int] = {}
                for x in (j, *others):
                    use[x] = use.get(x, 0) + 1
                m = min(int(counts[x]) // n for x, n in use.items())
                items, at = [], 0
                for x, n in use.items():
                    items.append((x, n, at))
                    at += x * n
                    counts[x] -= n * m
                fixed.append(Group(items, m, at))
                changed = True
            if not others_fit(counts, j, capacity):
                break
    return fixed, counts


def others_fit(counts: np.ndarray, j: int, capacity: int) -> bool:
    """False if lengths below j can't be reduced in this pass: four of the smallest fit beside them."""
    at, total, need = np.nonzero(counts)[0], 0, 4
    for s in at[:4]:
        take = min(need, int(counts[s]))
        total, need = total + take * int(s), need - take
    return bool(need) or total > capacity - j or j > capacity // 2


def best_fit(counts: np.ndarray, capacity: int) -> list[Group]:
    """Best fit in decreasing order over groups of equal sequences."""
    by_room: dict[int, list[Group]] = {}
    done: list[Group] = []

    def put(g: Group, length: int, copies: int) -> None:
        g = Group([*g.items, (length, copies, g.used)], g.count, g.used + length * copies)
        room = capacity - g.used
        (by_room.setdefault(room, []) if room else done).append(g)

    for length in range(capacity, 0, -1):
        n = int(counts[length])
        rooms = iter(sorted(r for r in by_room if r >= length))
        while n:
            room = next(rooms, None)
            if room is None:  # open new ones
                groups, most = [Group([], n, 0)], capacity // length
            else:
                groups, most = by_room.pop(room), room // length
            for i, g in enumerate(groups):
                full = min(g.count, n // most)
                if full:
                    put(Group(g.items, full, g.used), length, most)
                n -= full * most
                rest = g.count - full if room is not None else min(1, n)
                if rest and 0 < n < most:
                    put(Group(g.items, 1, g.used), length, n)
                    n, rest = 0, rest - 1
                if rest and room is not None:
                    by_room.setdefault(room, []).append(Group(g.items, rest, g.used))
                if not n:
                    if room is not None and groups[i + 1 :]:
                        by_room.setdefault(room, []).extend(groups[i + 1 :])
                    break
    return done + [g for gs in by_room.values() for g in gs]


def plan(counts: np.ndarray, capacity: int) -> dict[str, np.ndarray]:
    """Columns of the slots: of each length, from which rank on, copies, base sequence, offset."""
    fixed, rest = reduce_instance(counts, capacity)
    slots, base, ranks = [], 0, np.zeros(capacity + 1, np.int64)
    for g in fixed + best_fit(rest, capacity):
        for length, copies, at in g.items:
            slots.append((length, ranks[length], copies, base, at))
            ranks[length] += copies * g.count
        base += g.count
    slots.sort(key=lambda s: s[:2])
    out = np.array(slots, np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "copies", "base", "offset"), out.T)) | {"sequences": np.array([base])}


def _placed(slots: dict[str, np.ndarray], names: list[str]):
    span = int(slots["rank"].max(initial=0)) + 1
    keys = slots["length"].astype(object) * span + slots["rank"].astype(object) if span > 1 << 50 else slots["length"] * span + slots["rank"]

    def run(batches):
        import pyarrow as pa

        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(keys, length * span + rank, side="right") - 1
            i = rank - slots["rank"][at]
            seq = slots["base"][at] + i // slots["copies"][at]
            offset = slots["offset"][at] + i % slots["copies"][at] * length
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(seq), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return run


def place(pieces: DataFrame, capacity: int, per_cell: int = 200_000) -> DataFrame:
    """pieces (doc_id, piece, start, length, ids_crc32) with sequence_id and offset."""
    spark = pieces.sparkSession
    counts = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():  # at most `capacity` rows
        counts[r["length"]] = r["count"]
    slots = plan(counts, capacity)
    salts = max(8, -(-int(counts.max(initial=0)) // per_cell))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    cells = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = work_table(cells.select("length", "salt", before.alias("before")), "cells")
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("within", F.row_number().over(within)).join(cells, ["length", "salt"])
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    ranked = ranked.select(*names, (F.col("before") + F.col("within") - 1).alias("rank"))
    return ranked.mapInArrow(_placed(slots, names), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0, json_path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    ranks_path = ranks_path or tokenizer_path("byte_bpe_50k.tiktoken")
    json_path = json_path or tokenizer_path("byte_bpe_50k.json")
    rows = texts(docs, id_col, text_col)
    pieces = rows.mapInArrow(_pieces(ranks_path, json_path, capacity, end_id), "doc_id long, piece int, start long, length long, ids_crc32 long")
    return place(work_table(pieces, "pieces"), capacity)
