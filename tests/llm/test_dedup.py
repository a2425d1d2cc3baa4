import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkloom.llm import embedding_dedup as ed, exact_dedup as xd, simhash_dedup as sd
from linkloom.llm.common import components

DOC = "doc_id long, text string, keep_id string, row string, digest string, fp string"


def docs(spark, rows):
    """Documents with other columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "x", "x", "x", "x") for i, t in rows], DOC)


def close(links, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("seed,most", [(0, 200_000), (1, 0), (2, 3)])
def test_components(spark, seed, most, monkeypatch):
    monkeypatch.setattr("linkloom.llm.common.MOST_LINKS", most)
    g = random.Random(seed)
    links = [(g.randrange(60), g.randrange(60)) for _ in range(50)] + [(100 + i, 101 + i) for i in range(30)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "u long, v long").repartition(5)).collect()}
    want = close(links, {x for p in links for x in p})
    assert {n: r for n, r in got.items()} == {n: r for n, r in want.items() if n in got} and all(want[n] == n for n in want if n not in got)


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([(1, 1), (None, 2)], "u long, v long")).count() == 0


ROWS = [(5, "a b"), (3, "ab"), (4, "a  b"), (9, None), (8, ""), (7, " \t\n"), (1, "x" * 200_000), (2, "x" * 200_000), (6, "é"), (6, "é"), (None, "ab"), (10, "a b")]


@pytest.mark.parametrize("runs,fan", [(16, 4), (5, 2), (1, 2)])
def test_exact_dedup(spark, runs, fan):
    got = xd.exact_dedup(docs(spark, ROWS).repartition(3), runs=runs, fan_in=fan).collect()
    groups = {}
    for i, t in ROWS:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i if i is not None else 10**9, i))
    assert len(got) == len(ROWS)
    for r in got:
        g = groups[next(k for k in groups if hashlib.sha256(k.encode()).hexdigest() == r.text_sha256)]
        assert (r.keep_id, r.group_size) == (min(g)[2], len(g))
    assert sum(r.kept for r in got) == len(groups)


def test_exact_dedup_empty_and_filter(spark):
    assert xd.exact_dedup(docs(spark, [])).count() == 0
    kept = xd.keep_unique(docs(spark, ROWS))
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect()) == sorted((False, i) for i in (4, 7, 1, 6, 10))
    assert kept.columns[:2] == ["doc_id", "text"] and len(kept.columns) == 6


def test_golay_keys_meet():
    g = np.random.default_rng(0)
    for bits in range(4):
        x = g.integers(0, 2**64, 300, np.uint64, endpoint=False)
        y = x.copy()
        for i in range(300):
            for b in g.choice(64, bits, replace=False):
                y[i] ^= np.uint64(1) << np.uint64(b)
        n, k = sd.golay_keys(x)
        m, l = sd.golay_keys(y)
        keys = [set(k[n == i]) & set(l[m == i]) for i in range(300)]
        assert all(keys)


def test_fingerprints():
    from xxhash import xxh64_intdigest

    def slow(text, w=3):
        words = [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or "")) if x]
        sh = [" ".join(words[i : i + w]) for i in range(len(words) - w + 1)] if len(words) >= w else [" ".join(words)] * bool(words)
        h = [xxh64_intdigest(s.encode(), 42) for s in sh]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0

    g = random.Random(1)
    for text in [None, "", " \n", "One", "A B", "É é a b c", *(" ".join(g.choices("abcdefgh", k=g.randint(1, 600))) for _ in range(30))]:
        assert sd.fingerprint(text) == slow(text)


def test_spark_hash_is_the_same(spark):
    from xxhash import xxh64_intdigest

    got = spark.createDataFrame([("é a b",)], "t string").select(F.xxhash64("t")).first()[0]
    assert got % 2**64 == xxh64_intdigest("é a b".encode(), 42)


@pytest.mark.parametrize("block", [4, 8192])
def test_simhash_links_equal_brute_force(spark, block):
    g = random.Random(4)
    base = [g.getrandbits(64) for _ in range(6)]
    fps = {b ^ sum(1 << p for p in g.sample(range(64), g.randint(0, 3))) for b in base for _ in range(40)} | {0, 2**64 - 1}
    signed = [x - 2**64 if x >> 63 else x for x in fps]
    got = sd.near_links(spark.createDataFrame([(x,) for x in signed], "fp long"), block=block).collect()
    links = [(a, b) for a in signed for b in signed if a < b and ((a ^ b) % 2**64).bit_count() <= 3]
    assert close([(r.u, r.v) for r in got], signed) == close(links, signed)
    assert all(((r.u ^ r.v) % 2**64).bit_count() <= 3 for r in got)


def test_simhash_components(spark):
    rows = [(4, "same text here now"), (2, "Same  text here NOW"), (9, None), (7, ""), (None, "same text here now"), (3, "something quite different indeed"), (3, "something quite different indeed")]
    got = sorted((r.doc_id or 0, r.component_id) for r in sd.simhash_components(docs(spark, rows)).collect())
    assert got == [(0, 2), (2, 2), (3, 3), (3, 3), (4, 2), (7, 7), (9, 7)]
    assert sd.simhash_components(docs(spark, [])).count() == 0


@pytest.mark.parametrize("block,key_block", [(1000, 8192), (7, 5)])
def test_similar_components_equal_brute_force(spark, block, key_block):
    g = random.Random(2)
    vocab = [f"word{i}" for i in range(400)]
    rows = []
    for d in range(12):
        words = g.choices(vocab, k=150)
        for c in range(5):
            w = list(words)
            for _ in range(g.randint(0, 4)):
                w[g.randrange(150)] = g.choice(vocab)
            rows.append((len(rows), " ".join(w)))
    rows += [(1000, None), (1001, ""), (1002, "a b"), (1003, "a  B")]
    sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()) for i, t in rows for w in [(t or "").lower().split()]}
    links = [(a, b) for a in sets for b in sets if a < b and ((not sets[a] and not sets[b]) or (sets[a] | sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8))]
    want = close(links, sets)
    df = docs(spark, rows)
    got = {r.node: r.root for r in sd.similar_components(df, block=block, key_block=key_block).collect()}
    assert {i: got.get(i, i) for i in sets} == want
    if block == 1000:
        assert sorted(r.doc_id for r in sd.keep_one_each(df).collect()) == sorted(set(want.values()))


@pytest.mark.parametrize("key_block", [8192, 5])
def test_similar_components_find_appended_prepended_and_replaced_blocks(spark, key_block):
    g = random.Random(6)
    vocab = [f"word{i}" for i in range(3000)]
    rows, pairs = [], []
    common = g.choices(vocab, k=30)
    for n in range(120):
        w = common + g.choices(vocab, k=g.randint(150, 400))
        new = [f"new{n}x{i}" for i in range(len(w))]
        part = int(len(w) * g.uniform(0.11, 0.19))
        at = g.randrange(len(w) // 2)
        copy = [w + new[:part], new[:part] + w, w[:at] + new[: part // 2] + w[at + part // 2 :]][n % 3]
        a, b = ({tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (w, copy))
        if len(a & b) >= 0.8 * len(a | b):
            pairs.append((2 * n, 2 * n + 1))
            rows += [(2 * n, " ".join(w)), (2 * n + 1, " ".join(copy))]
    assert len(pairs) > 90 and {a // 2 % 3 for a, _ in pairs} == {0, 1, 2}
    got = {r.node: r.root for r in sd.similar_components(docs(spark, rows), key_block=key_block).collect()}
    assert got == {x: a for a, b in pairs for x in (a, b)}


CLASH = "doc_id long, text string, _later string, _k_id int, _id string, _hash string, row int, hash int, label string"


def test_clashing_columns_and_repeated_ids(spark):
    t, u = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    rows = [(1, t), (2, t), (2, u), (3, u.replace("v59", "z")), (3, u.replace("v59", "z")), (None, t), (None, "alone here"), (7, None), (8, ""), (9, "a b"), (9, "A  b")]
    df = spark.createDataFrame([(i, x, "later", 5, "i", "h", 1, 2, "l") for i, x in rows], CLASH)
    kept = sd.keep_one_each(df)
    assert kept.columns == df.columns and {tuple(r)[2:] for r in kept.collect()} == {("later", 5, "i", "h", 1, 2, "l")}
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert got in (sorted([(1, t), (2, u), (None, "alone here"), (7, None), (9, x)], key=str) for x in ("a b", "A  b"))
    only = [(3, t), (3, t), (3, t), (4, "x")]
    assert sorted((r.doc_id, r.text) for r in sd.keep_one_each(spark.createDataFrame([(i, x, "", 5, "", "", 1, 2, "") for i, x in only], CLASH)).collect()) == [(3, t), (4, "x")]
    unique = xd.keep_unique(df)
    assert unique.columns == df.columns and sorted((r.doc_id or 0, r.text or "") for r in unique.collect()) == sorted([(1, t), (2, u), (3, u.replace("v59", "z")), (0, "alone here"), (7, ""), (9, "a b"), (9, "A  b")])


def test_many_copies_and_alike(spark):
    t = " ".join(f"w{i}" for i in range(80))
    rows = [(i, t) for i in range(2500)] + [(5000 + i, (t + " ").replace(f"w{i % 80} ", f"n{i} ")) for i in range(120)] + [(9000, "else")]
    got = {r.node: r.root for r in sd.similar_components(docs(spark, rows).repartition(5), block=20).collect()}
    alike = [i for i, x in rows if i != 9000]
    assert got == dict.fromkeys(alike, 0)


def test_wide_sketches_part_what_narrow_ones_leave(spark):
    g = random.Random(9)
    base = [f"w{i}" for i in range(3000)]
    rows = []
    for n, share in enumerate((0.0, 0.02, 0.05, 0.3, 0.33, 0.36, 0.39)):
        w = list(base)
        at = g.randrange(len(w) // 2)
        w[at : at + int(share * len(w))] = [f"n{n}x{i}" for i in range(int(share * len(w)))]
        rows.append((n, " ".join(w)))
    rows += [(10, " ".join(base[:400])), (11, " ".join(base[:400] + ["more"] * 9)), (12, "short text here")]
    sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or {tuple(w)} for i, t in rows for w in [t.split()]}
    links = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = close(links, sets)
    for block in (1000, 2):
        got = {r.node: r.root for r in sd.similar_components(docs(spark, rows), block=block).collect()}
        assert {i: got.get(i, i) for i in sets} == want and set(want.values()) > {0, 10, 12}
    x = g.sample(range(2**62), 5000)
    s = np.unique(np.array(x, np.uint64))
    w = sd.wide_sketch(s)
    assert len(w) * 64 == 16384
    while len(w) > 16:
        w = sd.folded(w[None])[0]
    assert (w == sd.sketch(s)).all()


def brute_vectors(rows, t=0.9):
    fine = {i: np.array(v, float) for i, v in enumerate(rows) if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    cos = lambda a, b: len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= t
    return [(i, j) for i in fine for j in fine if i != j and cos(fine[i], fine[j])]


@pytest.mark.parametrize("block", [6, 2048])
@pytest.mark.parametrize("kind", ["float", "double"])
def test_embedding_dedup(spark, block, kind):
    g = np.random.default_rng(3)
    base = g.standard_normal((6, 16))
    vecs = [(base[i % 6] + 0.18 * g.standard_normal(16)).astype(np.float32).astype(float).tolist() for i in range(70)] + [base[0].astype(np.float32).astype(float).tolist()] * 9
    vecs += [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 0.0], [2.0, 0.0], (2 * base[0]).astype(np.float32).astype(float).tolist()]
    df = spark.createDataFrame([(i, v, 1, 1) for i, v in enumerate(vecs)], f"vec_id long, embedding array<{kind}>, cid int, n int")
    got = {r.vec_id: r for r in ed.near_duplicates(df, recall=0.999999, block=block).collect()}
    links = brute_vectors(vecs)
    comp = close(links, range(len(vecs)))
    for i in range(len(vecs)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (sum(a == i for a, _ in links), comp[i], comp[i] == i)


def test_embedding_dedup_empty(spark):
    assert ed.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_bucket_keys_dont_depend_on_the_batch():
    x = np.random.default_rng(0).standard_normal((200, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert (ed.bucket_keys(x, 6, 10) == np.concatenate([ed.bucket_keys(x[i : i + 7], 6, 10) for i in range(0, 200, 7)])).all()


def test_near_dedup_leaves_texts_of_other_rows_in_place(spark):
    """No exchange holds whole texts but those of the few rows that are checked, though no table is small enough to be sent."""
    g = random.Random(13)
    rows = [(n, " ".join("".join(g.choices("abcdefghijklmnopqrstuvwxyz", k=40)) for _ in range(150))) for n in range(200)]
    rows += [(1000, rows[7][1] + " end"), (1001, rows[8][1] + " end")]
    store = spark.sparkContext._jsc.sc().statusStore()
    none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    written = lambda: {(x := stages.apply(i)).stageId(): x.shuffleWriteBytes() for stages in [store.stageList(None, False, False, none, spark._jvm.java.util.ArrayList())] for i in range(stages.size())}
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    before = written()
    try:
        got = {r.node: r.root for r in sd.similar_components(docs(spark, rows)).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert got == {7: 7, 1000: 7, 8: 8, 1001: 8}
    sizes = [n for k, n in written().items() if k not in before]
    assert 10_000 < max(sizes) < 0.4 * sum(len(t) for _, t in rows)


def test_unlike_texts_of_one_fingerprint_meet_one_row_only(spark, monkeypatch):
    line = "one common line " * 300
    rows = [(n, line + " ".join(f"tail{n}x{i}" for i in range(40))) for n in range(30)] + [(90, line + " ".join(f"tail0x{i}" for i in range(44)))]
    assert len({sd.fingerprint(t) for _, t in rows}) == 1
    monkeypatch.setattr(sd, "_parted", None)
    monkeypatch.setattr(sd, "_to_rest", None)
    assert {r.node: r.root for r in sd.similar_components(docs(spark, rows)).collect()} == {0: 0, 90: 0}
