import random

import numpy as np
import pytest
from hypothesis import given, strategies as st
from pyspark.sql import functions as F

from linkloom.operators import embed, evaluate, merge, resolve, sae, store
from linkloom.plans import edges, text as text_queries
from linkloom.plans.discover import discover_links


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


@given(st.text("abc ", max_size=12), st.text("abc ", max_size=12))
def test_lcs(a, b):
    assert resolve.lcs_length(a, b) == slow_lcs(a, b)
    x, y, m = resolve.letter_masks([a, b])
    bound = int(x[0] & x[1]).bit_count() + int(y[0] & y[1]).bit_count() + min(m)
    assert bound >= slow_lcs(a, b)


def norm(s):
    return " ".join(s.lower().split())


@pytest.mark.parametrize("sent", [True, False])
def test_lcs_join_equals_brute_force(spark, sent, monkeypatch):
    if not sent:
        monkeypatch.setattr(resolve, "is_small", lambda df: False)
    g = random.Random(3)
    words = ["data", "lake", "lakes", "spark", "sparks", "stream", "streams", "the", "of", "graph"]
    phrases = sorted({" ".join(g.choices(words, k=g.randint(1, 3))) for _ in range(60)})
    titles = sorted({" ".join(g.choices(words, k=g.randint(1, 3))).title() for _ in range(40)})
    want = set()
    for p in phrases:
        rows = []
        for o, t in enumerate(titles):
            a, b = norm(p), norm(t)
            shared = [i for i, w in enumerate(a.split()) if w in b.split()]
            if not shared:
                continue
            s = slow_lcs(a, b) / max(len(a), len(b)) * (1.5 if a == b else 1.1 if b in a else 1)
            if min(1, s) >= 0.85:
                rows.append((-min(1.0, s), shared[0], o, t))
        want |= {(p, t, round(-s, 9)) for s, _, _, t in sorted(rows)[:3]}
    got = resolve.lcs_pairs(spark.createDataFrame([(p,) for p in phrases], "phrase string"), spark.createDataFrame([(t, i) for i, t in enumerate(titles)], "title string, ord int"))
    assert {(r.phrase, r.title, round(r.similarity, 9)) for r in got.collect()} == want


@pytest.mark.parametrize("sent", [True, False])
def test_self_link_doesnt_take_a_place(spark, sent, monkeypatch):
    if not sent:
        monkeypatch.setattr(resolve, "is_small", lambda df: False)
    phrases = spark.createDataFrame([(1, "A/Data Lake.md", "data lake", 0.0)], "note_id int, source_name string, phrase string, score double").withColumn("source_name", F.lit("Data Lake"))
    titles = spark.createDataFrame([("Data Lake", 0), ("Data Lakes", 1), ("Data Lake X", 2)], "title string, ord int")
    assert {r.title for r in resolve.resolve_lcs(phrases, titles, per_phrase=2).collect()} == {"Data Lakes"} | ({"Data Lake X"} if 9 / 11 >= 0.85 else set())


def test_title_index_equals_all_pairs():
    g = random.Random(5)
    words = ["a", "the", "lake", "lakes", "of", "étang", "stream's", "x" * 30]
    titles = ["".join([" ".join(g.choices(words, k=g.randint(1, 4)))]) for _ in range(80)]
    phrases = [" ".join(g.choices([*words, "laké"], k=g.randint(1, 5))) for _ in range(200)] + ["", "nothing"]
    index = resolve.TitleIndex(titles, 0.85)
    want = []
    for i, p in enumerate(phrases):
        for j, t in enumerate(titles):
            shared = [k for k, w in enumerate(p.split(" ")) if w in t.split(" ")]
            s = slow_lcs(p, t) / max(len(p), len(t)) if p else 0
            s = min(1.0, s * (1.5 if p == t else 1.1 if t in p else 1.0))
            if shared and s >= 0.85:
                want.append((i, -s, shared[0], j))
    assert index.match(phrases) == sorted(want) == index.match(phrases, pairs=7) and len(want) > 50
    assert resolve.TitleIndex([], 0.85).match(["a"]) == []


def test_many_titles_make_no_rows_of_pairs(spark):
    """More titles than used to be sent are compared where phrases are: all share a word with the phrase."""
    titles = spark.range(60_000).select(F.concat(F.lit("the "), F.hex(F.col("id") * 7919)).alias("title"), F.col("id").cast("int").alias("ord"))
    phrases = spark.createDataFrame([(1, "x", "the ABCDEF99", 0.0)], "note_id int, source_name string, phrase string, score double")
    found = resolve.resolve_lcs(phrases, titles)
    assert "Join" not in str(found._jdf.queryExecution().optimizedPlan())
    assert all(r.similarity >= 0.85 for r in found.collect())


@given(st.text(st.characters(max_codepoint=127, exclude_characters="\0"), max_size=30))
def test_ascii_is_normalized_alike(text):
    import re

    low = re.sub(r"[ \t\n\x0b\f\r]+", " ", text.lower())
    assert resolve._plain(text) == re.sub(r"'s(?![a-z0-9_])", "", low).strip(" ")


def test_tasks_normalize_ascii_themselves(spark):
    texts = ["A  b\t's", "Spark's lake's", "it's_x 's", " \x1c Data\x0bLake ", "Caf\u00e9's", "l\u2019art's", "", " "]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    from linkloom.functions.text import normalize

    for r in rows.select("t", normalize(F.col("t")).alias("n"), resolve._unless_ascii(F.col("t")).alias("u")).collect():
        assert r.n == (resolve._plain(r.t) if r.u is None else r.u) and (r.u is None) == r.t.isascii()


def test_resumed_embedding(spark, tmp_path):
    root, calls = str(tmp_path / "e"), spark.sparkContext.accumulator(0)

    def embedder(texts):
        calls.add(len(texts))
        return embed.hash_embedder(4)(texts)

    texts = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "text string")
    assert embed.embed_resumed(texts, root, embedder, "m", 4).count() == 2 and calls.value == 2
    more = texts.unionByName(spark.createDataFrame([("c",)], "text string"))
    assert {r.text for r in embed.embed_resumed(more, root, embedder, "m", 4).collect()} == {"a", "b", "c"} and calls.value == 3
    assert embed.embed_resumed(texts, root, embedder, "other", 4).count() == 2 and calls.value == 5
    pooled = embed.pooled_embedder(lambda t: (np.arange(12.0).reshape(1, 3, 4).repeat(len(t), 0), np.array([[1, 1, 0]] * len(t))))
    assert np.allclose(pooled(["x"])[0], np.array([2, 3, 4, 5]) / np.linalg.norm([2, 3, 4, 5]))


class Slow:
    def __call__(self, texts):
        import time

        time.sleep(2)

    def dispose(self):
        pass


def test_a_slow_embedder_fails(spark):
    with pytest.raises(Exception, match="Timeout"):
        embed.embed_texts(spark.createDataFrame([("a",)], "text string"), Slow(), seconds=0.2).collect()
    high = spark.createDataFrame([("a", False), ("b", True), ("a", True)], "text string, high boolean")
    assert sorted(r.text for r in embed.embed_texts(high, embed.hash_embedder(2)).collect()) == ["a", "b"]


@pytest.mark.parametrize("block", [3, 100])
def test_dense_join_equals_brute_force(spark, block):
    g = np.random.default_rng(0)
    l, r = g.standard_normal((20, 6)), g.standard_normal((30, 6))
    r[4] = 0
    ln, rn = l / np.linalg.norm(l, axis=1, keepdims=True), r / np.maximum(np.linalg.norm(r, axis=1, keepdims=True), 1e-30)
    s = ln @ rn.T
    want = {(i, j) for i in range(20) for j in np.argsort(-s[i], kind="stable")[:3] if s[i, j] >= 0.3}
    df = lambda x: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    assert {(a.l_id, a.r_id) for a in resolve.dense_pairs(df(l), df(r), 0.3, 3, block).collect()} == want


def test_best_equals_sorting_with_ties_and_own_columns():
    g = np.random.default_rng(1)
    v = g.standard_normal((300, 5))
    v[50:120] = v[7]  # copies: ties
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    s = np.einsum("id,jd->ij", v, v)
    own = (np.arange(300), np.arange(300) + 1)
    for k, threshold in ((1, -1.0), (3, 0.4), (400, 0.9)):
        want = []
        for i in range(300):
            js = [j for j in np.lexsort((np.arange(300), -np.round(s[i], 12))) if j != i and s[i, j] >= threshold][:k]
            want += [(i, j) for j in js]
        one = lambda a, z, c, y: v[a:z].astype(np.float32) @ v[c:y].astype(np.float32).T
        i, j, x = resolve._best(300, 300, k, threshold, 1e-5, one, lambda i, j, _: s[i, j], own, rows=64, columns=40)
        assert list(zip(i.tolist(), j.tolist())) == want and np.array_equal(x, s[i, j])
        i, j, _ = resolve._cosines(v, v, threshold, k, own)
        assert list(zip(i.tolist(), j.tolist())) == want


@pytest.mark.parametrize("features,block", [(20, 11), (20, 1000), (1 << 22, 11), (1 << 22, 1000)])
def test_sparse_join_sends_no_pairs_and_equals_brute_force(spark, features, block):
    """Pairs that share a feature aren't joined as rows; groups meet, by matrices or by feature."""
    g = random.Random(7)
    names = [i * 999 for i in range(20)]
    each = {i: {f: g.choice([0.5, 1.0, 2.0]) for f in g.sample(names, 3)} for i in range(60)}
    each |= {60 + i: dict(each[i]) for i in range(5)}
    wide = {1000 + i: float(i + 1) for i in range(features // 20 if features > 20 else 0)}  # makes the matrix too large
    rows = [(i, f, x) for i, v in each.items() for f, x in v.items()] + [(99, f, x) for f, x in wide.items()]
    length = lambda v: sum(x * x for x in v.values()) ** 0.5
    want = {}
    for i, a in each.items():
        sims = [(-round(sum(x * b.get(f, 0) for f, x in a.items()) / length(a) / length(b), 12), j) for j, b in each.items() if j != i]
        want |= {(i, j): -s for s, j in sorted(sims)[:3] if -s >= 0.3}
    f = spark.createDataFrame(rows, "id long, idx int, value double")
    found = resolve.sparse_pairs(f, f, 0.3, 3, same=True, block=block)
    assert "_b" in str(found._jdf.queryExecution().optimizedPlan()) and "Join" not in str(found._jdf.queryExecution().optimizedPlan())
    got = {(r.l_id, r.r_id): r.similarity for r in found.collect() if 99 not in (r.l_id, r.r_id)}
    assert got.keys() == want.keys() and all(got[p] == pytest.approx(want[p]) for p in want)


def test_sparse_join_and_explanation(spark):
    rows = [("a", 0, 2.0), ("a", 3, 3.0), ("b", 3, 4.0), ("c", 5, 1.0)]
    f = spark.createDataFrame(rows, "id string, idx int, value double")
    got = {(r.l_id, r.r_id): r.similarity for r in resolve.sparse_pairs(f, f, 0.5, 3, same=True).collect()}
    assert got == {("a", "b"): pytest.approx(12 / (13**0.5 * 4)), ("b", "a"): pytest.approx(12 / (13**0.5 * 4))}
    with pytest.raises(ValueError):
        resolve.sparse_pairs(f, f, 0.0)
    pairs = spark.createDataFrame([("a", "b"), ("a", "c")], "l_id string, r_id string")
    labels = spark.createDataFrame([(3, "three")], "idx int, label string")
    assert [(r.r_id, r.label, r["product"]) for r in resolve.explanation(pairs, f, f, labels).collect()] == [("b", "three", 12.0)]


EDGE = "note_id int, phrase string, score double, target string, target_id string, similarity double, resolver string, features array<int>, ord int"


def test_merge(spark):
    rows = [
        (1, "Data Lake", 0.1, "Lake", None, 0.82, "lcs", None, 0),
        (1, "data  lake", 0.1, "Lake", None, 0.77, "dense", [1], 1),
        (1, "data lake", 0.1, "Lake", None, 0.91, "sparse", [1, 2], 2),
        (1, "data lake", 0.1, "Lake", None, 0.99, "lcs", None, 3),
        (1, "x", 0.1, "Y", None, 0.8, "lcs", None, 4),
        (1, "x", 0.1, "Y", None, 0.7, "dense", None, 5),
    ]
    got = {r.phrase_key: r for r in merge.merge_by_target(spark.createDataFrame(rows, EDGE)).collect()}
    m = got["data lake"]
    assert (m.phrase, m.matched_by, m.match_type, m.similarity, m.lcs_similarity, m.features) == ("Data Lake", ["lcs", "dense", "sparse"], "mixed", 0.91, 0.82, [1, 2])
    assert got["x"].match_type == "both"
    cards = {r.phrase: (r.badge, r.percent) for r in merge.cards(merge.merge_by_target(spark.createDataFrame(rows, EDGE))).collect()}
    assert cards["x"] == ("lcs+dense", "80%")


def test_dedup_and_rank(spark):
    rows = [(1, "A", 0.5, "T", None, 0.9, "lcs", None, 1), (1, "a", 0.1, "T", None, 0.9, "lcs", None, 2), (1, "b", 0.0, "U", None, 0.8, "lcs", None, 3)]
    got = merge.dedup_and_rank(spark.createDataFrame(rows, EDGE)).orderBy("rank").collect()
    assert [(r.phrase, r.rank) for r in got] == [("b", 1), ("A", 2)]


def test_store(spark):
    e = spark.createDataFrame([("s", "Foo Bar", "t", 0.9), ("s", "x", "t", 0.6), (None, "foo bar", "t", 0.8), ("u", "y", "s", 0.75)], "source_id string, phrase string, target_id string, similarity double")
    keys = spark.createDataFrame([("s", "foo bar", "t")], "source_id string, phrase_key string, target_id string")
    assert {r.phrase for r in store.suppress(e, keys).collect()} == {"x", "foo bar", "y"}
    assert [r.phrase for r in store.read_edges(e).where("source_id = 's'").collect()] == ["Foo Bar"]
    assert {r.phrase for r in store.drop_notes(e, spark.createDataFrame([("s",)], "id string")).collect()} == {"foo bar"}
    left, all_keys = store.give_feedback(e, keys, keys)
    assert left.count() == 3 and all_keys.count() == 1
    new = spark.createDataFrame([("s", "n", "t", 1.0)], e.schema)
    assert {r.phrase for r in store.set_edges(e.where("source_id is not null"), new, keys).collect()} == {"n", "y"}
    assert store.prune(e, 0.8).count() == 2


def greedy_reconcile(notes, files):
    current = {f[0] for f in files}
    known = {n[1] for n in notes}
    new, claimed, out = [f for f in files if f[0] not in known], set(), {}
    for nid, path, _, size, _ in notes:
        if path in current:
            out[nid] = "kept"
            continue
        c = [f for f in new if f[2] == size and f[0] not in claimed] if size is not None else []
        out[nid] = "reattached" if len(c) == 1 else "dropped"
        if len(c) == 1:
            claimed.add(c[0][0])
    return out, len([f for f in new if f[0] not in claimed])


def test_reconcile_equals_greedy(spark):
    g = random.Random(5)
    for _ in range(6):
        notes = [(f"i{k}", f"p{k}", 1, g.choice([1, 2, 3, None]), k) for k in range(8)]
        files = [(f"p{k}", 2, g.choice([1, 2, 3, 4])) for k in g.sample(range(14), 8)]
        got = store.reconcile(spark.createDataFrame(notes, "id string, path string, mtime long, size long, ord int"), spark.createDataFrame(files, "path string, mtime long, size long")).collect()
        want, added = greedy_reconcile(notes, files)
        assert {r.id: r.action for r in got if r.action != "added"} == want and sum(r.action == "added" for r in got) == added


def test_evaluate(spark):
    pred = spark.createDataFrame([("s", 1, "a"), ("s", 1, "b"), ("s", 2, "z"), ("s", 9, "q")], "system string, note_id int, target string")
    truth = spark.createDataFrame([(1, "a"), (1, "c"), (2, "y")], "note_id int, target string")
    r = evaluate.micro(evaluate.confusion(pred, truth)).first()
    assert (r.tp, r.fp, r.fn) == (1, 2, 2) and r.f1 == pytest.approx(1 / 3)
    times = spark.createDataFrame([(float(x),) for x in range(20)], "ms double")
    s = evaluate.latency_summary(times.withColumn("g", F.lit(1)), "g").first()
    assert (s.p50, s.p95, s.p99, s["max"], s.total) == (10, 19, 19, 19, 190)
    recalls = evaluate.recall_at_k(spark.createDataFrame([(1, 5, 1), (1, 6, 2)], "probe int, id int, rank int"), spark.createDataFrame([(1, 6, 1), (1, 7, 2)], "probe int, id int, rank int"), 2)
    assert recalls.first().recall == 0.5


def test_sae(spark):
    w = sae.random_weights(8, 32, 4, 99)
    assert np.allclose(np.linalg.norm(w.dec, axis=1), 1, atol=1e-5)
    x = np.random.default_rng(1).standard_normal((10, 8))
    at, values = w.encode(x)
    assert at.shape == (10, 4) and (np.diff(values, axis=1) <= 0).all()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    atoms = spark.createDataFrame([(i, w.enc[i].astype(float).tolist(), 0.0, [0.0] * 8, w.dec[i].astype(float).tolist()) for i in range(32)], "idx int, enc array<double>, bias double, pre array<double>, dec array<double>")
    a = sorted((r.id, r["rank"], r.idx, round(r.value, 6)) for r in sae.encode_batches(df, w).collect())
    b = sorted((r.id, r["rank"], r.idx, round(r.value, 6)) for r in sae.encode(df, atoms, 4).collect())
    assert a == b
    out = {r.id: r.v for r in sae.decode(sae.encode(df, atoms, 4), atoms).collect()}
    assert np.allclose([out[i] for i in range(10)], w.decode(at, values), atol=1e-5)
    with pytest.raises(ValueError):
        sae.Weights(w.enc, w.enc_bias, w.pre_bias[:3], w.dec, w.dec_bias, 4)


def test_sae_training_halves_the_error():
    from linkloom.sources.synthetic import concepts

    c, g = concepts(8, 16), np.random.default_rng(0)
    x = np.stack([c[a] * u + 0.5 * c[b] * v for a, b, u, v in zip(g.integers(8, size=512), g.integers(8, size=512), g.random(512) + 0.5, g.random(512))])
    w, log = sae.train(x, 64, 4, epochs=20, rate=3e-3)
    assert log[-1]["mse"] < log[0]["mse"] / 2 and log[-1]["l0"] <= 4 and np.allclose(np.linalg.norm(w.dec, axis=1), 1)


def test_embed(spark):
    t = spark.createDataFrame([("abc",), ("Zed",), ("abc",), (None,)], "text string")
    got = {r.text: r.v for r in embed.embed_texts(t, embed.hash_embedder(8)).collect()}
    assert set(got) == {"abc", "Zed"}
    expr = {r.text: r.v for r in t.where("text is not null").select("text", embed.hash_embedding(F.col("text")).alias("v")).collect()}
    assert all(np.allclose(got[k], expr[k]) for k in got)
    cache = spark.createDataFrame([("abc", [1.0])], "text string, v array<double>")
    assert [r.text for r in embed.embed_missing(t, cache, embed.hash_embedder(8)).collect()] == ["Zed"]


def test_discover(spark):
    notes = spark.createDataFrame([(1, "We love the data lakes. Kafka streams"), (2, "nothing")], "note_id long, text string")
    titles = spark.createDataFrame([("Data Lake", 0), ("Kafka Streams", 1)], "title string, ord int")
    got = {(r.phrase, r.target): r.match_type for r in discover_links(notes, titles, embed.hash_embedder(16), dense_threshold=0.999).collect()}
    assert got[("data lakes", "Data Lake")] == "deterministic" and ("Kafka streams", "Kafka Streams") in got


def test_every_phrase_without_a_strong_match_is_embedded(spark):
    """Also those beyond the 60 shortest of a note."""
    notes = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(80)) + " extraordinarily")], "note_id long, text string")
    titles = spark.createDataFrame([("Target", 0)], "title string, ord int")
    embedder = lambda texts: np.array([[1.0, 0.0] if t in ("extraordinarily", "Target") else [0.0, 1.0] for t in texts])
    assert [(r.phrase, r.target, r.match_type) for r in discover_links(notes, titles, embedder, max_n=1).collect()] == [("extraordinarily", "Target", "stochastic")]


@given(st.lists(st.text(" aBz\u00e9\U0001f600", max_size=20), max_size=5))
def test_hash_embedder_adds_codes_round_the_dimensions(texts):
    want = np.zeros((len(texts), 3))
    for row, t in zip(want, texts):
        for i, c in enumerate(t.strip().lower()):
            row[i % 3] += ord(c)
    n = np.linalg.norm(want, axis=1, keepdims=True)
    assert np.array_equal(embed.hash_embedder(3)(texts), np.divide(want, n, out=want, where=n > 0))


VAULT = {
    "Data Lake": "---\ntags: x\n---\n# Data Lake\n\nA store for raw data. It feeds a [[Data Warehouse]] and [[Stream Processing]].\n%% wiki footer\n[[Graph Theory]]",
    "Data Warehouse": "# Data Warehouse\n\nTables for reports, loaded from a [[Data Lake]] by [[Batch Processing|nightly jobs]]. See [[Star Schema#facts]].",
    "Stream Processing": "Events are handled as they come. ```\n[[Data Lake]]\n``` Compare [[Batch Processing]].",
    "Batch Processing": "Many rows at once, often over a [[Data Lake]]. ![[picture.png]]",
    "Star Schema": "Facts and dimensions in a [[Data Warehouse]].",
    "Graph Theory": "Nothing to see but vertices.",
}


def test_planted_links_are_found(spark):
    from linkloom.functions.text import normalize
    from linkloom.operators import links

    names = sorted(VAULT)
    notes = spark.createDataFrame([(i, n, VAULT[n]) for i, n in enumerate(names)], "note_id long, name string, content string")
    titles = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "title string, ord int")
    plain = notes.withColumn("content", links.remove_aliased(F.col("content")))
    truth = plain.select("note_id", F.explode(links.link_targets(F.col("content"))).alias("target"))
    text = plain.select("note_id", links.strip_links(links.zones(F.col("content"))["body"]).alias("text"))
    found = discover_links(text, titles, max_n=3)
    own = notes.select("note_id", normalize(F.col("name")).alias("own"))
    predicted = found.select("note_id", normalize(F.col("target")).alias("target")).join(own, "note_id").where("target <> own").select(F.lit("lcs").alias("system"), "note_id", "target")
    got = evaluate.micro(evaluate.confusion(predicted, truth, titles.select(normalize(F.col("title")).alias("title")))).first()
    assert (got.tp, got.fn) == (7, 0) and got.recall == 1 and got.precision > 0.8


def test_link_discovery_runs_whole(spark, tmp_path):
    texts = ["alpha beta gamma is here", "we read alpha beta gamma again", "delta epsilon zeta ends", "then delta epsilon zetas came"]
    spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = edges.link_discovery(spark, str(tmp_path)).collect()
    assert (2, "alpha beta gamma") in {(r.note_id, r.target) for r in got if r.similarity == 1.0}
    assert {"lcs", "dense", "sparse"} <= {m for r in got for m in r.matched_by.split("+")}
    assert any("dense" in r.matched_by and r.similarity < 0.99 for r in got)


def test_flagship_queries_form_long_phrases(spark, tmp_path):
    text = "Copper kettles boil quickly under bright mountain lanterns nightly."
    spark.createDataFrame([(1, text), (2, "Old copper kettles boil quickly under bright mountain lanterns.")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    phrases = {r.phrase for r in text_queries.yake_topn(spark, str(tmp_path)).collect()}
    assert max(len(p.split()) for p in phrases) > 3 and len(phrases) > 20
    assert any(len(r.phrase.split()) == 4 for r in edges.lcs_resolve(spark, str(tmp_path)).collect())
