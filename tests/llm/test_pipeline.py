import corpus_pipeline
from linkloom.llm import toxicity as tx


def test_stages(spark, tmp_path):
    base = " ".join(f"word{i}" for i in range(200))
    rows = [(1, base), (2, base.replace(" ", "  ")), (3, base.replace("word100", "other")), (4, "mail me at ann@site.org now please"), (5, "quite another text"), (6, None), (7, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == docs.columns, name
    got = {r.doc_id: r.text for r in at.collect()}
    assert set(got) == {2, 4, 5, 6}  # 2 has more characters than 1, 3 is like 2, 6 comes before 7
    assert "ann@site.org" not in got[4] and got[5] == "quite another text"
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(got) and all(r.offset + r.length <= 2048 for r in packed)


def test_rows_equal_brute_force(spark, tmp_path):
    """All stages over made documents: which rows stay, what is in them, and what is packed."""
    import random
    import re
    import zlib

    from tokenizers import Tokenizer

    from linkloom.llm import pii
    from linkloom.llm.common import tokenizer_path

    g = random.Random(11)
    vocab = ["".join(g.choices("abcdefghijklm", k=g.randint(3, 8))) for _ in range(600)]
    rows, labels = [], []
    for i in range(400):
        w, y = g.choices(vocab, k=g.randint(30, 120)), int(g.random() < 0.15)
        if y:
            for _ in range(g.randint(3, 6)):
                w[g.randrange(len(w))] = g.choice(["zvile", "zrotten", "zlousy", "znasty"])
        rows.append((i, " ".join(w)))
        labels.append((i, 1, y))
    clean = [r for r, (_, _, y) in zip(rows, labels) if not y]
    for n, (i, t) in enumerate(clean[:60]):
        w = t.split(" ")
        rows.append((1000 + n, [t, t.replace(" ", "  "), " ".join([*w[:3], "other", *w[4:]]), t + " write to a.b@c.org or +1 098 555 0174"][n % 4]))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    model = tx.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    left = {i: t for i, t in rows if model.score(t) < tx.THRESHOLD}
    assert sum((i in left) == (not y) for i, _, y in labels) > 390
    groups = {}
    for i, t in left.items():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t), []).append((-len(t), i))
    left = {i: left[i] for i in (min(x)[1] for x in groups.values())}
    sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, t in left.items() for w in [t.lower().split()]}
    root = {i: i for i in left}
    for _ in range(5):
        for a in sets:
            for b in sets:
                if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    root[b] = min(root[a], root[b])
    left = {i: t for i, t in left.items() if root[i] == i}
    spark.conf.set("spark.linkloom.pii.key", "00" * 16)
    try:
        packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.linkloom.pii.key")
    s = pii.Surrogates(bytes(16))
    coder = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    want = {i: coder.encode(s.text(t)[0], add_special_tokens=False).ids + [0] for i, t in left.items()}
    assert sorted((r.doc_id, r.length, r.ids_crc32) for r in packed) == sorted((i, len(x), zlib.crc32(b"".join(n.to_bytes(4, "little") for n in x))) for i, x in want.items())
    assert all(r.offset + r.length <= 2048 for r in packed)


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash_near_dedup", "pii_surrogates", "best_fit_packing"]
    assert tx.THRESHOLD == 0.3


def test_near_dedup_goes_through_fingerprints(spark, monkeypatch):
    """What fingerprints within 3 bits bring together is found without the second search, and stays only if whole texts are alike."""
    import random

    from linkloom.llm import simhash_dedup as sd

    g = random.Random(12)
    rows, near = [], {}
    for n in range(40):
        w = [f"w{g.randrange(5000)}" for _ in range(500)]
        copy = [*w[:-1], "other"]
        rows += [(2 * n, " ".join(w)), (2 * n + 1, " ".join(copy))]
        near[2 * n + 1] = (sd.fingerprint(rows[-2][1]) ^ sd.fingerprint(rows[-1][1])).bit_count() <= 3
    line = "one common line " * 300
    rows += [(100 + n, line + " ".join(f"tail{n}x{i}" for i in range(40))) for n in range(3)]
    assert len({sd.fingerprint(t) for i, t in rows if i >= 100}) == 1 and sum(near.values()) > 20
    df = spark.createDataFrame(rows, "doc_id long, text string")
    checks, check = [], sd._checked
    monkeypatch.setattr(sd, "_checked", lambda body, members, *more: checks.append({r.m_id for r in members.collect()}) or check(body, members, *more))
    assert {r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, df, "").collect()} == {i for i, _ in rows if i >= 100 or i % 2 == 0}
    assert checks[1] == {i for b, found in near.items() if not found for i in (b - 1, b)}  # what is one group isn't checked again
    monkeypatch.setattr(sd, "_candidate_links", lambda live, *_: live.select(live.row.alias("u"), live.row.alias("v")))
    assert {r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, df, "").collect()} == {i for i, _ in rows if not near.get(i)}
