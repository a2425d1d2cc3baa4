import bz2
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkloom.operators.sae import random_weights
from linkloom.sources import binary, notes, state, synthetic
from linkloom.streaming import queue


def test_vault(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / ".settings").mkdir()
    (tmp_path / "a" / "N é.md").write_text("hi é")
    (tmp_path / ".settings" / "x.md").write_text("no")
    (tmp_path / "b.txt").write_text("no")
    got = notes.read_vault(spark, str(tmp_path), (".settings",)).collect()
    assert [(r.basename, r.content, r["size"]) for r in got] == [("N é", "hi é", 5)]
    assert "content" not in notes.list_vault(spark, str(tmp_path)).columns


def test_line_sources(spark, tmp_path):
    (tmp_path / "v.txt").write_text("2 3\nfoo 1 2 3\nbar 4 5 6\n")
    assert [r.word for r in notes.read_word2vec(spark, str(tmp_path / "v.txt")).collect()] == ["foo", "bar"]
    (tmp_path / "c.txt").write_text("/a/[/r/x/,/c/en/big_data/n,/c/en/lake]\n")
    assert [r.concept for r in notes.read_concepts(spark, str(tmp_path / "c.txt")).collect()] == ["big_data", "lake]"]
    xml = "<r><page><title>A</title><redirect title='B'/><revision><text x='1'>t</text></revision></page></r>"
    (tmp_path / "p.xml.bz2").write_bytes(bz2.compress(xml.encode()))
    r = notes.read_pages(spark, str(tmp_path / "p.xml.bz2")).first()
    assert (r.title, r.redirect, r.text) == ("A", "B", "t")
    (tmp_path / "r.json").write_text(json.dumps({"epochs": [{"mse": 0.5, "dead": 1}], "finalMetrics": None}))
    assert notes.read_reports(spark, [str(tmp_path / "r.json")]).first().epochs[0].mse == 0.5
    assert notes.markdown_table(spark.range(1)) == "| id |\n| --- |\n| 0 |\n"


def test_vectors_roundtrip(spark, tmp_path):
    m = {"é": np.array([1, 2], np.float32), "": np.array([3, 4], np.float32)}
    data = binary.dump_vectors(m, 2)
    dim, got = binary.load_vectors(data)
    assert dim == 2 and all((got[k] == v).all() for k, v in m.items())
    (tmp_path / "x.bin").write_bytes(data)
    assert {r.text for r in binary.read_vectors(spark, str(tmp_path / "x.bin")).collect()} == {"é", ""}
    for bad in (data[:10], b"XXXX" + data[4:], data[:4] + b"\2\0\0\0" + data[8:], data[:-1]):
        with pytest.raises(ValueError):
            binary.load_vectors(bad)
    with pytest.raises(ValueError):
        binary.dump_vectors(m, 3)


def test_weights_roundtrip():
    w = random_weights(4, 6, 2)
    got = binary.load_weights(binary.dump_weights(w))
    assert all(np.array_equal(getattr(w, n), getattr(got, n)) for n in ("enc", "dec", "enc_bias")) and got.k == 2
    with pytest.raises(ValueError):
        binary.load_weights(b"NOPE" + binary.dump_weights(w)[4:])


def test_resume():
    new = binary.manifest("m", 2, ["a", "b", "c"])
    assert binary.resume_row(dict(new), new, 16) == 2 and binary.resume_row(dict(new), new, 15) == 0
    assert binary.resume_row(new | {"model": "x"}, new, 16) == 0 and binary.resume_row(None, new, 16) == 0


@pytest.mark.parametrize("raw,threshold,n", [(None, 0.7, 0), ("[]", 0.7, 0), ('{"version":2,"similarityThreshold":0.9}', 0.7, 0), ('{"version":1,"similarityThreshold":0.9,"denials":[{"sourceId":"a","phraseKey":"k","targetId":"t"}]}', 0.9, 1), ('{"version":1,"similarityThreshold":"x","denials":3}', 0.7, 0)])
def test_state(spark, raw, threshold, n):
    r = state.parse_state(spark.createDataFrame([(raw,)], "value string")).first()
    assert r.threshold == threshold and len(r.denials) == n and r.notes == {}


def test_state_tables(spark, tmp_path):
    s = {"version": 1, "notes": {"i": {"path": "p.md", "mtime": 5}}, "edges": {"i": [{"sourcePath": "p.md", "phrase": {"phrase": "x", "score": 0.5}, "targetPath": "T", "similarity": 0.9}]}, "labelOverrides": {"3": "l"}}
    (tmp_path / "d.json").write_text(json.dumps(s))
    t = state.read_state(spark, str(tmp_path / "d.json"))
    assert t["edges"].first().source_id == "i" and t["overrides"].first().idx == 3 and t["notes"].first().mtime == 5


def test_synthetic(spark):
    rows = synthetic.mixtures(spark, 20, 5, 8).collect()
    assert len(rows) == 20 and all(abs(np.linalg.norm(r.v) - 1) < 1e-9 for r in rows)


def test_routing(spark):
    e = spark.createDataFrame([(1, "a.md", "modify", None), (2, "b.md", "delete", None), (3, "c.md", "rename", "o.md"), (4, "f.txt", "create", None)], "ts int, path string, type string, old_path string")
    assert [(r.path, r.action) for r in queue.route(e).collect()] == [("a.md", "enqueue"), ("b.md", "cancel"), ("b.md", "drop"), ("o.md", "cancel"), ("c.md", "rename"), ("c.md", "enqueue")]


def test_debounce_and_cooldown(spark):
    jobs = spark.createDataFrame([("a", t, t) for t in (0, 300, 700, 5000)], "path string, ms int, seq int").withColumn("ts", F.timestamp_millis(F.col("ms").cast("long"))).drop("ms")
    got = queue.debounce(jobs, queue.gap()).orderBy("started").collect()
    assert [(r.n, r.seq) for r in got] == [(3, 700), (1, 5000)]
    rows = spark.createDataFrame([("a", t) for t in (0, 1000, 2000, 2500, 4100)] + [("b", 3)], "path string, t long")
    assert sorted((r.path, r.t) for r in queue.cooldown(rows).collect()) == [("a", 0), ("a", 2000), ("a", 4100), ("b", 3)]
    some = rows.withColumn("now", F.col("t") == 2500)
    assert sorted((r.path, r.t) for r in queue.cooldown(some, forced="now").collect()) == [("a", 0), ("a", 2000), ("a", 2500), ("b", 3)]
    pending = spark.createDataFrame([("a", False), ("b", False), ("c", True)], "path string, high boolean")
    assert sorted((r.path, r.high) for r in queue.switch_focus(pending, "a").collect()) == [("a", True), ("c", True)]
    arr = spark.createDataFrame([([0, 1000, 2000, 2500, 4100],)], "t array<long>")
    assert arr.select(queue.keep_after_cooldown(F.col("t"), 2000)).first()[0] == [0, 2000, 4100]


def test_exact_queue_stream(spark, tmp_path):
    rows = [(1000, "a", "enqueue", False), (1200, "a", "enqueue", False), (9000, "a", "enqueue", True), (1000, "b", "enqueue", False), (1100, "b", "cancel", False), (20000, "z", "cancel", False)]
    df = spark.createDataFrame(rows, "ms long, path string, action string, high boolean").select(F.timestamp_millis("ms").alias("ts"), "path", "action", "high")
    df.where("path <> 'z'").coalesce(1).write.parquet(str(tmp_path / "in"))
    df.where("path = 'z'").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = queue.debounced_jobs(stream).writeStream.format("memory").queryName("fired").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    fired = [(r.path, int(r.fires.timestamp() * 1000)) for r in spark.table("fired").collect()]
    assert ("a", 1700) in fired and all(p != "b" for p, _ in fired)


def test_abstracts_pages_and_lemmas(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<feed><doc><abstract>one <abstract>two</abstract> three &lt; 4</abstract></doc><doc><title>x</title></doc><doc><abstract>last</abstract></doc></feed>")
    assert [r.abstract for r in notes.read_abstracts(spark, str(tmp_path / "a.xml")).collect()] == ["one two three < 4", "last"]
    page = "<page><title>T{0}</title><revision><text xml:space='preserve'>body {0}</text></revision></page>"
    (tmp_path / "p.xml").write_text("<dump>" + "".join(page.format(i) for i in range(5)) + "</dump>")
    assert notes.read_pages(spark, str(tmp_path / "p.xml"), 2).count() == 2 and notes.read_pages(spark, str(tmp_path / "p.xml")).count() == 5
    (tmp_path / "data.noun").write_text("  1 This is a license line\n00001740 03 n 02 data_lake 0 Lake 1 003 ~ 00001930 n 0000 | text\n00002137 03 a 01 little(p) 0 000 | x\n")
    assert sorted(r.lemma for r in notes.read_lemmas(spark, str(tmp_path / "data.noun")).collect()) == ["Lake", "data lake", "little"]


def test_matrix(spark, tmp_path):
    x = np.arange(60, dtype="<f4").reshape(20, 3)
    (tmp_path / "m.bin").write_bytes(x.tobytes())
    got = sorted((r.id, r.v) for r in binary.read_matrix(spark, str(tmp_path / "m.bin"), 3).collect())
    assert got == [(i, v.tolist()) for i, v in enumerate(x)]


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([("a", 9.0, 5.0), ("b", 1.0, None), ("c", 7.0, 2.0)], "label string, cold_p50 double, warm_p50 double")
    assert [r.label for r in notes.headline(rows).collect()] == ["b", "c", "a"]
    assert len(notes.markdown_table(spark.range(1500)).splitlines()) == 1502
    paths = spark.createDataFrame([("b.md",), ("a.md",), ("c.md",)], "path string")
    assert [r.path for r in notes.first_notes(paths, 2).collect()] == ["a.md", "b.md"]


def test_persist_times(spark):
    g, rows = __import__("random").Random(1), []
    for k in "ab":
        t = 0
        for _ in range(60):
            t += g.choice([50, 100, 250, 299, 300, 301, 900])
            rows.append((k, t))
    want = []
    for k in "ab":
        first = last = n = None
        for t in [t for x, t in rows if x == k]:
            if first is not None and t >= min(last + 300, first + 1000):
                want.append((k, min(last + 300, first + 1000), n))
                first = None
            first, last, n = (t, t, 1) if first is None else (first, t, n + 1)
        want.append((k, min(last + 300, first + 1000), n))
    df = spark.createDataFrame(rows, "store string, t long").repartition(3)
    assert sorted(map(tuple, queue.persist_times(df, most_ms=1000).collect())) == sorted(want)


def test_events_count_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    line = '{"ts": "2024-01-01T00:00:0%dZ", "path": "%s", "type": "modify"}\n'
    (tmp_path / "in" / "1.json").write_text(line % (1, "a.md") + line % (1, "a.md") + line % (2, "b.txt"))
    (tmp_path / "in" / "2.json").write_text(line % (1, "a.md") + line % (3, "a.md"))
    q = queue.read_events(spark, str(tmp_path / "in")).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.path, r.ts.second) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("a.md", 1), ("a.md", 3)]


def test_vault_queue_with_focus(spark, tmp_path):
    rows = [(0, "a.md", "enqueue"), (100, "b.md", "enqueue"), (200, "b.md", "focus"), (300, "b.md", "enqueue"), (350, "c.md", "enqueue"), (900, "b.md", "enqueue"), (1000, "d.md", "enqueue"), (1050, "x", "flush"), (1200, "e.md", "enqueue"), (1300, "e.md", "cancel"), (1400, "c.md", "force")]
    df = spark.createDataFrame([(t, "v", p, a) for t, p, a in rows], "ms long, vault string, path string, action string").select(F.timestamp_millis("ms").alias("ts"), "vault", "path", "action")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    end = spark.createDataFrame([(60_000, "w", "z", "cancel")], "ms long, vault string, path string, action string").select(F.timestamp_millis("ms").alias("ts"), "vault", "path", "action")
    end.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = queue.vault_jobs(stream).writeStream.format("memory").queryName("vault_fired").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    fired = sorted((int(r.fires.timestamp() * 1000), r.path) for r in spark.table("vault_fired").collect())
    # the focus cancels a and b's normal job; b fires at 500; c at 850; the flush runs b (again, no cooldown) and d; e is cancelled; c is forced
    assert fired == [(500, "b.md"), (850, "c.md"), (1050, "b.md"), (1050, "d.md"), (1400, "c.md")]


def test_failed_notes_are_left_out(spark, tmp_path):
    jobs = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "path string, n int").withColumn("ts", F.timestamp_seconds("n")).drop("n")
    jobs.write.parquet(str(tmp_path / "in"))

    def resolve(latest):
        return latest.select(F.col("path").alias("source_id"), F.when(F.col("path") == "b", F.raise_error(F.lit("bad note"))).otherwise(F.col("path")).alias("target"))

    q = queue.publish(spark.readStream.schema(jobs.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), resolve, available_now=True, skip_failed=True)
    q.awaitTermination()
    assert {r.source_id for r in spark.read.parquet(str(tmp_path / "out/edges")).collect()} == {"a", "c"}
