import math
from itertools import product

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from linkloom.functions import random as rnd, text as T, vectors as V
from linkloom.operators import corpus, links, spans, yake
from linkloom.operators.markdown import plain_sentences


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize("x,want", [("  Café's  Crème ", "cafe creme"), ("ÉCOLE", "ecole"), ("Résumé", "resume"), ("A\tB", "a b"), ("naïve", "naive")])
def test_normalize(spark, x, want):
    assert one(spark, x, T.normalize) == want


def test_keys_and_names(spark):
    assert one(spark, "  Foo   Bar ", T.phrase_key) == "foo bar"
    assert one(spark, "a/b/Some Note.md", T.normalized_basename) == "some note"
    assert one(spark, "don't go-there é1", T.tokens) == ["don't", "go", "there", "1"]
    assert one(spark, "A b. C! d", T.sentences) == ["A b.", "C!", "d"]
    assert one(spark, "a &amp; &#65;&#x42; &lt;&nope; &amp;lt;", T.decode_entities) == "a & AB <&nope; &lt;"


@pytest.mark.parametrize("w,want", [("quickly", "adverb"), ("running", "noun"), ("optimize", "verb"), ("nation", "noun"), ("magical", "adj"), ("Kafka", "noun"), ("the", "unknown"), ("spark", "unknown")])
def test_pos(spark, w, want):
    assert one(spark, w, T.guess_pos) == want


def test_generator(spark):
    for seed in (0, 0x12345678, 2**32 - 1):
        rows = spark.range(1, 40).select("id", rnd.uniform(seed, F.col("id")).alias("u")).collect()
        assert [r.u for r in rows] == [rnd.uniform_at(seed, r.id) for r in rows]


@pytest.mark.parametrize("n,cap,seed", [(5, 10, 1), (200, 7, 42), (50, 50, 3)])
def test_reservoir_equals_sequential(spark, n, cap, seed):
    items, draw = [], 0
    for i in range(1, n + 1):
        if len(items) < cap:
            items.append(i)
        else:
            draw += 1
            j = int(rnd.uniform_at(seed, draw) * i)
            if j < cap:
                items[j] = i
    got = corpus.reservoir(spark.range(1, n + 1).select(F.col("id").alias("i"), F.col("id").alias("item")), cap, seed).orderBy("slot").collect()
    assert [r.item for r in got] == items


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 2.0], [2.0, 4.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    got = [r[0] for r in df.select(V.cosine(F.col("a"), F.col("b"))).collect()]
    assert got[0] == pytest.approx(1) and got[1] == 0
    pooled = spark.createDataFrame([([[1.0, 0.0], [3.0, 4.0], [9.0, 9.0]], [1, 1, 0])], "s array<array<double>>, m array<int>").select(V.mean_pool(F.col("s"), F.col("m"))).first()[0]
    assert pooled == pytest.approx([2 / math.sqrt(8), 2 / math.sqrt(8)])
    sp = "array<struct<idx:int,value:double>>"
    df = spark.createDataFrame([([(0, 2.0), (3, 3.0)], [(3, 4.0)])], f"a {sp}, b {sp}")
    assert df.select(V.sparse_cosine(F.col("a"), F.col("b"))).first()[0] == pytest.approx(12 / (math.sqrt(13) * 4))


def test_links(spark):
    note = "---\na: [[x]]\n---\nSee [[Data Lake]], [[Kafka|the log]], [[Spark#api]] ![[img]]\n```\n[[code]]\n```\n%% wiki footer [[foot]]"
    assert one(spark, note, links.link_targets) == ["data lake", "kafka", "spark"]
    assert "Kafka" not in one(spark, note, links.remove_aliased) and "[[foot]]" in one(spark, note, links.remove_aliased)
    assert one(spark, "a [[x|y]] [[p#q]] [[r]] ![[z]]", links.strip_links) == "a y p r "
    assert one(spark, "a [[x|y]] [[p#q]] [[ ]]", links.anchors) == ["y", "p"]


@pytest.mark.parametrize("content,phrase,start,title,want", [
    ("learn spark now", "spark", 6, "Spark", ("learn [[Spark]] now", True, None)),
    ("learn sparks now", "sparks", 6, "Spark", ("learn [[Spark|sparks]] now", True, None)),
    ("learn spark now", "spork", 6, "Spark", ("learn spark now", False, "span-drift")),
    ("a [[spark]] b", "spark", 4, "Spark", ("a [[spark]] b", False, "already-linked")),
    ("a [spark](u) b", "spark", 3, "Spark", ("a [spark](u) b", False, "already-linked")),
])
def test_write_back(spark, content, phrase, start, title, want):
    df = spark.createDataFrame([(content, phrase, start, start + len(phrase), title)], "c string, p string, s int, e int, t string")
    got = df.select(links.write_back(F.col("c"), F.col("p"), F.col("s"), F.col("e"), F.col("t")).alias("w")).first().w
    assert tuple(got) == want


def test_strip_mentions(spark):
    notes = spark.createDataFrame([("A Spark SQL and spark and [[Spark]] sparkle", "Other"), ("Spark here", "Spark")], "content string, basename string")
    titles = spark.createDataFrame([("Spark",), ("Spark SQL",)], "t string")
    assert [r.content for r in links.strip_mentions(notes, titles).collect()] == ["A  and  and [[Spark]] sparkle", "Spark here"]


def test_spans_and_mentions(spark):
    notes = spark.createDataFrame([(1, "The big data lake. Big data of a x"), (2, None), (3, "")], "note_id int, text string")
    got = [r.phrase for r in spans.span_phrases(notes, max_n=2).orderBy("place").collect()]
    assert got == ["big", "data", "lake", "The big", "big data", "data lake"][:3] + ["The big", "big data", "data lake"] + ["a x"]
    titles = spark.createDataFrame([("Data Lake",), ("lake",), ("C++",), ("ake",), ("x",)], "title string")
    text = spark.createDataFrame([(1, "a data lake, c++ code")], "note_id int, text string")
    assert {(r.title, r.at) for r in spans.title_mentions(text, titles).collect()} == {("Data Lake", 2), ("lake", 7), ("C++", 13)}


def test_spans_leave_their_task_as_few_rows(spark):
    """The shortest ones, those that are titles and summaries are made where the note is: no sort or shuffle of all."""
    rows = [(1, "The big data lake. Big data of a x"), (2, None), (3, ""), (4, "Data LAKE data lake's")]
    notes = spark.createDataFrame(rows, "note_id int, text string")
    every = spans.span_phrases(notes, max_n=2)
    some = spans.span_phrases(notes, max_n=2, shortest=3)
    assert some.groupBy("note_id").count().orderBy("note_id").collect() == [(1, 3), (4, 3)]
    rank = lambda df: {tuple(r) for r in spans.embed_cap(df, 3).select("note_id", "phrase", "place").collect()}
    assert rank(some) == rank(every)
    only = spans.span_phrases(notes, max_n=2, only=spark.createDataFrame([("Data Lake",), ("of a",), (None,)], "t string"))
    assert {(r.note_id, r.phrase) for r in only.collect()} == {(1, "data lake"), (4, "Data LAKE")}
    total = every.groupBy("note_id").agg(F.count(F.lit(1)), F.sum(F.length("phrase")), F.min("phrase"), F.max("phrase"))
    got = spans.span_summary(notes.unionByName(notes.where("note_id = 9")), max_n=2)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, total.collect()))
    grams = spans.ngrams(plain_sentences(notes, "note_id"), 3).withColumn("t", F.array_join(F.transform("words", lambda w: w["lower"]), " "))
    want = grams.groupBy("note_id", "n").agg(F.count(F.lit(1)), F.sum(F.length("t")), F.min("t"), F.max("t"))
    assert sorted(map(tuple, spans.window_summary(notes, max_n=3, markdown=False).collect())) == sorted(map(tuple, want.collect()))
    assert "Generate" not in _plan(got) and "Join" not in _plan(only)


@pytest.mark.parametrize("sent", [True, False])
def test_few_titles_are_looked_up_note_by_note(spark, sent, monkeypatch):
    real = spans.is_small
    monkeypatch.setattr(spans, "is_small", lambda df, *most: sent and real(df, *most))
    titles = spark.createDataFrame([("Data Lake",), ("lake",), ("C++",), ("ake",), ("x",), ("été",), ("a b c d",), ("++",), (None,)], "title string")
    text = spark.createDataFrame([(1, "a data lake, c++ code"), (2, None), (3, "ÉTÉ été A b C d. ++ data-lake lakes"), (4, "")], "note_id int, text string")
    found = spans.title_mentions(text, titles, max_words=3)
    assert ("Join" in _plan(found)) != sent
    want = {(1, "Data Lake", 2), (1, "lake", 7), (1, "C++", 13), (1, "++", 14), (3, "été", 4), (3, "a b c d", 8), (3, "++", 17), (3, "lake", 25)}
    got = {(r.note_id, r.title, r.at) for r in found.collect()}
    assert got - {(1, "++", 14)} == want - {(1, "++", 14)}
    have = spark.createDataFrame([(1, "LAKE")], "note_id int, phrase string")
    assert {r.phrase for r in spans.new_mentions(found.where("note_id = 1 and title <> '++'"), have).collect()} == {"Data Lake", "C++"}


def brute_h(text_sents):
    from collections import defaultdict

    from linkloom.functions.words import STOPWORDS

    tf, up, caps, sents, left, right = (defaultdict(list) for _ in range(6))
    for si, toks in enumerate(text_sents):
        kept = [t for t in toks if t.lower() not in STOPWORDS]
        for i, t in enumerate(kept):
            k = t.lower()
            tf[k].append(1)
            if t[0].isupper():
                up[k].append(1)
            if len(t) > 1 and t.isupper():
                caps[k].append(1)
            sents[k].append(si)
            left[k] += [x.lower() for x in kept[max(0, i - 3) : i]]
            right[k] += [x.lower() for x in kept[i + 1 : i + 4]]
    n = [len(v) for v in tf.values()]
    mean = sum(n) / len(n)
    sd = math.sqrt(sum((x - mean) ** 2 for x in n) / len(n))
    out = {}
    for k, v in tf.items():
        f, s = len(v), sorted(sents[k])
        med = (s[(len(s) - 1) // 2] + s[len(s) // 2]) / 2
        rel = 1 + (len(set(left[k])) / max(1, len(left[k])) + len(set(right[k])) / max(1, len(right[k]))) * f / max(n)
        out[k] = rel * math.log2(3 + med) / (max(len(up[k]), len(caps[k])) / (1 + math.log2(1 + f)) + 0.5 * f / (mean + sd + 1) / rel + len(set(s)) / f / rel + 1e-10)
    return out


def test_yake_scores(spark):
    import re

    text = "Spark streams data. Data lakes hold Spark data and SQL data! Spark SQL is fast. The lake"
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string")
    got = {r.term: r.h for r in yake.term_scores(yake.term_stats(plain_sentences(docs))).collect()}
    want = brute_h([re.findall("[a-zA-Z0-9]+", s) for s in re.split(r"(?<=[.!?])\s", text)])
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], rel=1e-9)
    titles = spark.createDataFrame([("Spark SQL",)], "t string")
    place = [{r.phrase: r["rank"] for r in yake.phrases(plain_sentences(docs), titles=t, max_n=3).collect()} for t in (None, titles)]
    assert place[1]["Spark SQL"] < place[0]["Spark SQL"] and "and" not in place[0]
    top = yake.phrases(plain_sentences(docs), max_n=3, top_n=5).orderBy("rank").collect()
    assert top[0].score == 0 and len(top) == 5 and top[-1].score == 1
    # a phrase by hand: geometric mean of its terms over its frequency and their mean, over 1 + noun boost
    score = {r.phrase: r for r in yake.phrases(plain_sentences(docs), max_n=2).collect()}
    raws = {p: (want[a] * want[b]) ** 0.5 / (n * (1 + (want[a] + want[b]) / 2)) / 5 for p, a, b, n in (("Spark SQL", "spark", "sql", 1), ("Data lakes", "data", "lakes", 1), ("SQL data", "sql", "data", 1))}
    order = sorted(raws, key=raws.get)
    assert sorted(order, key=lambda p: score[p]["rank"]) == order


@pytest.mark.parametrize("boosted", [False, True])
@pytest.mark.parametrize("markdown", [False, True])
def test_note_phrases_equal_the_aggregates(spark, boosted, markdown, monkeypatch):
    rows = [(1, "# Big Data\n\nSpark streams **big data**. Data lakes hold Spark data and SQL data! BIG data lakes, big Data. Quickly organize it's don't"), (2, ""), (3, None), (4, "a. the of"), (5, "One. two. One two one. ONE TWO")]
    notes = spark.createDataFrame(rows, "note_id int, text string")
    titles = spark.createDataFrame([("data lakes",), ("One",)], "t string") if boosted else None
    df = spark.createDataFrame([("data", 3), ("big", 1), ("one", 1)], "term string, df long") if boosted else None
    get = lambda: sorted((r.note_id, r["rank"], r.phrase, round(r.score, 9), r.start, r.end, r.span_id) for r in yake.note_phrases(notes, titles=titles, frequencies=df, total=9, max_n=4, top_n=25, markdown=markdown).collect())
    got = get()
    assert {r[0] for r in got} == {1, 5} and len(got) > 20
    monkeypatch.setattr(yake, "is_small", lambda *a, **k: False)
    if not boosted:
        monkeypatch.setattr(yake, "note_phrases", lambda n, max_n, top_n, markdown, **k: yake.phrases(yake.note_sentences(n, "note_id", "text", markdown), None, None, max_n, top_n))
    assert get() == got


def _plan(df):
    return str(df._jdf.queryExecution().optimizedPlan())


@pytest.mark.parametrize("markdown", [False, True])
def test_note_terms_equal_the_aggregates_without_a_shuffle(spark, markdown):
    rows = [(1, "# Big Data\n\nSpark streams **big data**. Data lakes hold Spark data and SQL data! BIG data lakes, big Data. it's don't"), (2, ""), (3, None), (4, "a. the of"), (5, "One. two. One two one. ONE TWO")]
    notes = spark.createDataFrame(rows, "note_id int, text string").coalesce(1)
    got = yake.note_terms(notes, markdown=markdown)
    assert not any(x in _plan(got) for x in ("Aggregate", "Window", "Join", "Generate"))
    want = yake.term_scores(yake.term_stats(yake.note_sentences(notes, "note_id", "text", markdown)))
    want = want.select("note_id", "term", *yake.STATS, yake.median_of(F.col("sentences")).alias("median"), F.round("h", 12))
    seen = {tuple(r) for r in got.withColumn("h", F.round("h", 12)).collect()}
    assert seen == {tuple(r) for r in want.collect()} and {r[0] for r in seen} == {1, 5}


@pytest.mark.parametrize("sent", [True, False])
def test_frequencies_and_titles_of_any_number(spark, sent, monkeypatch):
    """Titles and terms beyond what used to be sent make no join of all phrases; what can't be sent gives the same rows."""
    notes = spark.createDataFrame([(1, "Big data and data lakes. Spark"), (2, "Spark data"), (3, "Spark x9 x9"), (4, None)], "note_id int, text string")
    df = yake.note_frequencies(notes, markdown=False)
    assert {tuple(r) for r in df.collect()} == {("big", 1), ("data", 2), ("lakes", 1), ("spark", 3), ("x9", 1)}
    titles = spark.createDataFrame([("Data Lakes",), ("data  lakes",), (None,), ("Spark",), ("big data and",)], "title string")
    real = yake.is_small
    monkeypatch.setattr(yake, "is_small", lambda df, rows=0, **k: real(df, rows=rows) if sent and rows > 1_000_000 else False)
    got = yake.note_tf_idf(notes, markdown=False)
    assert ("Join" in _plan(got)) != sent
    assert {(r.note_id, r.term): (r.tf, r.df, round(r.tfidf, 9)) for r in got.collect()}[3, "x9"] == (2, 1, round(2 * math.log(4 / 2), 9))
    some = yake.note_phrases(notes, titles=titles, frequencies=df.where("df > 1"), absent=1, total=4, max_n=3, markdown=False)
    all_ = yake.note_phrases(notes, titles=titles, frequencies=df, total=4, max_n=3, markdown=False)
    assert ("Join" in _plan(some)) != sent
    rows = lambda d: sorted((r.note_id, r["rank"], r.phrase, round(r.score, 9)) for r in d.collect())
    assert rows(some) == rows(all_)
    assert len(rows(some)) > 8


def test_the_array_path_over_many_notes_equals_one_by_one(spark):
    """Notes that share a slice don't mix, whatever the number of their phrases."""
    texts = [" ".join(f"Word{(i * j) % 7} the lake{j % 5}." if j % 3 else "big Data" for j in range(i)) for i in range(40)]
    pos: dict = {}
    run = lambda ts: yake._top_phrases(w := yake.Words(ts, True), yake.Terms(w), None, None, 0, 0, 4, 9, pos)
    note, begin, n, score, rank = run(texts)
    for k in range(40):
        alone = run([texts[k]])
        at = note == k
        assert rank[at].tolist() == alone[4].tolist() and n[at].tolist() == alone[2].tolist() and score[at].tolist() == pytest.approx(alone[3].tolist())


def test_pos_of_a_word(spark):
    words = ["the", "quickly", "running", "organize", "size", "nation", "beautiful", "Paris", "thing", "fly", "ABC", "ring", "able", "x1'S"]
    rows = spark.createDataFrame([(w,) for w in words], "word string")
    assert {r.word: r.pos for r in yake.pos_tags(rows).collect()} == {w: T.pos_of(w) for w in words}


def test_durations(spark):
    rows = spark.createDataFrame([(0.0,), (59.9,), (60.0,), (3605.0,), (90061.0,), (-1.0,), (float("inf"),), (float("nan"),), (None,)], "s double")
    assert [r[0] for r in rows.select(T.duration(F.col("s"))).collect()] == ["0s", "59s", "1m 0s", "1h 0m 5s", "25h 1m 1s", "?", "?", "?", "?"]


def test_corpus_filters(spark):
    clean = lambda x: one(spark, x, corpus.clean_title)
    assert clean("Data_Lake") == "Data Lake" and clean("File:x.png") is None and clean("123") is None and clean("List of things") is None and clean("ab") is None and clean("Ω ω Ωω") is None
    assert one(spark, "Foo (bar)", corpus.short_phrase) is None and one(spark, "Foo-x (bar)", lambda c: corpus.short_phrase(c, bare=True)) == "foo x"
    assert one(spark, "history of x", corpus.wiki_phrase) is None
    assert one(spark, 'Label: "big data"\nmore', corpus.clean_label) == "big data"
    lines = spark.createDataFrame([("Foo", 1), ("foo", 0), (" FOO ", 2), ("", 3)], "line string, o int")
    assert [r.line for r in corpus.dedup_lines(lines, "o").collect()] == ["foo"]
    assert sorted(r.line for r in corpus.dedup_prefer_cased(lines.where("line <> ''"), "o").collect()) == [" FOO ", "Foo"]


def test_catalog_queries_have_equal_columns():
    from linkloom import catalog

    assert set(catalog.oracle_sql()) <= set(catalog.queries())
