"""Registered queries on edges, vectors, evaluation and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import embed, evaluate, markdown, merge, resolve, sae, spans, store
from ..streaming import queue
from .common import DECORATED, MARKS, NORM, SENTENCES, STOP, TITLES, WORD, decorated, documents, scratch, table, titles_of_documents
from .discover import discover_links, document_phrases


def lcs_resolve(spark, sf_dir):
    """The flagship: which documents should each document link to, by its phrases and their titles."""
    titles = titles_of_documents(spark, sf_dir)
    phrases = document_phrases(documents(spark, sf_dir), longest=resolve.longest_phrase(titles))
    edges = resolve.resolve_lcs(phrases, titles)
    got = merge.dedup_and_rank(edges.withColumnRenamed("title", "target"))
    return got.select("note_id", "phrase", "target", F.round("similarity", 6).alias("similarity"), "rank")


def lcs_contained(spark, sf_dir):
    """Part names, and longer and shorter forms of them, against all part names."""
    part = table(spark, sf_dir, "part").select("p_name").distinct()
    forms = F.explode(F.array(F.col("p_name"), F.concat("p_name", F.lit("'s")), F.concat(F.upper("p_name"), F.lit(" co")), F.concat(F.lit("a "), F.col("p_name")))).alias("phrase")
    titles = part.select(F.col("p_name").alias("title"), F.col("p_name").alias("ord"))
    got = resolve.lcs_pairs(part.select(forms), titles, per_phrase=1)
    return got.select("phrase", "title", F.round("similarity", 6).alias("similarity"))


def strong_match_skip(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("note_id"), F.col("p_name").alias("phrase"))
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("note_id"), (1 - F.col("l_discount").cast("double")).alias("similarity"))
    return resolve.skip_strong(names, edges.join(names, "note_id"), strong=0.995)


def link_discovery(spark, sf_dir):
    """All three resolvers at their defaults; the sparse one with untrained weights, each feature its own label."""
    docs = documents(spark, sf_dir).select(F.col("doc_id").alias("note_id"), "text")
    weights = sae.random_weights(32, 128, 4)
    labels = spark.range(128).select(F.col("id").cast("int").alias("idx"), F.concat(F.lit("f"), "id").alias("label"))
    got = discover_links(docs, titles_of_documents(spark, sf_dir), embedder=embed.hash_embedder(32), weights=weights, labels=labels)
    return got.select("note_id", "phrase", "target", F.round("similarity", 6).alias("similarity"), F.array_join("matched_by", "+").alias("matched_by"), "match_type", "rank")


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


def dense_topk(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    got = resolve.dense_pairs(v, v, threshold=0.35, k=3, same=True)
    return got.select("l_id", "r_id", F.round("similarity", 6).alias("similarity"))


def dense_nearest(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    got = resolve.dense_pairs(v, v, threshold=-1.0, k=1, same=True)
    return got.select("l_id", F.round("similarity", 6).alias("similarity"))


def _atoms(spark, sf_dir):
    """The model: 128 atoms, the vectors with the smallest ids; the pre-bias is the mean of all vectors."""
    v = _vectors(spark, sf_dir)
    mean = v.select(F.posexplode("v").alias("dim", "x")).groupBy("dim").agg(F.avg(F.col("x").cast("double")).alias("m"))
    pre = mean.agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"]).alias("pre"))
    first = v.orderBy("id").limit(128)
    return first.select(F.col("id").cast("int").alias("idx"), F.transform("v", lambda x: x.cast("double")).alias("enc"), F.lit(0.0).alias("bias")).crossJoin(pre)


def _features(spark, sf_dir):
    return sae.encode(_vectors(spark, sf_dir), _atoms(spark, sf_dir), 4)


def sae_encode(spark, sf_dir):
    return _features(spark, sf_dir).select("id", "idx", F.round("value", 6).alias("value"), "rank")


def sparse_cosine(spark, sf_dir):
    f = _features(spark, sf_dir).select("id", "idx", "value")
    got = resolve.sparse_pairs(f, f, threshold=0.75, k=3, same=True)
    return got.select("l_id", "r_id", F.round("similarity", 6).alias("similarity"))


def dense_explanation(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    pairs = resolve.dense_pairs(v, v, threshold=0.35, k=1, same=True)
    f = _features(spark, sf_dir).select("id", "idx", "value")
    labels = _atoms(spark, sf_dir).select("idx", F.concat(F.lit("atom "), F.col("idx").cast("string")).alias("label"))
    got = resolve.explanation(pairs, f, f, labels)
    return got.select("l_id", "r_id", "rank", "idx", F.round("product", 6).alias("product"), "label")


def fire_counts(spark, sf_dir):
    return sae.fire_counts(_features(spark, sf_dir), 128)


def _edges(spark, sf_dir):
    """Single-resolver edges made of order lines: note = supplier, phrase = part (in two casings), target = line number."""
    kind = F.element_at(F.array(F.lit("lcs"), F.lit("dense"), F.lit("sparse")), (F.col("l_quantity").cast("int") % 3 + 1).cast("int"))
    phrase = F.concat(F.when(F.col("l_quantity") > 25, "Part ").otherwise("part  "), (F.col("l_partkey") % 40).cast("string"))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("long").alias("note_id"), phrase.alias("phrase"), F.lit(0.25).alias("score"), F.concat(F.lit("T"), F.col("l_linenumber").cast("string")).alias("target"),
        F.lit(None).cast("string").alias("target_id"), (F.lit(0.7) + F.floor(F.col("l_extendedprice").cast("double") % 30) / 100).alias("similarity"), kind.alias("resolver"),
        F.when(F.col("l_tax") > 0.04, F.array(F.col("l_linenumber").cast("int"))).alias("features"), (F.col("l_orderkey").cast("long") * 1_000_000_000 + F.col("l_linenumber") * 100_000_000 + F.col("l_partkey") * 100 + F.col("l_quantity").cast("int")).alias("ord"),
    )


def merge_edges(spark, sf_dir):
    got = merge.merge_by_target(_edges(spark, sf_dir))
    return got.select("note_id", "phrase_key", "target", "phrase", "similarity", F.array_join("matched_by", ",").alias("matched_by"), "lcs_similarity", "dense_similarity", "sparse_similarity", "match_type", F.size(F.coalesce("features", F.array().cast("array<int>"))).alias("n_features"))


def dedup_rank(spark, sf_dir):
    return merge.dedup_and_rank(_edges(spark, sf_dir)).select("note_id", "phrase_key", "target", "phrase", "similarity", "rank")


def label_counts(spark, sf_dir):
    return merge.tab_counts(merge.merge_by_target(_edges(spark, sf_dir)))


def card_view(spark, sf_dir):
    return merge.cards(merge.merge_by_target(_edges(spark, sf_dir)))


def _stored(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.when(F.col("o_orderkey") % 50 != 0, F.col("o_custkey").cast("string")).alias("source_id"), F.concat(F.lit("Order  "), (F.col("o_orderkey") % 7).cast("string")).alias("phrase"),
        (F.col("o_orderkey") % 20).cast("string").alias("target_id"), (F.lit(0.5) + F.floor(F.col("o_totalprice").cast("double") % 100) / 200).alias("similarity"), F.col("o_orderkey").cast("long").alias("edge"),
    )


def _denials(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("source_id"), F.concat(F.lit("order "), (F.col("c_custkey") % 7).cast("string")).alias("phrase_key"), (F.col("c_custkey") % 20).cast("string").alias("target_id"))


def suppress_edges(spark, sf_dir):
    return store.suppress(_stored(spark, sf_dir), _denials(spark, sf_dir)).select("edge", "source_id")


def edge_store_read(spark, sf_dir):
    return store.read_edges(_stored(spark, sf_dir).where("source_id is not null")).select("source_id", "phrase", "target_id", "similarity", F.col("rank").alias("place"))


def drop_note(spark, sf_dir):
    gone = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("string").alias("id"))
    return store.drop_notes(_stored(spark, sf_dir).where("source_id is not null"), gone).select("edge")


def deny_edges(spark, sf_dir):
    left, keys = store.give_feedback(_stored(spark, sf_dir), _denials(spark, sf_dir), _stored(spark, sf_dir).where("source_id is not null").select("source_id", F.lower(F.regexp_replace("phrase", " +", " ")).alias("phrase_key"), "target_id").where("target_id <> '7'"))
    kept = left.select("source_id", F.lit("edge").alias("what"), F.col("edge").cast("string").alias("name"))
    return kept.unionByName(keys.select("source_id", F.lit("key").alias("what"), F.concat_ws("/", "phrase_key", "target_id").alias("name")))


def _snapshots(spark, sf_dir):
    """Notes known before and files found now: some gone, renamed, touched or new."""
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id")
    notes = d.where(k % 10 != 9).select(F.concat(F.lit("id"), k.cast("string")).alias("id"), F.concat(F.lit("n/"), k.cast("string"), F.lit(".md")).alias("path"), (k * 10).alias("mtime"), F.col("n_chars").alias("size"), k.alias("ord"))
    path = F.when(k % 10 == 3, F.concat(F.lit("moved/"), k.cast("string"), F.lit(".md"))).otherwise(F.concat(F.lit("n/"), k.cast("string"), F.lit(".md")))
    files = d.where(k % 10 != 5).select(path.alias("path"), (k * 10 + F.when(k % 10 == 4, 1).otherwise(0)).alias("mtime"), F.col("n_chars").alias("size"))
    return notes, files


def reconcile(spark, sf_dir):
    return store.reconcile(*_snapshots(spark, sf_dir)).select("id", "path", "mtime", "size", "action")


def changed_notes(spark, sf_dir):
    return store.changed_notes(*_snapshots(spark, sf_dir)).select("path", "mtime")


def repair_ids(spark, sf_dir):
    notes, _ = _snapshots(spark, sf_dir)
    o = table(spark, sf_dir, "orders")
    edges = o.select(F.col("o_orderkey").cast("long").alias("edge"), F.concat(F.lit("n/"), (F.col("o_custkey") % 1000).cast("string"), F.lit(".md")).alias("source_path"), (F.col("o_orderkey") % 1000).cast("string").alias("target"), F.when(F.col("o_orderkey") % 2 == 0, "known").alias("source_id"), F.lit(None).cast("string").alias("target_id"))
    return store.repair_ids(edges, notes).select("edge", "source_id", "target_id", "repaired")


def eval_prf(spark, sf_dir):
    """Two systems: phrases found in decorated notes that are part names (any), and those that are not aliased."""
    notes = decorated(spark, sf_dir)
    titles = table(spark, sf_dir, "part").select(F.col("p_name").alias("title")).distinct()
    from ..operators import links

    truth = notes.select("note_id", F.explode(links.link_targets(F.col("content"))).alias("target"))
    found = spans.title_mentions(notes.select("note_id", F.col("content").alias("text")), titles)
    plain = spans.title_mentions(notes.select("note_id", links.remove_aliased(F.col("content")).alias("text")), titles)
    rows = [d.select(F.lit(n).alias("system"), "note_id", F.lower("title").alias("target")) for n, d in (("all", found), ("unaliased", plain))]
    got = evaluate.micro(evaluate.confusion(rows[0].unionByName(rows[1]), truth, titles.select(F.lower("title").alias("title"))))
    return got.select("system", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def recall_at_k(spark, sf_dir):
    """Nearest sparse neighbours against nearest dense ones."""
    from pyspark.sql import Window

    v = _vectors(spark, sf_dir)
    rank = F.row_number().over(Window.partitionBy("l_id").orderBy(F.round("similarity", 9).desc(), "r_id"))
    dense = resolve.dense_pairs(v, v, threshold=-1.0, k=5, same=True)
    f = _features(spark, sf_dir).select("id", "idx", "value")
    sparse = resolve.sparse_pairs(f, f, threshold=0.01, k=5, same=True)
    o, c = (d.select(F.col("l_id").alias("probe"), F.col("r_id").alias("id"), rank.alias("rank")) for d in (dense, sparse))
    return evaluate.recall_summary(evaluate.recall_at_k(c, o, 5)).select(*[F.round(x, 3).alias(x) for x in ("mean", "median", "p25", "p75")])


def latency_percentiles(spark, sf_dir):
    return evaluate.latency_summary(table(spark, sf_dir, "events").select("event_type", F.col("value").alias("ms")), "event_type")


def bench_summary(spark, sf_dir):
    times = table(spark, sf_dir, "events").select(F.col("user_id").alias("note_id"), F.col("event_type").alias("phase"), F.col("value").alias("ms"))
    return evaluate.phase_totals(times)


def debounce_sessions(spark, sf_dir):
    jobs = table(spark, sf_dir, "events").select(F.col("user_id").alias("path"), "ts", "event_id")
    got = queue.debounce(jobs, "6 hours", order="event_id")
    return got.select(F.col("path").alias("user_id"), F.col("latest").cast("timestamp_ntz").alias("latest"), F.col("n").cast("long").alias("n"), F.col("event_id").alias("last_event"))


def stream_debounce(spark, sf_dir):
    """The same bursts through a stream that reads what is there, ends with a closing event and stops."""
    root = f"{scratch(spark)}/bursts"
    events = table(spark, sf_dir, "events").select("user_id", "ts")
    last = events.agg(F.max("ts").alias("ts")).select(F.lit(-1).cast(events.schema["user_id"].dataType).alias("user_id"), (F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("ts"))
    last.write.parquet(f"{root}/closing")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    closing = spark.readStream.schema(events.schema).parquet(f"{root}/closing")
    jobs = stream.unionByName(closing).select(F.col("user_id").alias("path"), "ts")
    got = queue.debounce(jobs, "6 hours", watermark="1 minute")
    query = got.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/progress").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    done = spark.read.schema(got.schema).parquet(f"{root}/out").where("path <> -1")  # a filter before would pass over the closing event
    return done.select(F.col("path").alias("user_id"), F.col("latest").cast("timestamp_ntz").alias("latest"), F.col("n").cast("long").alias("n"))


def cooldown_keep(spark, sf_dir):
    jobs = table(spark, sf_dir, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    got = queue.cooldown(jobs, "user_id", "t", 6 * 3600 * 1_000_000)
    return got.groupBy("user_id").agg(F.count(F.lit(1)).alias("kept"), F.max("t").alias("last"))


def hash_embedding(spark, sf_dir):
    names = table(spark, sf_dir, "part").select("p_name").distinct()
    v = embed.hash_embedding(F.col("p_name"))
    return names.select("p_name", *[F.round(F.get(v, F.lit(d)), 6).alias(f"v{d}") for d in range(8)])


def structural_headings(spark, sf_dir):
    s = markdown.note_sentences(decorated(spark, sf_dir))
    t = s.select("note_id", F.explode("tokens").alias("t")).where("t.boost > 0")
    return t.groupBy("note_id").agg(F.count(F.lit(1)).alias("n"), F.max("t.boost").alias("boost"))


QUERIES = [
    lcs_resolve, lcs_contained, strong_match_skip, link_discovery, dense_topk, dense_nearest, sae_encode, sparse_cosine, dense_explanation, fire_counts, merge_edges, dedup_rank, label_counts,
    card_view, suppress_edges, edge_store_read, drop_note, deny_edges, reconcile, changed_notes, repair_ids, eval_prf, recall_at_k, latency_percentiles, bench_summary, debounce_sessions, stream_debounce,
    cooldown_keep, hash_embedding, structural_headings,
]

_V = "e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings)"
_DENSE = f"{_V}, p AS (SELECT a.id AS l_id, b.id AS r_id, list_cosine_similarity(a.v, b.v) AS s FROM e a JOIN e b ON a.id <> b.id)"
_SAE = f"""{_V}, dm AS (SELECT unnest(v) AS x, unnest(range(len(v))) AS dim FROM e), mean AS (SELECT dim, avg(x) AS m FROM dm GROUP BY dim),
    pre AS (SELECT list(m ORDER BY dim) AS pre FROM mean), atoms AS (SELECT id AS idx, v AS enc FROM e ORDER BY id LIMIT 128),
    acts AS (SELECT e.id, idx::INTEGER AS idx, greatest(0.0, list_dot_product(e.v, enc) - list_dot_product(pre, enc)) AS value FROM e, atoms, pre),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(value, 9) DESC, idx) AS r FROM acts), feats AS (SELECT id, idx, value, r FROM ranked WHERE r <= 4)"""
_SPARSE = f"""{_SAE}, nrm AS (SELECT id, sqrt(sum(value * value)) AS n FROM feats GROUP BY id),
    sd AS (SELECT a.id AS l_id, b.id AS r_id, sum(a.value * b.value) AS d FROM feats a JOIN feats b ON a.idx = b.idx AND a.id <> b.id WHERE a.value <> 0 AND b.value <> 0 GROUP BY ALL),
    ss AS (SELECT l_id, r_id, d / (x.n * y.n) AS s FROM sd JOIN nrm x ON x.id = l_id JOIN nrm y ON y.id = r_id)"""
_E = """ed AS (SELECT l_suppkey::BIGINT AS note_id, CASE WHEN l_quantity > 25 THEN 'Part ' ELSE 'part  ' END || (l_partkey % 40) AS phrase, 0.25::DOUBLE AS score, 'T' || l_linenumber AS target,
        0.7::DOUBLE + floor(l_extendedprice::DOUBLE % 30) / 100 AS similarity, ['lcs', 'dense', 'sparse'][l_quantity::INTEGER % 3 + 1] AS resolver,
        CASE WHEN l_tax > 0.04 THEN 1 ELSE -1 END AS fs, l_orderkey::BIGINT * 1000000000 + l_linenumber * 100000000 + l_partkey * 100 + l_quantity::INTEGER AS ord FROM lineitem),
    ek AS (SELECT *, trim(regexp_replace(lower(phrase), '\\s+', ' ', 'g')) AS phrase_key FROM ed)"""
_M = _E + """, first AS (SELECT note_id, phrase_key, target, resolver, arg_min(similarity, ord) AS s, min(ord) AS o FROM ek GROUP BY ALL),
    m AS (SELECT note_id, phrase_key, target, max(s) AS similarity, string_agg(resolver, ',' ORDER BY o) AS matched_by, count(*) AS k,
            max(s) FILTER (resolver = 'lcs') AS lcs_similarity, max(s) FILTER (resolver = 'dense') AS dense_similarity, max(s) FILTER (resolver = 'sparse') AS sparse_similarity FROM first GROUP BY ALL),
    b AS (SELECT note_id, phrase_key, target, arg_min(phrase, ord) AS phrase, greatest(max(fs), 0)::INTEGER AS n_features FROM ek GROUP BY ALL),
    mg AS (SELECT m.*, b.phrase, b.n_features, CASE WHEN k = 1 THEN CASE matched_by WHEN 'lcs' THEN 'deterministic' WHEN 'dense' THEN 'stochastic' ELSE 'sparse-feature' END
            WHEN k = 2 AND sparse_similarity IS NULL THEN 'both' ELSE 'mixed' END AS match_type FROM m JOIN b USING (note_id, phrase_key, target))"""
_ST = """so AS (SELECT CASE WHEN o_orderkey % 50 <> 0 THEN o_custkey::VARCHAR END AS source_id, 'Order  ' || (o_orderkey % 7) AS phrase, 'order ' || (o_orderkey % 7) AS phrase_key, (o_orderkey % 20)::VARCHAR AS target_id,
        0.5::DOUBLE + floor(o_totalprice::DOUBLE % 100) / 200 AS similarity, o_orderkey::BIGINT AS edge FROM orders),
    dn AS (SELECT c_custkey::VARCHAR AS source_id, 'order ' || (c_custkey % 7) AS phrase_key, (c_custkey % 20)::VARCHAR AS target_id FROM customer)"""
_SN = """n AS (SELECT 'id' || doc_id AS id, 'n/' || doc_id || '.md' AS path, doc_id * 10 AS mtime, n_chars AS size, doc_id AS ord FROM documents WHERE doc_id % 10 <> 9),
    f AS (SELECT CASE WHEN doc_id % 10 = 3 THEN 'moved/' ELSE 'n/' END || doc_id || '.md' AS path, doc_id * 10 + CASE WHEN doc_id % 10 = 4 THEN 1 ELSE 0 END AS mtime, n_chars AS size FROM documents WHERE doc_id % 10 <> 5)"""

#: The subsequence of a pair is counted in the bits of a number, a character of the phrase at a time. Only pairs that
#: the edit distance leaves a chance are measured: what two texts share is at most half of their lengths less it.
_LCS = rf"""md AS (SELECT doc_id, regexp_replace(text, '{MARKS}', '\1\2\3', 'g') AS text FROM documents), ms AS (SELECT doc_id, {SENTENCES} AS ss FROM md),
    me AS (SELECT doc_id, unnest(ss) AS sentence, unnest(range(len(ss))) AS sent_idx FROM ms), mw AS (SELECT doc_id, sent_idx, regexp_extract_all(sentence, {WORD}) AS w FROM me),
    {TITLES}, nt AS (SELECT title, ord, {NORM.format("title")} AS nt FROM titles),
    gn AS (SELECT doc_id, sent_idx, w, unnest(range(1, 11)) AS n FROM mw), gi AS (SELECT doc_id, sent_idx, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM gn),
    gr AS (SELECT doc_id, array_to_string(w[i:i + n - 1], ' ') AS phrase, sent_idx * 10000000 + n * 500000 + i AS place FROM gi WHERE lower(w[i + n - 1]) NOT IN {STOP} AND (n > 1 OR length(w[i]) > 1)),
    sp AS (SELECT doc_id, lower(phrase) AS key, arg_min(phrase, place) AS phrase FROM gr GROUP BY ALL), np AS (SELECT *, {NORM.format("phrase")} AS np FROM sp),
    dp AS (SELECT DISTINCT np FROM np WHERE length(np) * 0.85 <= 1.1 * (SELECT max(length(nt)) FROM nt)),
    pw AS (SELECT np, unnest(string_split(np, ' ')) AS word, unnest(range(len(string_split(np, ' ')))) AS pos FROM dp), tw AS (SELECT DISTINCT title, ord, nt, unnest(string_split(nt, ' ')) AS word FROM nt),
    pr AS (SELECT np, nt, title, ord, min(pos) AS pos FROM pw JOIN tw USING (word) WHERE least(length(np), length(nt)) * 1.1 >= 0.85 * greatest(length(np), length(nt)) - 1e-9 GROUP BY ALL),
    pc AS (SELECT *, contains(np, nt) AS inside, contains(nt, np) AS within FROM pr WHERE contains(np, nt) OR length(np) + length(nt) - levenshtein(np, nt) >= 1.7 * greatest(length(np), length(nt)) - 1e-9),
    op AS (SELECT DISTINCT np, nt FROM pc WHERE NOT inside AND NOT within), tc AS (SELECT DISTINCT nt FROM op),
    bt AS (SELECT nt, unnest(string_split(nt, '')) AS c, unnest(range(length(nt))) AS j FROM tc), bc AS (SELECT nt, c, sum(1::HUGEINT << j)::HUGEINT AS bits FROM bt GROUP BY ALL),
    lc AS (SELECT np, nt, 0 AS i, (1::HUGEINT << length(nt)) - 1 AS row FROM op
        UNION ALL SELECT l.np, l.nt, i + 1, ((row + (row & coalesce(bits, 0))) | (row - (row & coalesce(bits, 0)))) & ((1::HUGEINT << length(l.nt)) - 1)
        FROM lc l LEFT JOIN bc ON bc.nt = l.nt AND bc.c = l.np[i + 1] WHERE i < length(l.np)),
    ls AS (SELECT np, nt, length(nt) - bit_count(row) AS n FROM lc WHERE i = length(np)),
    sm AS (SELECT pc.*, least(1.0::DOUBLE, CASE WHEN pc.np = pc.nt THEN 1.0::DOUBLE WHEN inside THEN length(pc.nt) / length(pc.np) * 1.1::DOUBLE WHEN within THEN length(pc.np) / length(pc.nt) ELSE n / greatest(length(pc.np), length(pc.nt)) END) AS s
        FROM pc LEFT JOIN ls ON ls.np = pc.np AND ls.nt = pc.nt),
    ed AS (SELECT doc_id AS note_id, key, phrase, title, ord, s FROM np JOIN sm USING (np) WHERE s >= 0.85 AND nt <> doc_id::VARCHAR QUALIFY row_number() OVER (PARTITION BY doc_id, phrase ORDER BY s DESC, pos, ord, title) <= 3)"""

ORACLES = {
    "lcs_resolve": f"WITH RECURSIVE {_LCS} SELECT note_id, phrase, title AS target, round(s, 6) AS similarity, row_number() OVER (PARTITION BY note_id ORDER BY s DESC, ord, title, key)::INTEGER AS rank FROM ed",
    "recall_at_k": f"""WITH {_SPARSE}, dn AS (SELECT a.id AS l_id, b.id AS r_id FROM e a JOIN e b ON a.id <> b.id QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY round(list_cosine_similarity(a.v, b.v), 9) DESC, b.id) <= 5),
        sn AS (SELECT l_id, r_id FROM ss WHERE s >= 0.01 QUALIFY row_number() OVER (PARTITION BY l_id ORDER BY round(s, 9) DESC, r_id) <= 5),
        rc AS (SELECT dn.l_id, count(sn.r_id) / 5 AS recall FROM dn LEFT JOIN sn USING (l_id, r_id) GROUP BY 1)
        SELECT round(avg(recall), 3) AS mean, round(quantile_cont(recall, 0.5), 3) AS median, round(quantile_cont(recall, 0.25), 3) AS p25, round(quantile_cont(recall, 0.75), 3) AS p75 FROM rc""",
    "stream_debounce": """WITH o AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
        s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM o) SELECT user_id, max(ts) AS latest, count(*) AS n FROM s GROUP BY user_id, sid""",
    # letters in bold spans (chr 2), other headings (4) and the first top heading (3) are marked, then marks and tokens follow
    "structural_headings": rf"""WITH {DECORATED}, ln AS (SELECT note_id, unnest(string_split(content, chr(10))) AS line, unnest(range(len(string_split(content, chr(10))))) AS k FROM notes),
        lv AS (SELECT *, CASE WHEN regexp_matches(line, '^#{{1,6}}\s') THEN length(regexp_extract(line, '^(#+)', 1)) END AS level FROM ln),
        mk AS (SELECT note_id, k, CASE WHEN level IS NULL THEN array_to_string(list_transform(regexp_extract_all(line, '\*\*.+?\*\*|.'), lambda x: CASE WHEN length(x) > 1 THEN regexp_replace(x, '([a-zA-Z0-9])', chr(2) || '\1', 'g') ELSE x END), '')
            ELSE regexp_replace(line, '([a-zA-Z0-9])', CASE WHEN level = 1 AND k = min(k) FILTER (level = 1) OVER (PARTITION BY note_id) THEN chr(3) ELSE chr(4) END || '\1', 'g') END AS line FROM lv),
        nt AS (SELECT note_id, regexp_replace(string_agg(line, chr(10) ORDER BY k), '{MARKS}', '\1\2\3', 'g') AS t FROM mk GROUP BY 1),
        tk AS (SELECT note_id, unnest(regexp_extract_all(t, '(?:[\x02-\x04]?[a-zA-Z0-9])+(?:[''’](?:[\x02-\x04]?[a-zA-Z])+)*')) AS t FROM nt)
        SELECT note_id, count(*) AS n, max(CASE WHEN contains(t, chr(3)) THEN 3 WHEN contains(t, chr(4)) THEN 2 ELSE 1 END)::INTEGER AS boost FROM tk WHERE regexp_matches(t, '[\x02-\x04]') GROUP BY 1""",
    "lcs_contained": r"""WITH t AS (SELECT DISTINCT p_name AS title FROM part), p AS (SELECT DISTINCT unnest([title, title || '''s', upper(title) || ' co', 'a ' || title]) AS phrase FROM t),
        n AS (SELECT phrase, trim(regexp_replace(lower(phrase), '''s\b', '', 'g')) AS np FROM p),
        c AS (SELECT phrase, title, list_min(list_filter(range(1, len(string_split(np, ' ')) + 1), lambda i: list_contains(string_split(title, ' '), string_split(np, ' ')[i]))) AS pos,
            CASE WHEN np = title THEN 1.0::DOUBLE WHEN contains(np, title) THEN least(1.0::DOUBLE, length(title) / length(np) * 1.1::DOUBLE) ELSE length(np) / length(title) END AS s FROM n, t WHERE contains(np, title) OR contains(title, np))
        SELECT phrase, title, round(s, 6) AS similarity FROM c WHERE s >= 0.85 AND pos IS NOT NULL QUALIFY row_number() OVER (PARTITION BY phrase ORDER BY s DESC, pos, title) = 1""",
    "strong_match_skip": "SELECT p_partkey AS note_id, p_name AS phrase FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE 1 - l_discount::DOUBLE >= 0.995)",
    "dense_topk": f"WITH {_DENSE}, r AS (SELECT *, row_number() OVER (PARTITION BY l_id ORDER BY round(s, 12) DESC, r_id) AS r FROM p WHERE s >= 0.35) SELECT l_id, r_id, round(s, 6) AS similarity FROM r WHERE r <= 3",
    "dense_nearest": f"WITH {_DENSE} SELECT l_id, round(max(s), 6) AS similarity FROM p GROUP BY 1",
    "sae_encode": f"WITH {_SAE} SELECT id, idx, round(value, 6) AS value, r::INTEGER AS rank FROM feats",
    "sparse_cosine": f"WITH {_SPARSE}, r AS (SELECT *, row_number() OVER (PARTITION BY l_id ORDER BY round(s, 12) DESC, r_id) AS r FROM ss WHERE s >= 0.75) SELECT l_id, r_id, round(s, 6) AS similarity FROM r WHERE r <= 3",
    "dense_explanation": f"""WITH {_SAE}, p AS (SELECT a.id AS l_id, b.id AS r_id, list_cosine_similarity(a.v, b.v) AS s FROM e a JOIN e b ON a.id <> b.id),
        t AS (SELECT l_id, r_id FROM p WHERE s >= 0.35 QUALIFY row_number() OVER (PARTITION BY l_id ORDER BY round(s, 12) DESC, r_id) = 1),
        x AS (SELECT l_id, r_id, a.idx, a.value * b.value AS d, row_number() OVER (PARTITION BY l_id ORDER BY a.value * b.value DESC, a.idx)::INTEGER AS rank FROM t JOIN feats a ON a.id = l_id JOIN feats b ON b.id = r_id AND b.idx = a.idx)
        SELECT l_id, r_id, rank, idx, round(d, 6) AS product, 'atom ' || idx AS label FROM x WHERE rank <= 2""",
    "fire_counts": f"WITH {_SAE}, c AS (SELECT idx, count(*) AS n FROM feats WHERE value > 0 GROUP BY 1), i AS (SELECT unnest(range(128))::INTEGER AS idx) SELECT idx, coalesce(n, 0) AS fires, n IS NULL AS dead FROM i LEFT JOIN c USING (idx)",
    "merge_edges": f"WITH {_M} SELECT note_id, phrase_key, target, phrase, similarity, matched_by, lcs_similarity, dense_similarity, sparse_similarity, match_type, n_features FROM mg",
    "dedup_rank": f"""WITH {_E}, r AS (SELECT *, row_number() OVER (PARTITION BY note_id, phrase_key, target ORDER BY similarity DESC, ord) AS r FROM ek)
        SELECT note_id, phrase_key, target, phrase, similarity, row_number() OVER (PARTITION BY note_id ORDER BY similarity * (1 - score) DESC, ord, target, phrase_key)::INTEGER AS rank FROM r WHERE r = 1""",
    "label_counts": f"WITH {_M}, u AS (SELECT unnest(string_split(matched_by, ',')) AS resolver FROM mg) SELECT resolver, count(*) AS n FROM u GROUP BY 1",
    "card_view": f"""WITH {_M} SELECT note_id, phrase, target, concat_ws('+', CASE WHEN lcs_similarity IS NOT NULL THEN 'lcs' END, CASE WHEN dense_similarity IS NOT NULL THEN 'dense' END, CASE WHEN sparse_similarity IS NOT NULL THEN 'sparse' END) AS badge,
        floor(similarity * 100 + 0.5)::BIGINT || '%' AS percent,
        concat_ws(' ', 'lcs ' || printf('%.2f', lcs_similarity), 'dense ' || printf('%.2f', dense_similarity), 'sparse ' || printf('%.2f', sparse_similarity)) AS detail,
        row_number() OVER (PARTITION BY note_id ORDER BY similarity DESC, phrase, target)::INTEGER AS place FROM mg""",
    "suppress_edges": f"WITH {_ST} SELECT edge, source_id FROM so WHERE NOT EXISTS (SELECT 1 FROM dn WHERE dn.source_id = so.source_id AND dn.phrase_key = so.phrase_key AND dn.target_id = so.target_id)",
    "edge_store_read": f"WITH {_ST} SELECT source_id, phrase, target_id, similarity, row_number() OVER (PARTITION BY source_id ORDER BY similarity DESC, phrase, target_id)::INTEGER AS place FROM so WHERE source_id IS NOT NULL AND similarity >= 0.7",
    "drop_note": f"WITH {_ST}, g AS (SELECT r_regionkey::VARCHAR AS id FROM region) SELECT edge FROM so WHERE source_id IS NOT NULL AND source_id NOT IN (SELECT id FROM g) AND target_id NOT IN (SELECT id FROM g)",
    "deny_edges": f"""WITH {_ST}, k AS (SELECT source_id, phrase_key, target_id FROM dn UNION SELECT source_id, phrase_key, target_id FROM so WHERE source_id IS NOT NULL AND target_id <> '7')
        SELECT source_id, 'key' AS what, phrase_key || '/' || target_id AS name FROM k UNION ALL SELECT source_id, 'edge', edge::VARCHAR FROM so WHERE source_id IS NULL OR target_id = '7'""",
    "reconcile": f"""WITH {_SN}, o AS (SELECT * FROM n WHERE path NOT IN (SELECT path FROM f)), w AS (SELECT * FROM f WHERE path NOT IN (SELECT path FROM n)),
        lone AS (SELECT size, min(path) AS path, min(mtime) AS mtime FROM w GROUP BY 1 HAVING count(*) = 1),
        c AS (SELECT size, arg_min(id, ord) AS id FROM o GROUP BY 1), claim AS (SELECT lone.*, c.id FROM lone JOIN c USING (size))
        SELECT n.id, path, f.mtime, f.size, 'kept' AS action FROM n JOIN f USING (path) UNION ALL SELECT id, path, mtime, size, 'reattached' FROM claim
        UNION ALL SELECT id, path, mtime, size, 'dropped' FROM o WHERE id NOT IN (SELECT id FROM claim) UNION ALL SELECT sha256(path), path, mtime, size, 'added' FROM w WHERE path NOT IN (SELECT path FROM claim)""",
    "changed_notes": f"WITH {_SN} SELECT f.path, f.mtime FROM f LEFT JOIN n USING (path) WHERE n.mtime IS DISTINCT FROM f.mtime",
    "repair_ids": f"""WITH {_SN}, e AS (SELECT o_orderkey::BIGINT AS edge, 'n/' || (o_custkey % 1000) || '.md' AS source_path, (o_orderkey % 1000)::VARCHAR AS target, CASE WHEN o_orderkey % 2 = 0 THEN 'known' END AS source_id FROM orders),
        j AS (SELECT e.*, a.id AS s, b.id AS t FROM e LEFT JOIN n a ON a.path = source_path LEFT JOIN n b ON b.path = 'n/' || target || '.md')
        SELECT edge, coalesce(source_id, s) AS source_id, t AS target_id, (source_id IS NULL AND s IS NOT NULL) OR t IS NOT NULL AS repaired FROM j""",
    "eval_prf": f"""WITH {DECORATED}, pt AS (SELECT DISTINCT p_name AS title FROM part),
        truth AS (SELECT DISTINCT note_id, unnest([lower(title), lower(other)]) AS target FROM notes), tr AS (SELECT * FROM truth WHERE target IN (SELECT lower(title) FROM pt)),
        src AS (SELECT 'all' AS system, note_id, content FROM notes UNION ALL SELECT 'unaliased', note_id, replace(content, '[[' || other || '|see it]]', '') FROM notes),
        pr AS (SELECT DISTINCT system, note_id, lower(pt.title) AS target FROM src, pt WHERE note_id IN (SELECT note_id FROM tr) AND regexp_matches(content, '(?i)(^|[^a-zA-Z0-9])' || pt.title || '($|[^a-zA-Z0-9])')),
        sy AS (SELECT DISTINCT system FROM src), j AS (SELECT coalesce(pr.system, w.system) AS system, w.target IS NOT NULL AS t, pr.target IS NOT NULL AS p
            FROM (SELECT * FROM tr, sy) w FULL JOIN pr ON pr.system = w.system AND pr.note_id = w.note_id AND pr.target = w.target),
        c AS (SELECT system, count(*) FILTER (t AND p) AS tp, count(*) FILTER (p AND NOT t) AS fp, count(*) FILTER (t AND NOT p) AS fn FROM j GROUP BY 1)
        SELECT system, tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""",
    "latency_percentiles": """WITH r AS (SELECT event_type, value AS ms, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
        SELECT event_type, count(*) AS n, round(avg(ms), 2) AS mean, round(max(ms) FILTER (i = least(n - 1, floor(n * 0.5))), 2) AS p50, round(max(ms) FILTER (i = least(n - 1, floor(n * 0.95))), 2) AS p95,
            round(max(ms) FILTER (i = least(n - 1, floor(n * 0.99))), 2) AS p99, round(max(ms), 2) AS max, round(sum(ms), 2) AS total FROM r GROUP BY 1""",
    "bench_summary": "WITH n AS (SELECT event_type AS phase, user_id, sum(value) AS ms FROM events GROUP BY ALL) SELECT phase, count(*) AS notes, round(avg(ms), 2) AS mean, round(sum(ms), 2) AS total FROM n GROUP BY 1",
    "debounce_sessions": """WITH o AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
        s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM o)
        SELECT user_id, max(ts) AS latest, count(*) AS n, arg_max(event_id, (ts, event_id)) AS last_event FROM s GROUP BY user_id, sid""",
    "cooldown_keep": """WITH RECURSIVE t AS (SELECT user_id, epoch_us(ts) AS t FROM events), k AS (SELECT user_id, min(t) AS t FROM t GROUP BY 1 UNION ALL
            SELECT k.user_id, (SELECT min(t.t) FROM t WHERE t.user_id = k.user_id AND t.t >= k.t + 21600000000) AS t FROM k WHERE k.t IS NOT NULL)
        SELECT user_id, count(t) AS kept, max(t) AS last FROM k GROUP BY 1""",
    "hash_embedding": "WITH p AS (SELECT DISTINCT p_name FROM part), c AS (SELECT p_name, unnest(list_transform(string_split(lower(trim(p_name)), ''), lambda x: ord(x))) AS x, unnest(range(length(trim(p_name)))) % 8 AS d FROM p), s AS (SELECT p_name, d, sum(x)::DOUBLE AS x FROM c GROUP BY ALL), n AS (SELECT p_name, sqrt(sum(x * x)) AS n FROM s GROUP BY 1) SELECT p_name, "
    + ", ".join(f"round(coalesce(max(x) FILTER (d = {d}), 0) / max(n), 6) AS v{d}" for d in range(8)) + " FROM s JOIN n USING (p_name) GROUP BY 1",
}
