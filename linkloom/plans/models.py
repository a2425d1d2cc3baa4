"""Registered queries on features, labels, pooling, order of work and changes of state."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import corpus, evaluate, resolve, sae, store
from ..streaming import queue
from .common import table
from .edges import _atoms, _denials, _features, _SAE, _ST, _stored, _V, _vectors


def feature_preview(spark, sf_dir):
    names = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.concat(F.lit("text "), F.col("vec_id").cast("string")).alias("text"))
    got = sae.top_activating(_features(spark, sf_dir), names, 5)
    return got.select("idx", "fires", "rank", "text", F.round("value", 6).alias("value"))


def sae_reconstruction(spark, sf_dir):
    atoms = _atoms(spark, sf_dir).select("idx", F.col("enc").alias("dec"))
    got = sae.decode(_features(spark, sf_dir), atoms)
    return got.select("id", F.round(V.dot(F.col("v"), F.col("v")), 5).alias("energy"))


def atom_labels(spark, sf_dir):
    """Decoder atoms, differences of neighbouring vectors, named by their nearest vectors."""
    v = _vectors(spark, sf_dir)
    a, b = (v.where(F.col("id") < 129).select((F.col("id") - d).alias("id"), F.col("v").alias(n)) for d, n in ((0, "a"), (1, "b")))
    atoms = a.join(b, "id").select("id", F.zip_with("a", "b", lambda x, y: x.cast("double") - y.cast("double")).alias("v"))
    near = resolve.dense_pairs(atoms, v, threshold=-1.0, k=20)
    terms = v.select("id", F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    return sae.label_atoms(near, terms, least=0.3, top=3).select(F.col("idx").cast("int").alias("idx"), "label")


def mean_pooling(spark, sf_dir):
    """Every vector read as four token states of 16 numbers, the last one masked."""
    states = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice("embedding", i * 16 + 1, 16))
    pooled = V.mean_pool(states, F.array(*map(F.lit, (1, 1, 1, 0))))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.get(pooled, F.lit(0)), 6).alias("x0"), F.round(F.get(pooled, F.lit(15)), 6).alias("x15"))


def l2_norms(spark, sf_dir):
    v = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(V.norm(v), 6).alias("norm"), F.round(V.norm(V.l2_normalize(v)), 6).alias("unit"))


def drops_below_maximum(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return evaluate.not_monotone(rows, "event_id", "value", 100.0, "user_id").select("user_id", "event_id", "value", "before")


def dispatch_order(spark, sf_dir):
    jobs = table(spark, sf_dir, "events").select(F.col("user_id").alias("batch"), (F.col("event_type") == "purchase").alias("high"), F.col("event_id").alias("seq"))
    return queue.dispatch_order(jobs).select(F.col("batch").alias("user_id"), F.col("seq").alias("event_id"), "place")


def edge_changes(spark, sf_dir):
    before = _stored(spark, sf_dir).where("source_id is not null").groupBy("source_id", "phrase", "target_id").agg(F.max("similarity").alias("similarity"))
    after = store.suppress(before, _denials(spark, sf_dir)).withColumn("similarity", F.when(F.col("target_id") == "3", 1.0).otherwise(F.col("similarity")))
    return store.changes(before, after)


def train_split(spark, sf_dir):
    return corpus.split_train(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", share=0.1)


def probe_sample(spark, sf_dir):
    return corpus.sample_rows(table(spark, sf_dir, "embeddings").select("vec_id"), "vec_id", 100)


def sweep_configs(spark, sf_dir):
    base = {"max_n": 10, "embed_cap": 60, "strong": 0.95}
    rows = evaluate.sweep(base, {"max_n": [1, 3, 5, 10], "embed_cap": [10, 30, 60, 200, 500], "strong": [0.85, 0.95, 1.0]})
    return spark.createDataFrame([(c["max_n"], c["embed_cap"], c["strong"]) for c in rows], "max_n int, embed_cap int, strong double")


QUERIES = [feature_preview, sae_reconstruction, atom_labels, mean_pooling, l2_norms, drops_below_maximum, dispatch_order, edge_changes, train_split, probe_sample, sweep_configs]

ORACLES = {
    "feature_preview": f"""WITH {_SAE}, r AS (SELECT idx, id, value, row_number() OVER (PARTITION BY idx ORDER BY value DESC, id) AS r, count(*) OVER (PARTITION BY idx) AS fires FROM feats WHERE value > 0)
        SELECT idx, fires, r::INTEGER AS rank, 'text ' || id AS text, round(value, 6) AS value FROM r WHERE r <= 5""",
    "sae_reconstruction": f"""WITH {_SAE}, d AS (SELECT f.id, unnest(list_transform(a.enc, lambda x: x * f.value)) AS x, unnest(range(64)) AS dim FROM feats f JOIN atoms a USING (idx)),
        s AS (SELECT id, dim, sum(x) AS x FROM d GROUP BY ALL) SELECT id, round(sum(x * x), 5) AS energy FROM s GROUP BY id""",
    "atom_labels": f"""WITH {_V}, a AS (SELECT x.id, list_transform(range(1, len(x.v) + 1), lambda i: x.v[i] - y.v[i]) AS v FROM e x JOIN e y ON y.id = x.id + 1 WHERE x.id < 128),
        s AS (SELECT a.id, e.id AS r_id, list_cosine_similarity(a.v, e.v) AS s FROM a, e), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(s, 12) DESC, r_id) AS r, max(s) OVER (PARTITION BY id) AS best FROM s)
        SELECT id::INTEGER AS idx, string_agg('t' || r_id, ' · ' ORDER BY round(s, 12) DESC, r_id) AS label FROM r WHERE r <= 3 AND best >= 0.3 AND s >= 0.15 GROUP BY id""",
    "mean_pooling": """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), m AS (SELECT vec_id, list_transform(range(1, 17), lambda i: (v[i] + v[i + 16] + v[i + 32]) / 3) AS p FROM e)
        SELECT vec_id, round(p[1] / sqrt(list_dot_product(p, p)), 6) AS x0, round(p[16] / sqrt(list_dot_product(p, p)), 6) AS x15 FROM m""",
    "l2_norms": "SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm, 1.0::DOUBLE AS unit FROM embeddings",
    "drops_below_maximum": "WITH w AS (SELECT user_id, event_id, value, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM events) SELECT * FROM w WHERE value < before - 100",
    "dispatch_order": "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_type = 'purchase' DESC, event_id)::INTEGER AS place FROM events",
    "edge_changes": f"""WITH {_ST}, b AS (SELECT source_id, phrase, phrase_key, target_id, max(similarity) AS old FROM so WHERE source_id IS NOT NULL GROUP BY ALL),
        c AS (SELECT b.*, d.source_id IS NOT NULL AS gone FROM b LEFT JOIN (SELECT DISTINCT * FROM dn) d USING (source_id, phrase_key, target_id))
        SELECT source_id, phrase, target_id, old, CASE WHEN NOT gone THEN 1.0::DOUBLE END AS new, CASE WHEN gone THEN 'removed' ELSE 'changed' END AS change FROM c WHERE gone OR (target_id = '3' AND old <> 1)""",
    "train_split": "SELECT o_orderkey, row_number() OVER (ORDER BY md5('0 ' || o_orderkey), o_orderkey) <= least(4096, greatest(1, floor(count(*) OVER () * 0.1))) AS is_val FROM orders",
    "probe_sample": "SELECT vec_id FROM embeddings ORDER BY md5('42 ' || vec_id), vec_id LIMIT 100",
    "sweep_configs": """WITH f AS (SELECT n, c, s::DOUBLE AS s FROM unnest([1, 3, 5, 10]) a(n), unnest([10, 30, 60, 200, 500]) b(c), unnest([0.85, 0.95, 1.0]) d(s))
        SELECT n AS max_n, c AS embed_cap, s AS strong FROM f WHERE (n <> 10)::INTEGER + (c <> 60)::INTEGER + (s <> 0.95)::INTEGER <= 1""",
}
