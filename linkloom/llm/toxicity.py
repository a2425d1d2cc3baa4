"""Toxicity by weak supervision: many lexicon and pattern voters, a generative label model, a linear classifier.

1. Sample. Up to `max_rows` labelled rows outside the held-out fold (the documented bound; chosen by a
   hash of the id) are read whole. Features of a text are its distinct words, the stems that begin
   one, two or three of its words, so both exact words and families of compounds can be found, and patterns
   of spelling (shouting, runs of marks, drawn-out and masked words).
2. Voters. Features that are much likelier in toxic rows are chosen greedily by how many toxic rows
   they newly cover (so the words of one copied row don't fill the lexicon). A voter fires or abstains.
3. Label model. Firing rates and pairwise firing rates of the voters are counted over all documents.
   Voters that fire together form families (a language, a jargon), each with its own latent label.
   Within a family the triplet method gives every voter's accuracy from the covariances without
   labels; what a pair's covariance has beyond that is its correlation, and correlated voters count
   for less. The posterior is naive Bayes over the family's voters, joined over families.
4. Classifier. A logistic regression on the sample's most telling features is trained on the posteriors,
   not on the labels, and scores every document on its whole text.

Neither labels nor language, source or id enter a score. Voters and classifier have bounded sizes
(`max_voters`, `max_features`); the corpus statistics are sums over all documents.

Defined cases: null and empty texts have no features and get the score of the intercept; documents
whose label repeats take the highest; without any labelled row, or without a voter, all scores are 0;
repeated rows are scored each; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import byte_batches, byte_slices, texts, work_table

WORD = re.compile(r"[^\W\d_]+")
#: Lengths of word prefixes that are features; "^" marks them.
PREFIXES = (4, 5, 6, 7)
# Patterns of spelling that are features.
PATTERNS = {
    "!shout": re.compile(r"\b[A-Z]{4,}\b[^.\n]{0,40}\b[A-Z]{4,}\b"),
    "!marks": re.compile(r"[!?]{3,}"),
    "!drawn": re.compile(r"([^\W\d_])\1{3,}"),
    "!masked": re.compile(r"\b[^\W\d_]+[*@#$]+[^\W\d_]+\b"),
}
#: Documents whose score is at least this are toxic.
THRESHOLD = 0.3


def held_out(doc_id: Column) -> Column:
    """The fold that nothing is learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def words(text: str | None) -> set[str]:
    return set(WORD.findall(text.lower())) if text else set()


def features(text: str | None) -> set[str]:
    """Words, "^stem" for a stem that begins a longer word, "2^stem" and "3^stem" for so many such words, and
    "!name" for a pattern."""
    out = words(text)
    begun = Counter(w[:n] for w in out for n in PREFIXES if len(w) > n)
    out |= {name for name, p in PATTERNS.items() if text and p.search(text)}
    return out.union(*({f"^{p}"} | {f"{k}^{p}" for k in (2, 3) if n >= k} for p, n in begun.items()))


class Lexicon:
    """Finds which of the given features a text has."""

    def __init__(self, names: list[str]):
        self.words = {f: i for i, f in enumerate(names) if "^" not in f and f not in PATTERNS}
        self.patterns = [(PATTERNS[f].search, i) for i, f in enumerate(names) if f in PATTERNS]
        self.stems: dict[str, list[tuple[int, int]]] = {}
        for i, f in enumerate(names):
            if "^" in f:
                times, stem = f.split("^")
                self.stems.setdefault(stem, []).append((int(times or 1), i))
        self.lengths = [n for n in PREFIXES if any(len(s) == n for s in self.stems)]

    def present(self, text: str | None) -> list[int]:
        out, begun, stems, known, lengths = [], {}, self.stems, self.words, self.lengths
        for w in words(text):
            if w in known:
                out.append(known[w])
            size = len(w)
            for n in lengths:
                if size <= n:
                    break
                if (p := w[:n]) in stems:
                    begun[p] = begun.get(p, 0) + 1
        out += [i for p, n in begun.items() for times, i in stems[p] if n >= times]
        out += [i for search, i in self.patterns if text and search(text)]
        return sorted(out)


def _feature_counts(batches):
    for b in byte_batches(batches, "text"):
        n: dict[str, list[int]] = {}
        for label, text in zip(b.column("label").to_pylist(), b.column("text").to_pylist()):
            for f in features(text):
                n.setdefault(f, [0, 0])[label] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array([v[1] for v in n.values()], pa.int64()), pa.array([v[0] for v in n.values()], pa.int64())], names=["feature", "pos", "neg"])


def _indexed(names: list[str]):
    def run(batches):
        lexicon = Lexicon(names)
        for b in byte_batches(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column("label"), pa.array([lexicon.present(t) for t in b.column("text").to_pylist()], pa.list_(pa.int32()))], names=["label", "found"])

    return run


def _moments(names: list[str]):
    def run(batches):
        m, lexicon = len(names), Lexicon(names)
        total, n = np.zeros((m, m), np.int64), 0
        for b in byte_batches(batches, "text"):
            n += b.num_rows
            for t in b.column("text").to_pylist():
                if at := lexicon.present(t):
                    total[np.ix_(at, at)] += 1
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(i, -1), pa.int32()), pa.array(np.append(j, -1), pa.int32()), pa.array(np.append(total[i, j], n), pa.int64())], names=["i", "j", "n"])

    return run


def choose_voters(found: list[np.ndarray], labels: np.ndarray, names: list[str], most: int, precision: float = 0.75) -> list[int]:
    """Greedy cover of the toxic rows by precise features; the last add a row that no other holds."""
    pos, neg = np.zeros(len(names)), np.zeros(len(names))
    holders: dict[int, list[int]] = {}
    for row, (at, y) in enumerate(zip(found, labels)):
        (pos if y else neg)[at] += 1
        if y:
            for f in at:
                holders.setdefault(int(f), []).append(row)
    good = {f for f in holders if pos[f] / (pos[f] + neg[f] + 1) >= precision}
    sets, chosen, seen = {f: set(holders[f]) for f in good}, [], {}
    while sets and len(chosen) < most:
        # rows that few chosen voters hold count most, so a row gets several voters
        gain = {f: sum(0.5 ** seen.get(r, 0) for r in rows) * pos[f] / (pos[f] + neg[f] + 1) for f, rows in sets.items()}
        f = max(gain, key=lambda x: (gain[x], -len(names[x]), names[x]))
        if gain[f] < 1:
            break
        chosen.append(f)
        for r in sets.pop(f):
            seen[r] = seen.get(r, 0) + 1
        # a stem, its multiples and its longer forms are one voter
        stem = names[f].split("^")[-1]
        if "^" in names[f]:
            sets = {g: s for g, s in sets.items() if not names[g].split("^")[-1].startswith(stem)}
        sets = {g: s for g, s in sets.items() if not ("^" in names[g] and stem.startswith(names[g].split("^")[-1]))}
    return chosen


@dataclass
class LabelModel:
    family: np.ndarray
    prior: np.ndarray
    fire: np.ndarray  # P(fires | toxic)
    slip: np.ndarray  # P(fires | clean)
    weight: np.ndarray  # 1 / (1 + correlation with others)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(toxic) of rows of 0/1 votes."""
        clean = np.ones(len(votes))
        hit, miss = np.log(self.fire / self.slip), np.log((1 - self.fire) / (1 - self.slip))
        for f, prior in enumerate(self.prior):
            at = self.family == f
            odds = np.log(prior / (1 - prior)) + (votes[:, at] * (hit * self.weight)[at] + (1 - votes[:, at]) * (miss * self.weight)[at]).sum(1)
            odds = np.where(votes[:, at].any(1), odds, -30.0)
            clean *= 1 - 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        return 1 - clean


def fit_label_model(joint: np.ndarray, n: int, hits: np.ndarray, slips: np.ndarray) -> LabelModel:
    """From pair counts over n documents. hits: per voter the share of the sample's rows that are toxic and
    hold it; slips: a bound of its rate in clean rows of the sample, which covariances tell only roughly."""
    m = len(joint)
    p = np.clip(np.diag(joint) / n, 0.5 / n, 0.999)
    cov = joint / n - np.outer(p, p)
    sd = np.sqrt(p * (1 - p))
    corr = cov / np.outer(sd, sd)
    family = np.arange(m)
    for i in range(m):
        for j in range(i):
            if corr[i, j] > 0.15:
                family[family == family[i]] = family[j]
    _, family = np.unique(family, return_inverse=True)
    k = family.max() + 1 if m else 0
    # a family's share of documents: those with two of its voters in common, or its strongest voter
    prior = np.array([min(0.5, max(1.2 * p[family == f].max(), hits[family == f].max())) for f in range(k)])
    lift = np.zeros(m)
    for i in range(m):
        own = [j for j in np.nonzero(family == family[i])[0] if j != i]
        ratios = [cov[i, j] * cov[i, h] / cov[j, h] for x, j in enumerate(own) for h in own[:x] if cov[j, h] > 0]
        s = np.sqrt(max(np.median(ratios), 0)) if ratios else 0.9 * sd[i]
        lift[i] = s
    q = np.sqrt(prior * (1 - prior))[family] if m else p
    d = np.clip(lift / q, 0.05, 0.99)
    fire = np.clip(p + (1 - prior[family]) * d, 1e-3, 0.99)
    slip = np.clip(np.minimum(p - prior[family] * d, slips), 1e-6, 0.5)
    beyond = np.clip(corr - np.outer(lift / sd, lift / sd), 0, 1)
    np.fill_diagonal(beyond, 0)
    beyond[family[:, None] != family[None, :]] = 0
    return LabelModel(family, prior, fire, slip, 1 / (1 + beyond.sum(1)))


def fit_linear(found: list[np.ndarray], target: np.ndarray, m: int, rounds: int = 300, rate: float = 0.3, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on binary features by full-batch Adam; soft targets."""
    rows = np.repeat(np.arange(len(found)), [len(f) for f in found])
    cols = np.concatenate(found).astype(np.int64) if len(rows) else np.zeros(0, np.int64)
    w, b = np.zeros(m + 1), 0.0
    mean, var = np.zeros(m + 1), np.zeros(m + 1)
    for t in range(1, rounds + 1):
        z = np.bincount(rows, w[cols], len(found)) + w[m]
        e = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target
        g = np.append(np.bincount(cols, e[rows], m), e.sum()) / len(found)
        g[:m] += decay * w[:m]
        mean, var = 0.9 * mean + 0.1 * g, 0.999 * var + 0.001 * g * g
        w = w - rate * (mean / (1 - 0.9**t)) / (np.sqrt(var / (1 - 0.999**t)) + 1e-8)
    b = float(w[m])
    return w[:m], b


@dataclass
class Model:
    names: list[str]
    weights: np.ndarray
    bias: float
    voters: list[str]

    def __post_init__(self):
        self.lexicon = Lexicon(self.names)

    def score(self, text: str | None) -> float:
        if self.bias == -np.inf:
            return 0.0
        z = self.bias + float(self.weights[self.lexicon.present(text)].sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = 20_000, max_features: int = 6_000, max_voters: int = 64) -> Model:
    """Learns from labels (doc_id, toxic) outside the held-out fold; statistics from all of docs."""
    gold = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("l_id")).agg(F.max("toxic").cast("int").alias("label"))
    gold = work_table(gold.orderBy(F.xxhash64("l_id")).limit(max_rows), "gold")
    rows = texts(docs, id_col, text_col)
    sample = rows.join(F.broadcast(gold), F.col("doc_id") == F.col("l_id")).select("label", "text", "l_id", F.xxhash64("text").alias("hash"))  # at most max_rows narrow rows
    sample = work_table(sample, "sample")
    if sample.count() > max_rows:  # ids that repeat in docs: so many rows all the same
        place = F.row_number().over(Window.partitionBy("l_id", "hash").orderBy("label"))
        once = sample.withColumn("n", place).where("n = 1").drop("n")
        some = once.select("l_id", "hash").orderBy(F.xxhash64("l_id", "hash"), "l_id", "hash").limit(max_rows)
        sample = work_table(once.join(F.broadcast(some), ["l_id", "hash"]), "sample")
    counted = sample.mapInArrow(_feature_counts, "feature string, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    sums = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    n_pos, n_neg = max(1, sums.get(1, 0)), max(1, sums.get(0, 0))
    odds = F.log(((F.col("pos") + 0.5) / n_pos) / ((F.col("neg") + 0.5) / n_neg))
    telling = counted.where(F.col("pos") >= max(3, n_pos // 400)).where(odds > 1).orderBy((F.col("pos") * odds).desc(), "feature").limit(max_features)
    names = [r["feature"] for r in telling.select("feature").collect()]
    none = Model([], np.zeros(0), -np.inf, [])
    if not names or not sums.get(1):
        return none
    held = sample.mapInArrow(_indexed(names), "label int, found array<int>").collect()  # at most max_rows rows of indices
    found = [np.array(r["found"], np.int64) for r in held]
    y = np.array([r["label"] for r in held])
    chosen = choose_voters(found, y, names, max_voters)
    if not chosen:
        return none
    voters = [names[f] for f in chosen]
    counts = rows.mapInArrow(_moments(voters), "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    joint, total = np.zeros((len(voters), len(voters))), 1
    for r in counts:
        if r["i"] < 0:
            total = max(1, r["n"])
        else:
            joint[r["i"], r["j"]] = r["n"]
    place = {f: i for i, f in enumerate(chosen)}
    votes = np.zeros((len(found), len(chosen)))
    for row, at in enumerate(found):
        votes[row, [place[f] for f in at if f in place]] = 1
    slips = (votes[y == 0].sum(0) + 0.5) / ((y == 0).sum() + 1)
    model = fit_label_model(joint, total, votes[y == 1].sum(0) / len(y), slips)
    w, b = fit_linear(found, model.posterior(votes), len(names))
    return Model(names, w, b, voters)


def scorer(spark, model: Model):
    """Column function: score of a text column, computed in Arrow batches."""
    shared = spark.sparkContext.broadcast(model)  # at most max_features weights

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        m = shared.value
        return pa.array([m.score(t) for part in byte_slices(text) for t in part], pa.float64())

    return score


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted per row of docs."""
    rows = texts(docs, id_col, text_col)
    scored = rows.select("doc_id", scorer(docs.sparkSession, model)("text").alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs that score below the threshold, with all their columns."""
    return docs.where(scorer(docs.sparkSession, model)(docs[text_col]) < THRESHOLD)
