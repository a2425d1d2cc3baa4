"""Evaluation: confusion sets, micro precision and recall, recall at K, latency summaries, run comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .resolve import small


def confusion(predicted: DataFrame, truth: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """(system, note_id, tp, fp, fn) of distinct (system, note_id, target) against (note_id, target).

    Truth is limited to known titles; notes without truth are left out.
    """
    t = truth.select("note_id", "target").distinct()
    if titles is not None:
        t = t.join(titles.select(F.col(titles.columns[0]).alias("target")).distinct(), "target", "left_semi")
    notes = t.select("note_id").distinct()
    systems = predicted.select("system").distinct()
    want = t.crossJoin(systems).select("system", "note_id", "target", F.lit(1).alias("t"))  # systems are a handful of names
    have = predicted.select("system", "note_id", "target").distinct().join(notes, "note_id", "left_semi").withColumn("p", F.lit(1))
    both = want.join(have, ["system", "note_id", "target"], "full_outer")
    hit = lambda a, b: F.count_if(a & b)
    is_t, is_p = F.col("t").isNotNull(), F.col("p").isNotNull()
    return both.groupBy("system", "note_id").agg(hit(is_t, is_p).alias("tp"), hit(~is_t, is_p).alias("fp"), hit(is_t, ~is_p).alias("fn"))


def ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def scores(tp: Column, fp: Column, fn: Column) -> list[Column]:
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return [p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1")]


def per_note(conf: DataFrame) -> DataFrame:
    return conf.select("*", *scores(F.col("tp"), F.col("fp"), F.col("fn")))


def micro(conf: DataFrame) -> DataFrame:
    total = conf.groupBy("system").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    return total.select("*", *scores(F.col("tp"), F.col("fp"), F.col("fn")))


def worst(notes: DataFrame, by: str, size: Column, n: int = 10) -> DataFrame:
    """The n lowest by precision or recall among notes with at least two predicted or true targets."""
    return notes.where(size >= 2).orderBy(by, "note_id").limit(n)


def deltas(notes: DataFrame, a: str, b: str, least: float = 0.01) -> DataFrame:
    """Notes whose F1 differs between two systems by more than least."""
    left = notes.where(F.col("system") == a).select("note_id", F.col("f1").alias("f1_a"))
    right = notes.where(F.col("system") == b).select("note_id", F.col("f1").alias("f1_b"))
    d = F.col("f1_b") - F.col("f1_a")
    return left.join(right, "note_id").withColumn("delta", d).where(F.abs(d) > least)


def recall_at_k(candidates: DataFrame, oracle: DataFrame, k: int) -> DataFrame:
    """(probe, recall): share of the oracle's k neighbours among the candidates'. Both: (probe, id, rank)."""
    o, c = (df.where(F.col("rank") <= k).select("probe", "id") for df in (oracle, candidates))
    hits = o.join(c.withColumn("hit", F.lit(1)), ["probe", "id"], "left")
    return hits.groupBy("probe").agg((F.count("hit") / k).alias("recall"))


def recall_summary(recalls: DataFrame) -> DataFrame:
    return recalls.agg(F.avg("recall").alias("mean"), F.expr("percentile(recall, 0.5)").alias("median"), F.expr("percentile(recall, 0.25)").alias("p25"), F.expr("percentile(recall, 0.75)").alias("p75"))


def percentile_at(sorted_values: Column, q: float) -> Column:
    """Element min(n - 1, floor(q * n)) of a sorted array, without interpolation."""
    n = F.size(sorted_values)
    return F.get(sorted_values, F.least(n - 1, F.floor(n * F.lit(q)).cast("int")))


def latency_summary(times: DataFrame, *by: str, value: str = "ms") -> DataFrame:
    """n, mean, p50, p95, p99, max and sum per group, to two decimals.

    Element min(n - 1, floor(q * n)) of the sorted values is the one where the running count first exceeds that
    number. Values are counted before they are ordered, and those of a group are ordered in ranges of about
    equal size: a range's place comes from the counts of the ranges before it, so no task sorts a whole group.
    """
    each = times.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    low, high = F.min(value).alias("_low"), F.max(value).alias("_high")
    sums = times.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("_mean"), F.sum(value).alias("_sum"), low, high)
    width = F.greatest(F.col("_high").cast("double") - F.col("_low"), F.lit(1e-300))
    keyed = each.join(small(sums), [*by]) if by else each.crossJoin(F.broadcast(sums))  # without groups sums is one row
    cell = F.least(F.floor((F.col(value) - F.col("_low")) / width * 1024), F.lit(1023))
    keyed = keyed.withColumn("_cell", cell)
    before = Window.partitionBy(*by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = keyed.groupBy(*by, "_cell").agg(F.sum("_c").alias("_in")).withColumn("_before", F.coalesce(F.sum("_in").over(before), F.lit(0)))  # at most 1024 a group
    inside = Window.partitionBy(*by, "_cell").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    placed = keyed.join(small(cells.select(*by, "_cell", "_before")), [*by, "_cell"]).withColumn("_upto", F.col("_before") + F.sum("_c").over(inside))
    at = lambda q: F.min(F.when(F.col("_upto") > F.least(F.col("n") - 1, F.floor(F.col("n") * F.lit(q))), F.col(value)))
    r = lambda c: F.round(c, 2)
    found = placed.groupBy(*by).agg(F.first("n").alias("n"), at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"), F.first("_mean").alias("_mean"), F.first("_sum").alias("_sum"), F.max(value).alias("_top"))
    return found.select(*by, "n", r("_mean").alias("mean"), r("p50").alias("p50"), r("p95").alias("p95"), r("p99").alias("p99"), r("_top").alias("max"), r("_sum").alias("total"))


def phase_totals(times: DataFrame, *by: str) -> DataFrame:
    """Per group and phase: the sum of each note's time, then mean and sum over notes. times: (note_id, phase, ms)."""
    note = times.groupBy(*by, "phase", "note_id").agg(F.sum("ms").alias("ms"))
    return note.groupBy(*by, "phase").agg(F.count(F.lit(1)).alias("notes"), F.round(F.avg("ms"), 2).alias("mean"), F.round(F.sum("ms"), 2).alias("total"))


def not_monotone(series: DataFrame, order: str, value: str, slack: float = 0.0, *by: str) -> DataFrame:
    """Rows below the running maximum of what comes before them by more than slack."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return series.withColumn("before", F.max(value).over(w)).where(F.col(value) < F.col("before") - slack)


def phase_drift(phases: DataFrame, totals: DataFrame, most: float = 0.05) -> DataFrame:
    """(label, pass, phase_sum, total, drift) of the runs whose phases don't sum up to their total time by more
    than `most` of it. phases: (label, pass, phase, sum); totals: (label, pass, total)."""
    sums = phases.groupBy("label", "pass").agg(F.sum("sum").alias("phase_sum"))
    drift = F.abs(F.col("phase_sum") - F.col("total")) / F.greatest(F.col("total"), F.lit(1.0))
    return totals.join(sums, ["label", "pass"]).select("label", "pass", "phase_sum", "total", drift.alias("drift")).where(F.col("drift") > most)


def label_coverage(labels: DataFrame, hidden: int) -> DataFrame:
    """(live, percent): how many of the hidden features have a label that isn't empty."""
    live = F.count_if(F.coalesce(F.length("label"), F.lit(0)) > 0)
    return labels.agg(live.alias("live")).select("live", F.round(F.col("live") * 100.0 / hidden, 2).alias("percent"))


def compare_runs(reports: DataFrame) -> DataFrame:
    """One row per run: final error by precedence (final value, metrics, last epoch), live and dead features.

    reports: (run, final_mse, metrics_mse, epochs array<struct<mse, dead>>, hidden, labelled).
    """
    last = F.try_element_at("epochs", F.lit(-1))
    return reports.select("run", F.coalesce("final_mse", "metrics_mse", last["mse"]).alias("mse"), last["dead"].alias("dead"), ratio(F.col("labelled") * 100.0, F.col("hidden")).alias("coverage"))


def sweep(base: dict, factors: dict[str, list]) -> list[dict]:
    """Configurations of a one-factor-at-a-time sweep: the base and each factor's values, equal ones once."""
    out = [dict(base)]
    for name, values in factors.items():
        out += [c for v in values if (c := base | {name: v}) not in out]
    return out
