"""Change events of notes as streams: routing, debounce, cooldown, and publishing of results.

Two forms of the debounce: session windows on event time, which batch and streaming share, and an exact
keyed state with timers. The cooldown is a fold over a note's times in order.
"""

from __future__ import annotations

import json
import logging
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

log = logging.getLogger(__name__)
DEBOUNCE_MS, PRIORITY_MS, COOLDOWN_MS = 500, 200, 2000


def route(events: DataFrame) -> DataFrame:
    """Jobs of vault events (ts, path, type, old_path): only notes; a delete cancels and drops, a rename
    cancels the old path and enqueues the new one. Output: (ts, path, action, old_path)."""
    notes = events.where(F.col("path").endswith(".md"))
    act = lambda path, action: F.struct(path.alias("path"), F.lit(action).alias("action"), F.col("old_path").alias("old_path"))
    p, o = F.col("path"), F.col("old_path")
    jobs = (
        F.when(F.col("type").isin("create", "modify"), F.array(act(p, "enqueue")))
        .when(F.col("type") == "delete", F.array(act(p, "cancel"), act(p, "drop")))
        .when(F.col("type") == "rename", F.array(act(o, "cancel"), act(p, "rename"), act(p, "enqueue")))
    )
    return notes.select("ts", F.explode(jobs).alias("j")).select("ts", "j.path", "j.action", "j.old_path")


EVENTS = "ts timestamp, path string, type string, old_path string"


def read_events(spark: SparkSession, path: str, late: str = "1 minute") -> DataFrame:
    """Stream of vault events (ts, path, type, old_path) from JSON lines that are added below path. Only notes;
    an event that is delivered again within `late` counts once, however often the folder is subscribed to."""
    events = spark.readStream.schema(EVENTS).json(path).where(F.col("path").endswith(".md"))
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["ts", "path", "type", "old_path"])


def persist_times(writes: DataFrame, key: str = "store", t: str = "t", quiet_ms: int = 300, most_ms: int = 5000) -> DataFrame:
    """(key, flush, writes): when a store is saved. A save follows when no write came for quiet_ms, or most_ms after the
    first write that it holds, whichever is sooner, so writes without a pause can't put it off. Rows of a key stream
    through in order."""
    import pyarrow as pa

    kinds = dict(writes.dtypes)
    rows = writes.select(F.col(key).alias("key"), F.col(t).cast("long").alias("t")).repartition("key").sortWithinPartitions("key", "t")

    def run(batches):
        now, first, last, n = None, None, None, 0
        out: list[tuple] = []

        def sent():
            return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], rows_type), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.int64())], names=["key", "flush", "writes"])

        for b in batches:
            rows_type = b.schema.field("key").type
            for k, x in zip(b.column("key").to_pylist(), b.column("t").to_pylist()):
                if n and (k != now or x >= min(last + quiet_ms, first + most_ms)):
                    out.append((now, min(last + quiet_ms, first + most_ms), n))
                    n = 0
                now, first, last, n = k, first if n else x, x, n + 1
            if out:
                yield sent()
                out.clear()
        if n:
            out.append((now, min(last + quiet_ms, first + most_ms), n))
            yield sent()

    return rows.mapInArrow(run, f"key {kinds[key]}, flush long, writes long").withColumnRenamed("key", key)


def gap(active: Column | None = None, debounce_ms: int = DEBOUNCE_MS, priority_ms: int = PRIORITY_MS) -> Column:
    """How long a note must be quiet; shorter for the active one."""
    ms = F.lit(debounce_ms) if active is None else F.when(active, priority_ms).otherwise(debounce_ms)
    return F.concat(ms.cast("string"), F.lit(" milliseconds"))


def debounce(jobs: DataFrame, quiet: Column | str, watermark: str | None = None, key: str = "path", time: str = "ts", order: str | None = None) -> DataFrame:
    """The latest job of each burst: (key, started, fires, n, <other columns>), for batch and for streams."""
    rows = jobs.withColumn(time, F.col(time).cast("timestamp"))
    rows = rows.withWatermark(time, watermark) if watermark else rows
    others = [c for c in jobs.columns if c not in (key, time)]
    last = F.max_by(F.struct(*others), F.struct(time, order) if order else F.col(time)) if others else F.lit(None)
    got = rows.groupBy(key, F.session_window(time, quiet).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max(time).alias("latest"), last.alias("job"))
    return got.select(key, F.col("w.start").alias("started"), F.col("w.end").alias("fires"), "latest", "n", *([f"job.{c}" for c in others]))


def keep_after_cooldown(times: Column, cooldown: Column | int) -> Column:
    """Of sorted times (longs), those that are at least the cooldown after the last kept one."""
    start = F.slice(times, 1, 0)
    step = lambda kept, t: F.when((F.size(kept) == 0) | (t - F.element_at(F.when(F.size(kept) > 0, kept).otherwise(F.array(t)), -1) >= cooldown), F.concat(kept, F.array(t))).otherwise(kept)
    return F.aggregate(times, start, step)


def cooldown(jobs: DataFrame, key: str = "path", t: str = "t", cooldown_ms: int = COOLDOWN_MS, forced: str | None = None) -> DataFrame:
    """(key, t) of the jobs that run: one that comes within the cooldown after the last that ran is lost,
    unless its boolean column forced says that it runs anyway.

    Rows of a key stream through in order (secondary sort), so a busy note never has to fit in memory.
    """
    import pyarrow as pa

    kinds = dict(jobs.dtypes)
    rows = jobs.select(F.col(key).alias("key"), F.col(t).cast("long").alias("t"), F.coalesce(F.col(forced), F.lit(False)).alias("f") if forced else F.lit(False).alias("f")).repartition("key").sortWithinPartitions("key", "t")

    def run(batches):
        now, last = None, None
        for b in batches:
            keep = []
            for k, x, f in zip(*(b.column(c).to_pylist() for c in ("key", "t", "f"))):
                if k != now:
                    now, last = k, None
                ok = f or last is None or x - last >= cooldown_ms
                keep.append(ok)
                last = x if ok else last
            yield b.select(["key", "t"]).filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(run, f"key {kinds[key]}, t long").withColumnRenamed("key", key)


def debounced_jobs(jobs: DataFrame, debounce_ms: int = DEBOUNCE_MS, priority_ms: int = PRIORITY_MS, cooldown_ms: int = COOLDOWN_MS) -> DataFrame:
    """Exact queue over a stream of (ts timestamp, path, action, high boolean): keyed state with timers.

    An enqueue sets the note's timer; the last one within the quiet time fires. A cancel clears it. A job
    within the cooldown after the last fired one is lost.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pending, fired = state.get if state.exists else (-1, -1)
        out = []

        def fire() -> None:
            nonlocal pending, fired
            if fired < 0 or pending - fired >= cooldown_ms:
                fired = pending
                out.append(pending)
            pending = -1

        if state.hasTimedOut:
            if pending >= 0:
                fire()
        else:
            rows = pd.concat(list(frames)).sort_values("ts", kind="stable")
            for ts, action, high in zip(rows["ts"], rows["action"], rows["high"]):
                now = int(ts.timestamp() * 1000)
                if pending >= 0 and now >= pending:
                    fire()
                if action == "enqueue":
                    pending = now + (priority_ms if high else debounce_ms)
                elif action == "cancel":
                    pending = -1
        state.update((pending, fired))
        if pending >= 0:
            state.setTimeoutTimestamp(max(pending, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"path": [key[0]] * len(out), "fires": pd.to_datetime(out, unit="ms")})

    return jobs.withWatermark("ts", "1 second").groupBy("path").applyInPandasWithState(run, "path string, fires timestamp", "pending long, fired long", "append", GroupStateTimeout.EventTimeTimeout)


def vault_jobs(jobs: DataFrame, debounce_ms: int = DEBOUNCE_MS, priority_ms: int = PRIORITY_MS, cooldown_ms: int = COOLDOWN_MS) -> DataFrame:
    """The queue of a whole vault as stream state: (vault, path, fires) of (ts, vault, path, action).

    Actions: enqueue sets a note's timer, a shorter one if the note is in focus; cancel clears it; focus makes a
    note the one in focus and cancels the normal jobs of all others; flush runs what is pending at once; force runs a
    note now. A timed job within the cooldown after the note last ran is lost, flushed and forced ones are not.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        saved = json.loads(state.get[0]) if state.exists else {"focus": None, "pending": {}, "ran": {}}
        pending, ran, out = saved["pending"], saved["ran"], []  # pending: path -> [fires, high]

        def fire(path: str, at: int, sure: bool) -> None:
            if sure or path not in ran or at - ran[path] >= cooldown_ms:
                ran[path] = at
                out.append((path, at))

        def due(now: int) -> None:
            for at, path in sorted((at, path) for path, (at, _) in pending.items() if at <= now):
                del pending[path]
                fire(path, at, False)

        if state.hasTimedOut:
            due(state.getCurrentWatermarkMs())
        else:
            rows = pd.concat(list(frames)).sort_values("ts", kind="stable")
            for ts, path, action in zip(rows["ts"], rows["path"], rows["action"]):
                now = int(ts.timestamp() * 1000)
                due(now)
                if action == "enqueue":
                    high = path == saved["focus"]
                    pending[path] = [now + (priority_ms if high else debounce_ms), high]
                elif action == "cancel":
                    pending.pop(path, None)
                elif action == "focus":
                    saved["focus"] = path
                    for other in [p for p, (_, high) in pending.items() if p != path and not high]:
                        del pending[other]
                elif action == "flush":
                    for other in sorted(pending, key=lambda p: pending[p][0]):
                        fire(other, now, True)
                    pending.clear()
                elif action == "force":
                    pending.pop(path, None)
                    fire(path, now, True)
                for old in [p for p, at in ran.items() if now - at >= cooldown_ms]:
                    del ran[old]
        state.update((json.dumps(saved),))
        if pending:
            state.setTimeoutTimestamp(max(min(at for at, _ in pending.values()), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"vault": [key[0]] * len(out), "path": [p for p, _ in out], "fires": pd.to_datetime([at for _, at in out], unit="ms")})

    rows = jobs.withWatermark("ts", "1 second").groupBy("vault")
    return rows.applyInPandasWithState(run, "vault string, path string, fires timestamp", "saved string", "append", GroupStateTimeout.EventTimeTimeout)


def switch_focus(pending: DataFrame, active: str) -> DataFrame:
    """Pending jobs (path, high, ...) after the user turns to a note: its own, now high, and the high ones."""
    own = F.col("path") == active
    return pending.where(own | F.col("high")).withColumn("high", F.col("high") | own)


def dispatch_order(jobs: DataFrame) -> DataFrame:
    """Order in which jobs run: high before normal, first come first."""
    from pyspark.sql import Window

    w = Window.partitionBy("batch").orderBy(F.col("high").desc(), "seq")
    return jobs.withColumn("place", F.row_number().over(w))


def publish(stream: DataFrame, root: str, resolve: Callable[[DataFrame], DataFrame], seconds: int = 5, available_now: bool = False, skip_failed: bool = False):
    """Starts a query that resolves each micro-batch of jobs and replaces the edges of its notes.

    Batches run one after the other; a note's edges are one folder, replaced in one dynamic overwrite, so a
    repeated batch leaves the same state. The trigger bounds how often state is written. With skip_failed a batch
    that fails is tried note by note; notes that fail again are logged and left out, and the next batch follows.
    """
    def save(latest: DataFrame) -> None:
        resolve(latest).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_id").parquet(f"{root}/edges")

    def write(batch: DataFrame, number: int) -> None:
        latest = batch.groupBy("path").agg(F.max("ts").alias("ts"))
        if not skip_failed:
            return save(latest)
        latest = latest.persist()
        try:
            save(latest)
        except Exception as whole:
            log.warning("batch %s failed, its notes follow one by one: %s", number, whole)
            for row in latest.toLocalIterator():
                try:
                    save(latest.where(F.col("path") == row["path"]))
                except Exception as error:
                    log.warning("note %s is left out: %s", row["path"], error)
        finally:
            latest.unpersist()

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{root}/_progress")
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=f"{seconds} seconds")).start()


def publish_in_steps(steps: list[Callable[[], DataFrame]], root: str, has_edges: bool, commit: Callable[[], None]) -> int:
    """Writes interim results of a note batch one after the other (lexical, then with dense, then all), each
    replacing the last; interim ones only where there are no edges yet. commit records the notes' times last,
    so a run that breaks off is done again. A later step that fails leaves the earlier one committed."""
    done = 0
    for i, step in enumerate(steps):
        if i < len(steps) - 1 and has_edges:
            continue
        try:
            step().write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_id").parquet(f"{root}/edges")
            done = i + 1
        except Exception:
            if has_edges and not done:
                steps[0]().write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_id").parquet(f"{root}/edges")
                done = 1
            if not done:
                raise
            break
    commit()
    return done
