"""Job progress as streams of events: snapshots, percentages, step states, messages. All work on batch frames too."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Which step a stage of an ingest runs, and which it finishes.
STAGES = (("validate", "validate", "select"), ("model", "model", "validate"), ("connect", "collection", "model"), ("embed", "ingest", "collection"), ("insert", "ingest", "collection"))


def percent(current: Column, total: Column) -> Column:
    """Whole percent, halves to even, from 0 to 100; 0 without a total."""
    return F.when(total > 0, F.least(F.lit(100), F.greatest(F.lit(0), F.bround(100.0 * current / total).cast("int")))).otherwise(F.lit(0))


def snapshots(events: DataFrame, job: str, version: str, columns: list[str]) -> DataFrame:
    """The state of each job at its highest version; in update mode a stream emits a job when that changes."""
    return events.groupBy(job).agg(F.max_by(F.struct(version, *columns), F.struct(version, *columns)).alias("s")).select(job, "s.*")


def step_states(events: DataFrame, job: str, step: str, status: str, order: str, failed: Column) -> DataFrame:
    """(job, step, status): the last status of each step; when a job has failed, running and paused steps are errors."""
    last = events.groupBy(job, step).agg(F.max_by(status, order).alias("status"))
    broken = events.groupBy(job).agg(F.max(F.when(failed, 1).otherwise(0)).alias("broken"))
    return last.join(broken, job).select(job, step, F.when((F.col("broken") == 1) & F.col("status").isin("running", "paused"), "error").otherwise(F.col("status")).alias("status"))


def recent(messages: DataFrame, job: str, order: list, n: int = 80) -> DataFrame:
    """The last n messages of each job, with their place from the end."""
    w = Window.partitionBy(job).orderBy(*(F.col(c).desc() for c in order))
    return messages.withColumn("back", F.row_number().over(w)).where(F.col("back") <= n)


def stage_step(stage: Column) -> Column:
    """struct<runs, finishes>: steps of a stage; null for stages of no step."""
    runs, ends = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, run, end in reversed(STAGES):
        runs, ends = F.when(stage == name, run).otherwise(runs), F.when(stage == name, end).otherwise(ends)
    return F.struct(runs.alias("runs"), ends.alias("finishes"))


def windowed_counts(events: DataFrame, time: str, key: str, value: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums per tumbling window; as a stream, events later than the watermark are dropped."""
    marked = events.withWatermark(time, late) if events.isStreaming else events
    g = marked.groupBy(F.window(time, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n_events"), F.sum(value).alias("total"))
    return g.select(F.col("w.start").alias("window_start"), key, "n_events", "total")


def step_machine(events: DataFrame, job: str, step: str, status: str) -> DataFrame:
    """The same as step_states for a stream, with arbitrary state: each job keeps its steps and emits them when they change.

    events has the three columns and `failed` (boolean); the state is one JSON text per job.
    """
    import json

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        steps, broken = json.loads(state.get[0]) if state.exists else ({}, False)
        for f in frames:
            for s, v, bad in zip(f[step], f[status], f["failed"]):
                steps[s] = v
                broken = broken or bool(bad)
        state.update((json.dumps([steps, broken]),))
        shown = {s: "error" if broken and v in ("running", "paused") else v for s, v in steps.items()}
        yield pd.DataFrame({job: [key[0]] * len(shown), step: list(shown), status: list(shown.values())})

    kind = events.schema[job].dataType.simpleString()
    return events.groupBy(job).applyInPandasWithState(run, f"{job} {kind}, {step} string, {status} string", "value string", "update", "NoTimeout")


def append_log(rows: DataFrame, path: str, checkpoint: str):
    """Appends a stream of model calls to a JSON-lines table, as far as there are rows now."""
    return rows.writeStream.format("json").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
