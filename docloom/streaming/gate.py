"""Admission of jobs and their approval by people, over streams of events; all work on batch frames too."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def decisions(requests: DataFrame, approvals: DataFrame, job: str, time: str, by: str, within: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(job, asked, decided, by, outcome): what became of each request for approval, and of each approval.

    requests have job and time, approvals job, time and by. A request is approved by every approval from then on until
    `within` has passed; one without any is timed_out, and an approval that belongs to no such request (too late, too early,
    of no job) is unasked. As a stream this is a join of both with watermarks of `late`: state goes when neither side can
    match any more, and rows without a match come out then. Null jobs match nothing.
    """
    asked = requests.select(F.col(job).alias("job"), F.col(time).alias("asked"))
    said = approvals.select(F.col(job).alias("__job"), F.col(time).alias("decided"), F.col(by).alias("by"))
    if requests.isStreaming or approvals.isStreaming:
        asked, said = asked.withWatermark("asked", late), said.withWatermark("decided", late)
    match = F.expr(f"job = __job and decided >= asked and decided <= asked + interval {within}")
    outcome = F.when(F.col("asked").isNull(), "unasked").when(F.col("decided").isNull(), "timed_out").otherwise("approved")
    return asked.join(said, match, "full_outer").select(F.coalesce("job", "__job").alias("job"), "asked", "decided", "by", outcome.alias("outcome"))


def released(rows: DataFrame, decided: DataFrame, job: str) -> DataFrame:
    """The rows of jobs that were approved: what the steps after the gate work on."""
    return rows.join(decided.where("outcome = 'approved'").select(F.col("job").alias(job)).distinct(), job, "left_semi")


REQUEST, FINISH = "request", "finish"


def admitted(events: DataFrame, key: str, job: str, kind: str, time: str) -> DataFrame:
    """(key, job, time, outcome, active): requests of a key are admitted one at a time; batch frames only.

    A request is admitted if nothing runs (active is then the job itself), else rejected, active being the job that runs.
    Whatever runs ends with the next finish. Equal times go by job, finishes first. One window pass per key.
    """
    order = [time, F.col(kind) == REQUEST, job]
    upto = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    e = events.withColumn("__run", F.sum(F.when(F.col(kind) == FINISH, 1).otherwise(0)).over(upto)).where(F.col(kind) == REQUEST)
    in_run = Window.partitionBy(key, "__run").orderBy(time, job)
    e = e.withColumn("__n", F.row_number().over(in_run)).withColumn("active", F.first(job).over(in_run))
    return e.select(key, job, time, F.when(F.col("__n") == 1, "admitted").otherwise("rejected").alias("outcome"), "active")


class Admission(StatefulProcessor):
    """One running job for each key, with an end set by the watermark if jobs have a lease."""

    def __init__(self, key: str, job: str, kind: str, time: str, job_type: str, lease: timedelta | None):
        self.names, self.job_type, self.lease = (key, job, kind, time), job_type, lease

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.running = handle.getValueState("running", f"job {self.job_type}, until timestamp")

    def _rows(self, key, rows: list[tuple]) -> pd.DataFrame:
        name, job, _, time = self.names
        out = pd.DataFrame(rows, columns=[job, time, "outcome", "active"])
        out.insert(0, name, key)
        return out

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        name, job, kind, time = self.names
        events = pd.concat(rows).assign(_last=lambda f: f[kind] == REQUEST).sort_values([time, "_last", job])
        active, until = self.running.get() if self.running.exists() else (None, None)
        out = []
        for which, what, when in zip(events[job], events[kind], events[time]):
            if active is not None and until is not None and when >= until:
                out.append((active, until, "expired", None))
                active = None
            if what == FINISH:
                active = None
            elif active is None:
                active, until = which, when + self.lease if self.lease else None
                out.append((which, when, "admitted", which))
            else:
                out.append((which, when, "rejected", active))
        self.running.clear()
        if active is not None:
            self.running.update((active, until))
            if until is not None:
                self.handle.registerTimer(int(pd.Timestamp(until).timestamp() * 1000))
        yield self._rows(key[0], out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.running.exists():
            active, until = self.running.get()
            # A timer of a job that ended before does not end the one that runs now.
            if until is not None and pd.Timestamp(until).timestamp() * 1000 <= expiredTimerInfo.getExpiryTimeInMs() + 1:
                out.append((active, until, "expired", None))
                self.running.clear()
        yield self._rows(key[0], out)

    def close(self) -> None:
        pass


def admission(events: DataFrame, key: str, job: str, kind: str, time: str, lease: timedelta | None = None, late: str = "2 hours") -> DataFrame:
    """admitted() for a stream, with state for each key, and jobs that end by themselves after a lease (outcome expired).

    Events of one trigger are taken in order of time, those older than the watermark of `late` are dropped. A job's
    lease ends when an event or the watermark passes it. Needs the RocksDB state store.
    """
    kinds = {c: events.schema[c].dataType for c in (key, job, time)}
    schema = T.StructType([*(T.StructField(c, t) for c, t in kinds.items()), T.StructField("outcome", T.StringType()), T.StructField("active", kinds[job])])
    e = events.select(key, job, kind, time)
    e = e.withWatermark(time, late) if events.isStreaming else e
    machine = Admission(key, job, kind, time, kinds[job].simpleString(), lease)
    return e.groupBy(key).transformWithStateInPandas(machine, schema, "append", "EventTime" if events.isStreaming else "none")
