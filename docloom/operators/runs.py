"""Runs over documents: unique folder names, guarded deletion, observed counts and models that live with their worker."""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

#: States of a job that holds its document.
ACTIVE = ("queued", "running", "awaiting_review")


def stem(name: Column) -> Column:
    """The folder name of an upload: its file name without suffix and forbidden characters, of 90 characters at most."""
    bare = F.regexp_replace(F.regexp_extract(F.coalesce(name, F.lit("")), r"(?s)([^/]*)/*\z", 1), r"(?s)(?<=[^.])\.[^.]+\z", "")
    clean = F.regexp_replace(F.regexp_replace(bare, r'[<>:"/\\|?*\x00-\x1f]+', "_"), r"(?U)\s+", " ")
    clean = F.regexp_replace(clean, r"^[ ._]+|[ ._]+\z", "")
    return F.left(F.when(clean == "", "uploaded_document").otherwise(clean), F.lit(90))


def unique_names(wanted: DataFrame, existing: DataFrame, name: str, time: str, order: list[str]) -> DataFrame:
    """wanted with `folder`: names that neither exist nor repeat, given in order of time and `order`.

    The first to want a free name gets it. Any other gets the name with its time, the next of one second _2, _3 and so on,
    without those that exist (`existing` has a column name). A name is one window group, read in order.
    """
    taken = existing.select(F.col("name").alias("__taken")).distinct()
    by_time = [time, *order]
    w = wanted.withColumn("__n", F.row_number().over(Window.partitionBy(name).orderBy(*by_time)))
    w = w.join(taken, F.col(name) == F.col("__taken"), "left").withColumn("__first", (F.col("__n") == 1) & F.col("__taken").isNull()).drop("__taken", "__n")
    w = w.withColumn("__stamped", F.concat(F.col(name), F.lit("_"), F.date_format(time, "yyyyMMdd_HHmmss")))
    w = w.withColumn("__k", F.when(~F.col("__first"), F.row_number().over(Window.partitionBy("__first", "__stamped").orderBy(*by_time))))
    # Numbers of a stamped name that exist: 1 stands for the name itself. The k-th free one is among the first k plus as many.
    parts = taken.select(F.regexp_extract("__taken", r"(?s)\A(.*_\d{8}_\d{6})(?:_([2-9]|[1-9]\d+))?\z", 1).alias("__of"), F.regexp_extract("__taken", r"(?s)\A.*_\d{8}_\d{6}_([2-9]|[1-9]\d+)\z", 1).alias("__no"))
    used = parts.where("__of <> ''").groupBy("__of").agg(F.collect_set(F.when(F.col("__no") == "", 1).otherwise(F.col("__no").cast("int"))).alias("__used"))
    w = w.join(used, F.col("__stamped") == F.col("__of"), "left")
    free = F.array_except(F.sequence(F.lit(1), F.col("__k") + F.size(F.coalesce("__used", F.array().cast("array<int>")))), F.coalesce("__used", F.array().cast("array<int>")))
    number = F.get(free, F.col("__k") - 1)
    folder = F.when(F.col("__first"), F.col(name)).otherwise(F.concat("__stamped", F.when(number > 1, F.concat(F.lit("_"), number.cast("string"))).otherwise("")))
    return w.select(*wanted.columns, folder.alias("folder"))


def deletions(wanted: DataFrame, documents: DataFrame, jobs: DataFrame, doc: str, status: str = "status") -> DataFrame:
    """(doc, outcome) of each wanted id once: refused while a job of the document is active, missing, or deleted."""
    busy = jobs.where(F.col(status).isin(*ACTIVE)).select(doc).distinct().withColumn("__busy", F.lit(True))
    there = documents.select(doc).distinct().withColumn("__there", F.lit(True))
    j = wanted.select(doc).distinct().join(there, doc, "left").join(busy, doc, "left")
    return j.select(doc, F.when(F.col("__there").isNull(), "missing").when(F.col("__busy"), "refused").otherwise("deleted").alias("outcome"))


def delete_documents(wanted: DataFrame, path: str, jobs: DataFrame, doc: str) -> DataFrame:
    """deletions() carried out on a table partitioned by doc: the folders of what may go are dropped, all others stay.

    The driver sees the ids that go, as many as were asked for.
    """
    from .storage import stored

    spark = wanted.sparkSession
    out = stored(deletions(wanted, spark.read.parquet(path), jobs, doc))
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = top.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    escaped = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    for row in out.where("outcome = 'deleted'").toLocalIterator():
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(top, f"{doc}={escaped(str(row[0]))}"), True)
    spark.catalog.refreshByPath(path)
    return out


def observed(rows: DataFrame, name: str, **counts: Column) -> tuple[DataFrame, Observation]:
    """rows that count themselves as they pass: after an action the observation has n_rows and a sum of each condition."""
    told = Observation(name)
    return rows.observe(told, F.count(F.lit(1)).alias("n_rows"), *(F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).alias(k) for k, c in counts.items())), told


def progress_table(spark: SparkSession, job: str, told: dict[str, Observation]) -> DataFrame:
    """(job, step, metric, value): what the observations of a job's steps have counted, for the progress tables."""
    rows = [(job, step, metric, int(value)) for step, o in told.items() for metric, value in o.get.items()]
    return spark.createDataFrame(rows, "job string, step string, metric string, value long")


class Listener(StreamingQueryListener):
    """Calls back with (query name or id, trigger, rows in, observed metrics) after each trigger, and with the error when a query fails."""

    def __init__(self, progress: Callable[[str, int, int, dict], None], failed: Callable[[str, str], None] | None = None):
        self.progress, self.failed, self.names = progress, failed, {}

    def onQueryStarted(self, event) -> None:
        self.names[str(event.id)] = event.name or str(event.id)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.progress(p.name or str(p.id), p.batchId, p.numInputRows, {k: v.asDict() for k, v in (p.observedMetrics or {}).items()})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.exception and self.failed:
            self.failed(self.names.get(str(event.id), str(event.id)), event.exception)


_MODELS: dict[str, tuple[Hashable, object, int]] = {}


def worker_model(name: str, settings: Hashable, load: Callable[[Hashable], object]) -> tuple[object, int]:
    """(model, loads): the model of this Python worker under a name, loaded when first asked for and again when its settings change."""
    held = _MODELS.get(name)
    if held is None or held[0] != settings:
        _MODELS.pop(name, None)  # the old one may go before the new one is loaded
        held = (settings, load(settings), (held[2] if held else 0) + 1)
        _MODELS[name] = held
    return held[1], held[2]


def modelled(value: Column, name: str, settings: Hashable, load: Callable[[Hashable], Callable[[list], list]], kind: str) -> Column:
    """struct<value, worker, loads>: what the worker's model makes of values, a batch at a time; loads counts in each worker (its process id)."""
    import os

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for values in batches:
            model, loads = worker_model(name, settings, load)
            yield pd.DataFrame({"value": pd.Series(model(values.tolist())), "worker": os.getpid(), "loads": loads})

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, f"value {kind}, worker long, loads long")(value)
