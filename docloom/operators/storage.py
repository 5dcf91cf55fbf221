"""Cutting lineage: tables written between the steps of an iteration, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session, else the folder set on the context; a local master without either gets one of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not named and context.getCheckpointDir() is None:
        if context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="docloom-"))
    return (named or context.getCheckpointDir()).rstrip("/")


def scratch(spark: SparkSession, name: str = "step") -> str:
    """A new path in the shared folder; what is written there goes when the driver's JVM ends."""
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    files.mkdirs(path)  # only what exists can be marked
    files.deleteOnExit(path)
    return f"{folder}/data"


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet in the shared folder and read again: lost executors repeat one step. The files go when the driver's JVM ends."""
    target = scratch(df.sparkSession)
    df.write.parquet(target)
    return df.sparkSession.read.schema(df.schema).parquet(target)
