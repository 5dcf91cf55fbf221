"""Admission and approval: streams equal batches, leases end by events and by the watermark, late approvals are shown."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from docloom.streaming import gate


@pytest.fixture(scope="module")
def hours(spark, data, tmp_path_factory):
    """A user's events as jobs: files of ten hours each, and a last event far away that moves the watermark."""
    e = spark.read.parquet(f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).where("user_id < 12")
    rows = e.select("user_id", "event_id", "event_type", "ts")
    folder = tmp_path_factory.mktemp("events")
    marks = [r[0] for r in rows.select("ts").orderBy("ts").collect()]
    cuts = [marks[0], marks[len(marks) // 3], marks[2 * len(marks) // 3], marks[-1] + timedelta(seconds=1)]
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        rows.where((F.col("ts") >= a) & (F.col("ts") < b)).coalesce(1).write.parquet(f"{folder}/{k}")
    last = spark.createDataFrame([(99, -1, "signup", datetime(2030, 1, 1)), (99, -2, "purchase", datetime(2030, 1, 1))], rows.schema)
    last.coalesce(1).write.parquet(f"{folder}/9")
    return rows, str(folder)


def stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)


def run(spark, df, name, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(180)
    return spark.table(name)


def test_decisions_of_a_stream_equal_those_of_a_batch(spark, hours, tmp_path):
    rows, folder = hours
    asked, said = (lambda f: f.where("event_type = 'signup'")), (lambda f: f.where("event_type = 'purchase'"))
    args = {"job": "user_id", "time": "ts", "by": "event_id", "within": "20 hours"}
    want = gate.decisions(asked(rows), said(rows), **args)
    live = stream(spark, folder, rows.schema)
    got = run(spark, gate.decisions(asked(live), said(live), **args), "decisions", tmp_path).where("job <> 99")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    outcomes = {r[0] for r in want.select("outcome").distinct().collect()}
    assert outcomes == {"approved", "timed_out", "unasked"}
    approved = {r["job"] for r in want.where("outcome = 'approved'").collect()}
    assert {r["user_id"] for r in gate.released(rows, want, "user_id").collect()} == approved


def test_admission_of_a_stream_equals_that_of_a_batch(spark, hours, tmp_path):
    rows, folder = hours
    kinds = lambda f: f.withColumn("kind", F.when(F.col("event_type").isin("purchase", "error"), gate.FINISH).otherwise(gate.REQUEST))
    want = sorted(map(tuple, gate.admitted(kinds(rows), "user_id", "event_id", "kind", "ts").collect()))
    provider = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        live = gate.admission(kinds(stream(spark, folder, rows.schema)), "user_id", "event_id", "kind", "ts")
        got = run(spark, live, "admission", tmp_path).where("user_id <> 99")
        assert sorted(map(tuple, got.collect())) == want
        # With a lease of two hours, jobs also end by themselves.
        lease = timedelta(hours=2)
        live = gate.admission(kinds(stream(spark, folder, rows.schema)), "user_id", "event_id", "kind", "ts", lease)
        got = sorted(map(tuple, run(spark, live, "leases", tmp_path).where("user_id <> 99").collect()), key=str)
    finally:
        spark.conf.unset(provider)
    by_hand = []
    for user in {r["user_id"] for r in rows.collect()}:
        active = None
        for r in sorted(kinds(rows).where(F.col("user_id") == user).collect(), key=lambda r: (r["ts"], r["kind"] == gate.REQUEST, r["event_id"])):
            if active and r["ts"] >= active[1] + lease:
                by_hand.append((user, active[0], active[1] + lease, "expired", None))
                active = None
            if r["kind"] == gate.FINISH:
                active = None
            elif active is None:
                active = (r["event_id"], r["ts"])
                by_hand.append((user, r["event_id"], r["ts"], "admitted", r["event_id"]))
            else:
                by_hand.append((user, r["event_id"], r["ts"], "rejected", active[0]))
        if active:
            by_hand.append((user, active[0], active[1] + lease, "expired", None))
    assert got == sorted(by_hand, key=str)


def test_ties_and_empty_tables(spark):
    t = datetime(2024, 1, 1)
    kind = "k string, job string, kind string, ts timestamp"
    rows = [("a", "j1", "request", t), ("a", "j2", "request", t), ("a", None, "finish", t + timedelta(1)), ("a", "j3", "request", t + timedelta(1)), (None, "j4", "request", t)]
    got = {(r["k"], r["job"]): (r["outcome"], r["active"]) for r in gate.admitted(spark.createDataFrame(rows, kind), "k", "job", "kind", "ts").collect()}
    assert got == {("a", "j1"): ("admitted", "j1"), ("a", "j2"): ("rejected", "j1"), ("a", "j3"): ("admitted", "j3"), (None, "j4"): ("admitted", "j4")}
    assert gate.admitted(spark.createDataFrame([], kind), "k", "job", "kind", "ts").count() == 0
    e = spark.createDataFrame([(None, t, "x")], "job string, ts timestamp, by string")
    assert {(r["asked"], r["outcome"]) for r in gate.decisions(e, e, "job", "ts", "by").collect()} == {(t, "timed_out"), (None, "unasked")}
