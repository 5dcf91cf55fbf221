"""The file store, folder names, deletions, observations and models of workers."""

import json
import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from docloom.operators import runs
from docloom.sources import store

KIND = "doc_id string, file_name string, content binary"


def listed(spark, path):
    return sorted((r["doc_id"] or "", r["file_name"], bytes(r["content"])) for r in store.load(spark, path).collect())


def test_store_returns_what_was_written(spark, tmp_path):
    path = str(tmp_path / "s")
    rows = [("a", "x.tar.gz", b"1"), ("a", "x.tar.gz", b"2"), ("a", "x_2.tar.gz", b"3"), ("b/../c", "y.txt", b""), ("é %", "", b"z"), (None, "n.txt", None)]
    store.save(spark.createDataFrame([(d, n, None if c is None else bytearray(c)) for d, n, c in rows], KIND).repartition(3), path)
    assert listed(spark, path) == sorted([("a", "x.tar.gz", b"1"), ("a", "x_2.tar.gz", b"2"), ("a", "x_2_2.tar.gz", b"3"), ("b/../c", "y.txt", b""), ("é %", "asset.bin", b"z"), ("", "n.txt", b"")])
    store.save(spark.createDataFrame([("a", "x.tar.gz", bytearray(b"4")), ("b/../c", "note.md", bytearray(b"m"))], KIND), path)
    assert ("a", "x_3.tar.gz", b"4") in listed(spark, path)
    # Only files of the given kinds go, and only those of documents that are written.
    store.save(spark.createDataFrame([("b/../c", "new.json", bytearray(b"{}"))], KIND), path, overwrite=True, clear=".txt,.json")
    assert [x for x in listed(spark, path) if x[0] == "b/../c"] == [("b/../c", "new.json", b"{}"), ("b/../c", "note.md", b"m")]
    assert len([x for x in listed(spark, path) if x[0] == "a"]) == 4
    store.save(spark.createDataFrame([("a", "only.txt", bytearray(b"o"))], KIND), path, overwrite=True)
    assert [x for x in listed(spark, path) if x[0] == "a"] == [("a", "only.txt", b"o")]
    assert not [x for x in os.listdir(path) if x.startswith("_staging")]
    assert store.load(spark, str(tmp_path / "none")).count() == 0


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "s")
    store.save(spark.createDataFrame([("a", "x.txt", bytearray(b"old"))], KIND), path)
    bad = spark.range(20).repartition(4).select(F.lit("a").alias("doc_id"), F.lit("x.txt").alias("file_name"), F.when(F.col("id") == 13, F.raise_error(F.lit("no")).cast("string")).otherwise("new").alias("content"))
    for overwrite in (False, True):
        with pytest.raises(Exception):
            store.save(bad, path, overwrite=overwrite)
        assert listed(spark, path) == [("a", "x.txt", b"old")] and not [x for x in os.listdir(path) if x.startswith("_staging")]


def test_maps_of_parsed_files(spark, tmp_path):
    from docloom.plans.source_queries import region_files
    from docloom.sources import ooxml

    parsed = ooxml.parse(region_files(spark, "/root/testdata/sf0.001").union(spark.createDataFrame([("bad", bytearray(b"no"))], "doc_id string, content binary")))
    made = {(r["doc_id"], r["file_name"]): r["content"] for r in store.maps(parsed).collect()}
    assert len(made) == 15
    cells = json.loads(made["ASIA", "cell_map.json"])
    assert cells["CL000001"]["text"] == "ASIA" and made["ASIA", "cell_map.json"].startswith('{\n  "CL000001": {\n    "table_id": "TB000001"')


def test_unique_names(spark):
    t = datetime(2024, 5, 1, 10, 0, 0)
    rows = [(1, "a", t), (2, "a", t), (3, "a", t), (4, "b", t), (5, "b", t), (6, "c", t)]
    existing = spark.createDataFrame([("b",), ("a_20240501_100000",), ("a_20240501_100000_3",), ("b_x",)], "name string")
    got = {r["id"]: r["folder"] for r in runs.unique_names(spark.createDataFrame(rows, "id int, name string, at timestamp"), existing, "name", "at", ["id"]).collect()}
    assert got == {1: "a", 2: "a_20240501_100000_2", 3: "a_20240501_100000_4", 4: "b_20240501_100000", 5: "b_20240501_100000_2", 6: "c"}
    stems = spark.createDataFrame([("in/My  file?.docx",), ("..",), (None,), ("x" * 200 + ".docx",), ("a.b.docx",), (".docx",)], "n string").select(runs.stem(F.col("n"))).collect()
    assert [r[0] for r in stems] == ["My file_".rstrip("_"), "uploaded_document", "uploaded_document", "x" * 90, "a.b", "docx"]


def test_deletion_keeps_active_and_other_documents(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([("a b", 1), ("c=d", 2), ("e", 3), ("f", 4)], "doc string, v int").write.partitionBy("doc").parquet(path)
    jobs = spark.createDataFrame([("e", "running"), ("c=d", "done"), ("a b", "failed")], "doc string, status string")
    wanted = spark.createDataFrame([("a b",), ("c=d",), ("e",), ("g",), ("e",)], "doc string")
    assert {tuple(r) for r in runs.delete_documents(wanted, path, jobs, "doc").collect()} == {("a b", "deleted"), ("c=d", "deleted"), ("e", "refused"), ("g", "missing")}
    assert {r["doc"] for r in spark.read.parquet(path).collect()} == {"e", "f"}


def test_observed_counts_and_listener(spark, tmp_path):
    rows, told = runs.observed(spark.range(10), "steps", even=F.col("id") % 2 == 0)
    rows.write.format("noop").mode("overwrite").save()
    got = {(r["metric"], r["value"]) for r in runs.progress_table(spark, "j", {"s": told}).collect()}
    assert got == {("n_rows", 10), ("even", 5)}
    spark.range(8).write.parquet(str(tmp_path / "in"))
    seen = []
    listener = runs.Listener(lambda name, trigger, n, metrics: seen.append((name, n, metrics)))
    spark.streams.addListener(listener)
    try:
        live, _ = spark.readStream.schema("id long").parquet(str(tmp_path / "in")), None
        live = live.observe("told", F.count(F.lit(1)).alias("n"), F.max("id").alias("top"))
        q = live.writeStream.format("noop").queryName("watched").trigger(availableNow=True).start()
        q.awaitTermination(60)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    finally:
        spark.streams.removeListener(listener)
    assert ("watched", 8, {"told": {"n": 8, "top": 7}}) in seen


def test_a_model_is_loaded_once_in_each_worker(spark):
    def load(settings):
        return lambda values: [v * settings for v in values]

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
    try:
        for settings in (3, 3, 5):
            out = spark.range(0, 400, 1, 8).select("id", runs.modelled(F.col("id"), "m", settings, load, "long").alias("x")).select("id", "x.*").collect()
            assert all(r["value"] == settings * r["id"] for r in out)
            loads = {}
            for r in out:
                loads[r["worker"]] = max(loads.get(r["worker"], 0), r["loads"])
            assert all(n <= (1 if settings == 3 else 2) for n in loads.values())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_files_are_named_and_moved_by_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store.Writer, "commit", lambda *_: pytest.fail("the driver names no files"))
    n, path = 3000, str(tmp_path / "s")
    store.save(spark.range(n).selectExpr("'a' as doc_id", "'x.txt' as file_name", "cast(id as string) as content").union(spark.range(1).selectExpr("'b'", "'_.y'", "'z'")), path)
    found = store.load(spark, path).collect()
    assert sorted(r["file_name"] for r in found if r["doc_id"] == "a") == sorted(["x.txt", *(f"x_{k}.txt" for k in range(2, n + 1))])
    assert {bytes(r["content"]) for r in found if r["doc_id"] == "a"} == {str(k).encode() for k in range(n)}
    assert [(r["file_name"], bytes(r["content"])) for r in found if r["doc_id"] == "b"] == [("_.y", b"z")]


def test_a_name_that_many_files_want_is_found_at_once():
    from docloom.sources.ole import free_name

    class Taken(set):
        looks = 0

        def __contains__(self, x):
            self.looks += 1
            return super().__contains__(x)

    taken, tried = Taken({"x_3.txt"}), {}
    for k in range(2000):
        taken.add(free_name("x.txt", taken, tried))
    assert len(taken) == 2001 and {"x.txt", "x_2.txt", "x_2001.txt"} <= taken and taken.looks < 5000
