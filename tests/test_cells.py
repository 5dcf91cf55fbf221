"""Search by cells: exact answers equal brute force, approximate ones have the recall that was asked for."""

import numpy as np
import pytest

from docloom.operators import cells, vectors


def brute(rows, queries, k):
    keys, m = [r[0] for r in rows], cells.unit((r[1] for r in rows), 8)
    out = set()
    for q, v in queries:
        s = np.round(cells.unit([v], 8) @ m.T, 12)[0]
        for rank, i in enumerate(sorted(range(len(keys)), key=lambda i: (-s[i], keys[i]))[:k], 1):
            out.add((q, keys[i], s[i], rank))
    return out


@pytest.fixture(scope="module")
def rows():
    """Clusters, a third of all rows in one point, null and zero vectors."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8))
    out = [(i, (centres[i % 6] + rng.normal(scale=0.3, size=8)).tolist()) for i in range(240)]
    out += [(i, centres[0].tolist()) for i in range(240, 380)]
    return out + [(380, [0.0] * 8), (381, None), (382, [1e-3] * 8)]


def test_exact_search_equals_brute_force(spark, rows, monkeypatch):
    monkeypatch.setattr(cells, "BLOCK_ROWS", 50)  # the hot cell in blocks
    monkeypatch.setattr(cells, "BLOCK_QUERIES", 8)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    index = cells.build(frame)
    assert index.rows.count() == len(rows) and index.table.agg({"blocks": "max"}).first()[0] > 1
    asked = [(f"q{i}", v) for i, v in rows[::9]] + [("zero", [0.0] * 8), ("null", None)]
    queries = spark.createDataFrame(asked, "query string, embedding array<float>")
    for probes in (1, 3):
        got = {tuple(r) for r in cells.search(index, queries, 7, probes=probes, exact=True).select("query", "vec_id", "score", "rank").collect()}
        want = brute([(i, None if v is None else np.float32(v)) for i, v in rows], [(q, None if v is None else np.float32(v)) for q, v in asked], 7)
        assert {(q, i, r) for q, i, _, r in got} == {(q, i, r) for q, i, _, r in want}
    assert cells.search(index, queries.limit(0), 5, exact=True).count() == 0


def test_recall_of_tuned_probes(spark, data):
    """Random directions, the hardest case: the probes that 100 rows need give all others 0.9 of their neighbours too."""
    big = data.replace("sf0.001", "sf0.1")
    e = spark.read.parquet(f"{big}/embeddings.parquet")
    queries = e.where("vec_id % 20 = 0").selectExpr("vec_id as query", "embedding")
    index = cells.build(e)
    probes = cells.tuned(index)
    near = {(r["query"], r["vec_id"]) for r in cells.search(index, queries, 12, probes).collect()}
    true = {(r["query"], r["vec_id"]) for r in vectors.search_all(e, queries, 12).collect()}
    assert probes < index.table.count() and len(near & true) / len(true) >= 0.9


def test_edges(spark):
    kind = "vec_id long, embedding array<float>"
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query long, embedding array<float>")
    assert cells.search(cells.build(spark.createDataFrame([], kind)), queries, 3).count() == 0
    nothing = cells.build(spark.createDataFrame([(1, None), (2, None)], kind))
    assert {(r["vec_id"], r["score"]) for r in cells.search(nothing, queries, 3, exact=True).collect()} == {(1, 0.0), (2, 0.0)}
    assert cells.tuned(cells.build(spark.createDataFrame([(1, [1.0, 2.0])], kind))) == 1


def test_a_task_looks_at_few_queries_at_a_time():
    import tracemalloc
    from types import SimpleNamespace as Space

    import pandas as pd
    from pyspark.sql import types as T

    rng = np.random.default_rng(3)
    sample = cells.unit(rng.normal(size=(20000, 8)))
    tracemalloc.start()
    centroids = cells.fit(sample, 400)
    assert tracemalloc.get_traced_memory()[1] < 50e6  # 64 MB alone for the scores of all
    fields = T.StructType([T.StructField("query", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])
    context = Space(broadcast=lambda x: Space(value=x))
    queries = Space(sparkSession=Space(sparkContext=context), columns=["query", "embedding"], schema=fields, mapInPandas=lambda look, _: look)
    index = Space(centroids=centroids, table=Space(collect=lambda: [{"cell": k, "radius": 0.5} for k in range(400)]))
    look = cells.probed(index, queries, 400)
    n, seen = 0, set()
    tracemalloc.reset_peak()
    for part in look([pd.DataFrame({"query": range(3000), "embedding": list(sample[:3000])})]):
        assert len(part) <= cells.SCORES
        n, seen = n + len(part), seen | set(part["query"])
    assert n == 3000 * 400 and len(seen) == 3000 and tracemalloc.get_traced_memory()[1] < 60e6
    tracemalloc.stop()
