"""One row of each id, the same in every run, and the near-duplicate stages at their edges."""

import hashlib

import pytest
from pyspark.sql import functions as F

from docloom.llm import common, near_copies, simhash

DOCS = "doc_id long, text string, of string, several int, kept int"
LONG = "word " * 60_000
ROWS = [(1, f"text {i}", None, i, 0) for i in range(40)] + [(2, None, "a", 1, 1), (2, None, "b", 2, 1), (3, "", "x", 0, 0), (4, LONG, None, 0, 0), (5, LONG + "x", None, 0, 0), (None, "n", None, 0, 0), (None, "n", None, 0, 0)]


def smallest(texts):
    return min(texts, key=lambda x: hashlib.sha256((x or "").encode()).hexdigest())


def test_one_of_each_is_the_same_in_every_run(spark, monkeypatch):
    docs = spark.createDataFrame(ROWS, DOCS)
    runs = [sorted(map(str, common.one_of_each(docs.repartition(n), "doc_id", "text").collect())) for n in (1, 5)]
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(common, "DEAL_ROWS", 6)
    runs.append(sorted(map(str, common.one_of_each(docs, "doc_id", "text").collect())))
    assert runs[0] == runs[1] == runs[2]
    out = common.one_of_each(docs, "doc_id", "text")
    assert out.columns == docs.columns
    kept = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert sorted(k for k, _ in kept if k) == [1, 2, 3, 4, 5] and kept.count((None, "n")) == 2
    assert dict(kept)[1] == smallest(f"text {i}" for i in range(40))


@pytest.mark.parametrize("keep, repeats", [(near_copies.keep_one, False), (simhash.keep_one, True)])
def test_stages_at_their_edges(spark, keep, repeats):
    docs = spark.createDataFrame(ROWS, DOCS)
    kept = keep(docs)
    assert kept.columns == docs.columns
    ids = sorted(r["doc_id"] for r in kept.where(F.col("doc_id").isNotNull()).collect())
    assert 2 in ids and 3 not in ids and 4 in ids  # empty like null
    assert (5 in ids) != repeats  # one more shingle of two, or of 60,000 with repeats
    assert kept.where("doc_id is null").count() == 2
    assert keep(spark.createDataFrame([], DOCS)).count() == 0
