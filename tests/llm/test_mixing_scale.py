"""Mixing: ranges around the cut, null ids, repeated rows."""

import pytest
from pyspark.sql import functions as F

from docloom.llm import mixing


@pytest.fixture(scope="module")
def sizes(spark):
    d = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("source"), (1 + F.pmod(F.xxhash64("id"), F.lit(50))).alias("size"))
    return d.withColumn("place", F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 12), 16, 10).cast("long"))


@pytest.mark.parametrize("slots,few", [(2, 1), (3, 10), (64, 100)])
def test_narrowed_ranges_give_the_same_cut(sizes, monkeypatch, slots, few):
    want = sorted(map(tuple, mixing.mix(sizes).collect()))
    monkeypatch.setattr(mixing, "SLOTS", slots)
    monkeypatch.setattr(mixing, "FEW", few)
    # Slots of the prefix sums come from the place's upper bits and stay as they are.
    assert sorted(map(tuple, mixing.mix(sizes).collect())) == want


def test_null_ids_and_repeated_rows(spark):
    """Null ids are placed by their texts; repeated rows are taken alike, and reruns agree."""
    rows = [(None, f"text number {i} " * 5, "s") for i in range(200)] + [(7, "same text here", "s")] * 30 + [(8, None, None), (9, "", "t")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({x: F.lit(1) for x in ("size", "place", "taken", "__n", "target")})
    assert mixing.sized(d).where("doc_id is null").select("place").distinct().count() == 200
    once, again = (sorted(map(str, mixing.take(x).collect())) for x in (d, d.repartition(5)))
    assert once == again and mixing.take(d).columns == d.columns
    assert 1.3 < sum(len(r.split("text number")) - 1 for r in once) / (200 * 5) < 1.7
