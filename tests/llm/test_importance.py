"""Importance resampling against plain Python, and at its edges."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docloom.llm import importance

DOCS = "doc_id long, text string"


def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, [zlib.crc32(x.encode()) % 10000 for x in words + [f"{a} {b}" for a, b in zip(words, words[1:])]]


def by_hand(docs, target):
    s, t = Counter(b for _, x in docs for b in features(x)[1]), Counter(b for x in target for b in features(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000)))) for b in range(10000)]
    rows = []
    for i, x in docs:
        words, f = features(x)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words) >= 20))
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = Counter()
    out = []
    for rank, r in enumerate(able, 1):
        out.append((*r[:4], rank if rank <= 25 * len(able) // 100 else None))
    return sorted(out + [(*r[:4], None) for r in rows if not r[4]], key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    words = "Alpha beta GAMMA delta épsilon ζeta x1 2 the of and to river House".split()
    docs = [(i, rng.choice([" ", ", ", "\n"]).join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(160)]
    docs += [(200, None), (201, ""), (202, "...!"), (203, "word " * 50_000), (204, "x" * 100_000), (205, "one"), (None, docs[3][1]), (None, docs[4][1])]
    return docs + [docs[5]] * 7 + [docs[6]] * 40


TARGET = ["the river and the House", None, "", "delta épsilon of the river"]


def got(frame):
    return sorted((tuple(r) for r in frame.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def test_equals_plain_python(spark, rows):
    docs, target = spark.createDataFrame(rows, DOCS), spark.createDataFrame([(x,) for x in TARGET], "text string")
    want = by_hand(rows, TARGET)
    assert got(importance.resample(docs, target)) == want
    assert got(importance.resample(docs.repartition(7), target)) == want
    clash = docs.withColumns({c: F.lit(1) for c in ("id", "n_words", "score", "rank", "place", "at", "slice", "before", "bucket", "n")})
    assert got(importance.resample(clash, target)) == want
    drawn = importance.draw(clash, target)
    assert drawn.columns == [*clash.columns, "_rank"]
    assert {r["doc_id"] for r in drawn.collect()} == {r[0] for r in want if r[4] is not None and r[0] is not None}


def test_empty_tables(spark, rows):
    none, docs = spark.createDataFrame([], DOCS), spark.createDataFrame(rows, DOCS)
    assert importance.resample(none, docs).count() == 0
    assert got(importance.resample(docs, none)) == by_hand(rows, [])


def test_every_feature_has_its_bucket():
    import pyarrow as pa

    texts = ["A b A b", None, "", "Ünï Ünï\x00z", "zero 0-9 [k]"]
    words, owner, runs = importance.buckets_of(pa.array(texts, pa.string()))
    for i, x in enumerate(texts):
        w, f = features(x)
        assert words[i] == len(w) and sorted(runs[owner == i]) == sorted(f)
