"""Importance resampling toward a target: hashed runs of words are compared with a target's, and Gumbel noise draws documents.

A document's words become dictionary indices through Arrow kernels; shifted indices form pairs, so that a CRC is taken
once per distinct word and pair of a batch, and the buckets of all runs are gathered from there. The tables that cross
tasks have one row per bucket. Ranks come from a range partitioning by score, without one task that sees all rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, release_memory, small_batches, written

#: Words are what stands between these, once A-Z are lower case.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS, SHARE, MIN_WORDS, SEED = 10_000, 25, 20, 7


def buckets_of(texts: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text, owner of each feature, bucket of each feature); features are words, then pairs of words.

    A feature's bucket is the unsigned CRC-32 of its UTF-8 bytes modulo `buckets`. Null texts have no words.
    """
    n = len(texts)
    parts = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), SEPARATORS)
    flat, owner = pc.list_flatten(parts), pc.list_parent_indices(parts)
    solid = pc.not_equal(flat, "")
    owner = owner.filter(solid).to_numpy().astype(np.int64)
    coded = pc.dictionary_encode(flat.filter(solid))
    index = coded.indices.to_numpy().astype(np.int64)
    vocabulary = coded.dictionary.cast(pa.large_binary()).to_pylist()
    size = max(len(vocabulary), 1)
    single = np.fromiter(map(zlib.crc32, vocabulary), np.int64, len(vocabulary))
    heads = [zlib.crc32(b" ", x) for x in single.tolist()]
    inside = owner[:-1] == owner[1:]
    pairs = pc.dictionary_encode(pa.array((index[:-1] * size + index[1:])[inside]))
    left, right = (x.tolist() for x in np.divmod(pairs.dictionary.to_numpy(), size))
    double = np.fromiter((zlib.crc32(vocabulary[r], heads[x]) for x, r in zip(left, right)), np.int64, len(left))
    runs = np.concatenate([single[index], double[pairs.indices.to_numpy()]]) % buckets
    return np.bincount(owner, minlength=n), np.concatenate([owner, owner[:-1][inside]]), runs


def bucket_counts(docs: DataFrame, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): features of all texts by bucket; a task adds its own up first, buckets without a feature are left out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(buckets_of(batch.column(0), buckets)[2], minlength=buckets)
        release_memory()
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(total[hit])], ["bucket", "n"])

    rows = small_batches(docs.select(F.col(text).cast("string")))
    return rows.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket, floor(1000 ln) of the ratio of its smoothed shares; the driver sees one row per bucket."""
    seen = np.zeros((2, buckets))
    for row, (frame, column) in enumerate(((docs, text), (target, target_text))):
        for bucket, n in bucket_counts(frame, column, buckets).collect():
            seen[row, bucket] = n
    (s, t), (all_s, all_t) = seen, seen.sum(axis=1)
    ratio = (t + 1) * (all_s + buckets) / ((s + 1) * (all_t + buckets))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, text: str = "text") -> DataFrame:
    """docs with n_words, n_features and weight, the floored mean gain of a text's features (0 without any), instead of the text."""
    names = [c for c in docs.columns if c != text]
    schema = docs.select(*names).schema
    for name in ("n_words", "n_features", "weight"):
        schema = schema.add(name, "long")
    table = pa.array(gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, owner, runs = buckets_of(batch.column(batch.num_columns - 1), len(gain))
            values = table.take(pa.array(runs)).to_numpy()
            order = np.argsort(owner, kind="stable")
            features = words + np.maximum(words - 1, 0)
            weight = np.zeros(len(words), np.int64)
            some = np.flatnonzero(words)
            if len(some):
                starts = (np.cumsum(features) - features)[some]
                weight[some] = np.add.reduceat(values[order], starts) // features[some]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, (words.astype(np.int64), features.astype(np.int64), weight))], [*names, "n_words", "n_features", "weight"])
        release_memory()

    return small_batches(docs.select(*names, F.col(text).cast("string"))).mapInArrow(weigh, schema)


def noise(id_column: str, seed: int = SEED):
    """floor(-1000 ln(-ln u)): a Gumbel variable fixed by seed and id, u from the first 8 hex digits of sha256('seed:id')."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit(""))), 256), 1, 8)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296
    return F.floor(-1000 * F.log(-F.log(u)))


def ranked(scored: DataFrame, share: int = SHARE, min_words: int = MIN_WORDS) -> DataFrame:
    """scored (id, n_words, score) with rank: 1, 2, ... for the floor(share * N / 100) highest scores of the N rows of min_words words.

    Ties go to the smaller id, null ids last; equal rows have ranks of their own. Rows are sorted by ranges (equal ones
    are dealt out by their places in the input), numbered in each and moved on by the counts of earlier ranges.
    """
    able = F.col("n_words") >= min_words
    scored = written(scored.withColumn("place", F.monotonically_increasing_id()))
    drawn = share * scored.where(able).count() // 100
    order = [able.desc(), F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("place")]
    dealt = written(scored.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    slice_of, inside = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    before, starts = 0, []
    for k, n in sorted(tuple(r) for r in dealt.groupBy(slice_of.alias("slice")).count().collect()):  # one row per partition
        starts.append((k, before))
        before += n
    starts = dealt.sparkSession.createDataFrame(starts, "slice long, before long")
    rank = F.col("before") + inside + 1
    numbered = dealt.withColumn("slice", slice_of).join(F.broadcast(starts), "slice")
    return numbered.withColumn("rank", F.when(able & (rank <= drawn), rank)).drop("slice", "before", "at", "place")


def resample(
    docs: DataFrame, target: DataFrame, text: str = "text", id_column: str = "doc_id", target_text: str = "text", share: int = SHARE, min_words: int = MIN_WORDS, buckets: int = BUCKETS, seed: int = SEED
) -> DataFrame:
    """One row per document: doc_id, n_features, weight, score, rank (null for a document that is not drawn), all but doc_id long.

    Null and empty texts have no features and weight 0, and are not drawn, as all texts of fewer than min_words words.
    Very long texts are read whole. Ties in score go to the smaller doc_id, a null id (which counts as an empty one in
    the noise) last; repeated rows are documents of their own with ranks of their own. An empty target gives gains by the documents alone;
    an empty table an empty result. Other columns are left out, whatever their names.
    """
    rows = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    scored = weighed(rows, gains(docs, target, text, target_text, buckets)).withColumn("score", F.col("weight") + noise("id", seed))
    return ranked(scored, share, min_words).select(F.col("id").alias("doc_id"), "n_features", "weight", "score", F.col("rank").cast("long"))


def draw(docs: DataFrame, target: DataFrame, text: str = "text", id_column: str = "doc_id", **settings) -> DataFrame:
    """The drawn documents with all their columns and a column rank (or _rank, if docs has one), edge cases as in resample().

    Rows without an id can not be told apart and are left out; of rows of one id all stay if one is drawn, at its best rank.
    """
    name = fresh(docs.columns, "rank")
    key = fresh([*docs.columns, name], "drawn_id")
    best = resample(docs, target, text, id_column, **settings).where("rank is not null and doc_id is not null").groupBy(F.col("doc_id").alias(key)).agg(F.min("rank").alias(name))
    return docs.join(best, F.col(id_column) == F.col(key)).drop(key)


def query(spark, sf_dir):
    """op12: whole `documents` against whole `benchmark`."""
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: DuckDB has no CRC-32: a recursion takes one byte of all distinct features a step, through the table of 256 remainders.
ORACLE = r"""
with recursive w as (
    select 0 as side, row_number() over () as k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from documents
    union all select 1, row_number() over (), null, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') from benchmark),
f as materialized (select side, k, unnest(list_concat(words, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))) as feature from w),
bits(v, x, i) as (select v, v, 0 from range(256) t(v) union all select v, case when x % 2 = 1 then xor(x // 2, 3988292384) else x // 2 end, i + 1 from bits where i < 8),
remainders as materialized (select v, x from bits where i = 8),
crc(feature, h, i, c) as (
    select feature, hex(encode(feature)), 0, 4294967295::bigint from (select distinct feature from f)
    union all select feature, h, i + 1, xor(r.x, c // 256) from crc join remainders r on r.v = xor(c % 256, ('0x' || substr(h, 2 * i + 1, 2))::bigint) where 2 * i < length(h)),
b as materialized (select feature, xor(c, 4294967295) % 10000 as bucket from crc where 2 * i = length(h)),
n as (select bucket, count(*) filter (side = 0) as s, count(*) filter (side = 1) as t from f join b using (feature) group by bucket),
g as (select bucket, floor(1000 * ln((t + 1)::double * (sum(s) over () + 10000)::double / ((s + 1)::double * (sum(t) over () + 10000)::double)))::bigint as gain from n),
d as (select k, sum(gain) as total, count(*) as n_features from f join b using (feature) join g using (bucket) where side = 0 group by k),
s as (select doc_id, coalesce(n_features, 0)::bigint as n_features, coalesce(floor(total / n_features), 0)::bigint as weight, len(words) as n_words, ('0x' || substr(sha256('7:' || doc_id), 1, 8))::bigint as h from w left join d using (k) where side = 0),
z as (select *, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::bigint as score from s),
r as (select *, row_number() over (partition by n_words >= 20 order by score desc, doc_id) as rank, count(*) filter (n_words >= 20) over () as able from z)
select doc_id, n_features, weight, score, case when n_words >= 20 and rank <= 25 * able // 100 then rank end::bigint as rank from r
"""
