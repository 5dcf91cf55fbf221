"""SimHash near-duplicates with covering locality-sensitive hashing.

Fingerprints link when at most RADIUS bits differ. Every bit position carries a non-zero vector of RADIUS + 1 bits;
for each non-zero vector v there is a table that keeps the bits whose vector has an odd product with v. Any RADIUS
positions leave some v orthogonal to all of their vectors, so every pair within the radius agrees on all kept bits
of at least one table: no pair is missed.

Work is on distinct fingerprints. A bucket with two members is compared at once. In a larger bucket each member
names the fingerprints one free bit away from it; members that name the same one differ in at most two bits, and at
most 65 fingerprints can name it, so such groups are small whatever the bucket's size and no bucket's pairs are listed.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import connected_components, one_of_each, release_memory, small_batches, utf8, written

RADIUS = 2
SEED = 42
BITS = 64


def fingerprint(text: str | None, width: int = 3) -> int:
    """The unsigned fingerprint of a whole text (null: empty); no words: 0."""
    words = utf8(text).lower().split()  # of bytes: A-Z only, split at 0x20 and 0x09-0x0D only
    if not words:
        return 0
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
    digest, n, ones = xxhash.xxh64_digest, 0, np.zeros(BITS, np.int64)
    for run in itertools.batched(shingles, 8192):  # hashes of a long text are never held all at once
        h = np.frombuffer(b"".join([digest(s, SEED) for s in run]), np.uint8).reshape(-1, 8)
        ones += np.unpackbits(h, axis=1).sum(axis=0, dtype=np.int64)
        n += len(run)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def majority(h: np.ndarray) -> int:
    """The unsigned fingerprint of 64-bit hashes (none: 0), each once: bits set in over half of them."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 8192):
        ones += np.unpackbits(h[at : at + 8192].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", width: int = 3):
    """A column of the signed 64-bit fingerprints of docs' texts."""

    @F.pandas_udf("long")
    def measure(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(x, width) for x in texts], np.uint64).astype(np.int64))
        release_memory()

    small_batches(docs)
    return measure(F.col(text))


def masks(radius: int = RADIUS) -> dict[int, int]:
    """Table number -> mask of the kept bits; up to a radius of 5 each keeps about half of the bits."""
    top = (1 << (radius + 1)) - 1
    return {v: sum(1 << i for i in range(BITS) if ((1 + i % top) & v).bit_count() % 2) for v in range(1, top + 1)}


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def links(nodes: DataFrame) -> DataFrame:
    """Edges (u, v) between representatives of distinct fingerprints (fp, rep) that connect all pairs within RADIUS bits."""
    tables = F.explode(F.array(*(F.struct(F.lit(v).alias("table"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for v, m in masks().items()))).alias("t")
    rows = nodes.select("fp", "rep", tables).select("fp", "rep", "t.table", "t.key")
    me = F.struct("fp", "rep")
    buckets = rows.groupBy("table", "key").agg(F.count(F.lit(1)).alias("n"), F.min(me).alias("a"), F.max(me).alias("b")).where("n > 1")
    buckets = written(buckets)
    pairs = buckets.where("n = 2").where(F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= RADIUS).select(F.col("a.rep").alias("u"), F.col("b.rep").alias("v"))

    members = rows.join(buckets.where("n > 2").select("table", "key"), ["table", "key"])
    free = F.element_at(F.create_map(*(x for v, m in masks().items() for x in (F.lit(v), F.array(*(F.lit(signed(1 << i)) for i in range(BITS) if not m >> i & 1))))), F.col("table"))
    near = F.explode(F.concat(F.array("fp"), F.transform(free, lambda bit: F.col("fp").bitwiseXOR(bit)))).alias("near")
    named = members.select("table", near, "rep").groupBy("table", "near").agg(F.collect_set("rep").alias("reps")).where(F.size("reps") > 1)
    stars = named.select(F.array_min("reps").alias("u"), F.explode("reps").alias("v"))
    return pairs.union(stars).where("u <> v")


def components(prints: DataFrame) -> DataFrame:
    """(doc_id, fp) with component_id, the smallest doc_id reachable over links, the document itself included.

    Equal fingerprints link. Rows with a null id link nothing; they get the component of their fingerprint, or null
    if no document with an id has it. Repeated rows stay. An empty table gives an empty result.
    """
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")).where("rep is not null"))
    root = connected_components(links(nodes))
    named = nodes.join(root, nodes["rep"] == root["node"], "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    return prints.join(named, "fp", "left")


def simhash(docs: DataFrame, text: str = "text", id_column: str = "doc_id", width: int = 3) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 lowercase hex digits), component_id.

    Null and empty texts, and texts of white space, have the fingerprint zero and link like any other. A bit that is set
    in just half of the hashes is 0. Very long texts are hashed whole, in runs of shingles. Null ids and repeated rows
    are handled as in components(). Extra columns are dropped, whatever their names. An empty table gives an empty result.
    """
    prints = written(docs.select(F.col(id_column).alias("doc_id"), fingerprints(docs, text, width).alias("fp")))
    return components(prints).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, text: str = "text", id_column: str = "doc_id", width: int = 3) -> DataFrame:
    """docs with one document of each component, the one with the smallest id; rows without an id stay.

    Null and empty texts link like any other, very long texts are read whole. Of repeated rows of one id one stays, that
    with the smallest text hash, in every run. Columns are docs' own, whatever their names; an empty table gives an empty one.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    key, body = names[docs.columns.index(id_column)], names[docs.columns.index(text)]
    found = simhash(plain, body, key, width)
    gone = found.where("doc_id is not null and doc_id <> component_id").select(F.col("doc_id").alias(key)).distinct()
    left = plain.join(gone, key, "left_anti")
    return one_of_each(left, key, body).select(*names).toDF(*docs.columns)


def query(spark, sf_dir):
    """op8: whole `documents`."""
    return simhash(spark.read.parquet(f"{sf_dir}/documents.parquet"))
