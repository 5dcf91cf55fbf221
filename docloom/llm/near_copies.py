"""Near copies by SimHash over shingles of five words: texts link when the Jaccard similarity of their shingle sets is 0.8 or more.

Each distinct shingle set has a SimHash fingerprint, and covering masks as in simhash.py, for RADIUS bits here, bring every
pair that differs in at most RADIUS bits into a common bucket. Pairs of similarity 0.8 differ in about ten bits of 64, which
no affordable number of masks covers, so that pairs beyond the radius meet by min-hashing in BANDS bands of ROWS values: one
of similarity s shares no band with a probability of (1 - s^ROWS)^BANDS, at most 3.1e-6 at 0.8, 3e-9 at 0.85. Every pair that
meets is then compared exactly, so that no other pair links; but for that probability, beyond the radius, no pair is left out.

Work is on distinct shingle sets. The members of a bucket, of either kind, follow its lead, the one that shares most with others, so that
the buckets of one group of copies have one lead and each set goes to it once. A lead's followers meet in one task, or
in pairs of blocks of BLOCK shingles if they are many. There all are compared with the lead first, and those that do not
link to it with all others; no pair is listed, only links that connect what belongs together leave the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, mix64, one_of_each, release_memory, small_batches, written
from .fingerprints import terms
from .simhash import majority, masks, signed

LEAST = 0.8
#: Bits in which fingerprints may differ so that the covering masks (63 of 32 or 33 bits) find the pair for certain.
RADIUS = 5
BANDS, ROWS = 32, 5
#: Shingles of a block of followers of one lead; a task holds two blocks.
BLOCK = 400_000
#: Shingles whose columns are multiplied at a time.
COLUMNS = 2048
_BLOCK = 8192
_ODD = mix64(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) << np.uint64(20)) | np.uint64(1)
_FLIP = mix64(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) << np.uint64(40))


def _node(h: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(h.astype("<u8").tobytes()) - (1 << 63)


def bands(h: np.ndarray) -> np.ndarray:
    """A hash for each band of a shingle set; nothing for an empty set."""
    if not len(h):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(h), _BLOCK):
            least = np.minimum(least, ((h[None, at : at + _BLOCK] ^ _FLIP[:, None]) * _ODD[:, None]).min(axis=1))
        out = np.arange(1, BANDS + 1, dtype=np.uint64)
        for values in least.reshape(BANDS, ROWS).T:
            out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + values)
    return out.view(np.int64)


def _sketch(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        sets = [terms(x)[0] for x in texts]
        yield pd.DataFrame({"node": pd.Series([_node(h) for h in sets], dtype="int64"), "size": pd.Series([len(h) for h in sets], dtype="int64"), "fp": pd.Series(np.array([majority(h) for h in sets], np.uint64).astype(np.int64)), "bands": [bands(h) for h in sets]})
    release_memory()


def _shingles(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        sets = [terms(x)[0] for x in texts]
        yield pd.DataFrame({"node": pd.Series([_node(h) for h in sets], dtype="int64"), "shingles": [h.view(np.int64) for h in sets]})
    release_memory()


def links(sets: list[np.ndarray], lead: int) -> list[tuple[int, int]]:
    """Pairs of places in `sets` (arrays of distinct shingles) that connect all pairs of a similarity of LEAST or more, in whole numbers."""
    size = np.array([len(x) for x in sets])
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    term = np.unique(np.concatenate(sets), return_inverse=True)[1]
    tenths = round(LEAST * 10)
    near = lambda shared, a, b: shared * 10 >= (a + b - shared) * tenths

    hit = np.zeros(int(term.max()) + 1, np.int64)
    hit[term[start[lead] : start[lead] + size[lead]]] = 1
    linked = near(np.add.reduceat(hit[term], start), size, size[lead])
    out = [(lead, i) for i in np.flatnonzero(linked).tolist() if i != lead]
    alone = np.flatnonzero(~linked)
    if len(alone) and len(sets) > 2:
        # Only shingles of several sets count; the products of their columns are summed up in parts.
        several = np.bincount(term) > 1
        place = np.cumsum(several) - 1
        own = np.repeat(np.arange(len(sets)), size)[several[term]]
        column = place[term[several[term]]]
        order = np.argsort(column, kind="stable")
        own, column = own[order], column[order]
        shared = np.zeros((len(alone), len(sets)), np.float32)
        for at in range(0, int(several.sum()), COLUMNS):
            a, b = np.searchsorted(column, (at, at + COLUMNS))
            part = np.zeros((len(sets), COLUMNS), np.float32)
            part[own[a:b], column[a:b] - at] = 1
            shared += part[alone] @ part.T
        near_to = near(shared.astype(np.int64), size[alone][:, None], size[None, :])
        row = {int(x): i for i, x in enumerate(alone)}
        seen = np.zeros(len(sets), bool)
        for first in alone.tolist():
            if seen[first]:
                continue
            seen[first], todo = True, [first]
            while todo:
                x = todo.pop()
                new = np.flatnonzero(near_to[row[x]] & ~seen)
                out += [(x, y) for y in new.tolist()]
                # Sets that link to the lead are one with it: one such edge is enough and they lead nowhere else.
                seen[new[~linked[new]]] = True
                todo += new[~linked[new]].tolist()
    return out


def _linked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links (u, v) of nodes, group by group of (lead, i, j); a partition holds whole groups, in order."""
    key, held = None, {}

    def found() -> pd.DataFrame:
        nodes = list(held)
        pairs = links([held[x] for x in nodes], nodes.index(key[0])) if len(nodes) > 1 else []
        return pd.DataFrame([(nodes[a], nodes[b]) for a, b in pairs], columns=["u", "v"]).astype("int64")

    for f in frames:
        for lead, i, j, node, shingles in zip(*(f[x].tolist() for x in ("lead", "i", "j", "node")), f["shingles"]):
            if key is not None and key != (lead, i, j):
                yield found()
                held = {}
            key = lead, i, j
            held[node] = np.asarray(shingles)
    if held:
        yield found()
    release_memory()


def buckets(sets: DataFrame) -> DataFrame:
    """(node, key) of sets (node, size, fp, bands): keys of covering masks are odd, those of bands even. An empty set has none."""
    kept = F.array(*(F.lit(signed(m)) for m in masks(RADIUS).values()))
    covering = F.transform(kept, lambda mask, table: F.xxhash64(table, F.col("fp").bitwiseAND(mask)).bitwiseOR(F.lit(1)))
    beyond = F.transform("bands", lambda band: band.bitwiseAND(F.lit(-2)))
    return sets.where("size > 0").select("node", F.explode(F.concat(covering, beyond)).alias("key"))


def followers(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """(lead, node, size) of rows (node, key) of sets (node, size, fp), once each, the lead itself included: who meets whom.

    Two alone in the bucket of a mask do not meet there if they differ in more than RADIUS bits.
    """
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = written(rows.join(sizes, "key").join(sets.select("node", "size", "fp"), "node"))
    score = members.groupBy("node").agg(F.sum("n").alias("score"))
    first = members.join(score, "node").groupBy("key").agg(F.max(F.struct("score", "node", "size", "fp")).alias("first"))
    near = (F.col("n") > 2) | (F.col("key").bitwiseAND(F.lit(1)) == 0) | (F.bit_count(F.col("fp").bitwiseXOR(F.col("first.fp"))) <= RADIUS)
    led = members.join(first, "key").where(near).select(F.col("first.node").alias("lead"), F.col("first.size").alias("lead_size"), "node", "size").where("node <> lead").distinct()
    return led.select("lead", "node", "size").union(led.select("lead", F.col("lead").alias("node"), F.col("lead_size").alias("size")).distinct())


def dealt(led: DataFrame) -> DataFrame:
    """(lead, i, j, node): followers by pairs of blocks of their lead; a lead is in all pairs of its blocks."""
    total = led.groupBy("lead").agg(F.ceil(F.sum("size") / BLOCK).cast("int").alias("k"))
    d = led.join(total, "lead").withColumn("b", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    all_ = F.sequence(F.lit(0), F.col("k") - 1)
    mine = F.transform(all_, lambda x: F.struct(F.least(x, F.col("b")).alias("i"), F.greatest(x, F.col("b")).alias("j")))
    every = F.flatten(F.transform(all_, lambda i: F.transform(F.sequence(i, F.col("k") - 1), lambda j: F.struct(i.alias("i"), j.alias("j")))))
    return d.select("lead", "node", F.explode(F.when(F.col("lead") == F.col("node"), every).otherwise(mine)).alias("p")).select("lead", "p.*", "node")


def components(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """(doc_id, component_id) for every row with an id: component_id is the smallest id reachable over links, the row's own included.

    Null and empty texts, and texts without a word, are one component. Texts of fewer than five words have one shingle; very
    long texts are read whole. Repeated rows stay. Other columns are left out, whatever their names. An empty table gives an
    empty result.
    """
    sketch, shingles = F.pandas_udf(_sketch, "node long, size long, fp long, bands array<long>"), F.pandas_udf(_shingles, "node long, shingles array<long>")
    d = small_batches(docs).select(F.col(id_column).alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null")
    sketches = written(d.select("doc_id", sketch("text").alias("s")).select("doc_id", "s.*"))
    nodes = sketches.groupBy("node").agg(F.min("doc_id").alias("rep"))
    distinct = sketches.groupBy("node").agg(*(F.first(x).alias(x) for x in ("size", "fp", "bands")))  # a node's are equal
    led = written(followers(buckets(distinct), distinct))

    wanted = led.select("node").distinct().join(nodes, "node").select("node", F.col("rep").alias("doc_id"))
    sets = d.join(wanted, "doc_id").select("node", shingles("text").alias("s")).where("node = s.node")
    sets = sets.select("node", "s.shingles").dropDuplicates(["node"])
    met = dealt(led).join(sets, "node").repartition("lead", "i", "j").sortWithinPartitions("lead", "i", "j", "node")
    roots = connected_components(met.select("lead", "i", "j", "node", "shingles").mapInPandas(_linked, "u long, v long"))
    named = nodes.join(roots, "node", "left").select("node", "rep", F.coalesce("root", "node").alias("root"))
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    return sketches.select("doc_id", "node").join(named.join(least, "root").select("node", "component_id"), "node").select("doc_id", "component_id")


def keep_one(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """docs with one document of each component, the one with the smallest id; rows without an id stay.

    Null and empty texts are one component, very long texts are read whole, ties go by the hash of a text. Of repeated
    rows of one id one stays, that with the smallest text hash, in every run. Columns are docs' own, whatever their names; an
    empty table gives an empty one.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    key, body = names[docs.columns.index(id_column)], names[docs.columns.index(text)]
    gone = components(plain, body, key).where("doc_id <> component_id").select(F.col("doc_id").alias(key)).distinct()
    left = plain.join(gone, key, "left_anti")
    return one_of_each(left, key, body).select(*names).toDF(*docs.columns)
