"""Search of vector tables by cells: an inverted file of centroids with the radius of each cell, approximate or exact.

Centroids are fitted on a bounded sample; every row belongs to the cell of its nearest one. A query looks into the
cells nearest to it. What a cell can still hold is bounded by the angles to its centroid and of its farthest row, so
that a second look into the few cells that may hold better rows makes the answer exact. Cells of many rows are dealt
into blocks, and so are queries: a task holds one block of each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import stored

#: Cells at most, rows of the sample for each, rows and queries of a block, cells that a query looks into, rounds of the fit.
CELLS, PER_CELL, BLOCK_ROWS, BLOCK_QUERIES, PROBES, ROUNDS = 4096, 64, 4096, 1024, 16, 12
#: Scores that a task or the driver holds at a time: 8 MB as numbers of 8 bytes, for any number of cells.
SCORES = 1 << 20


def slices(n: int, width: int):
    """Slices of n rows, each with SCORES numbers at most in a matrix of that width."""
    step = max(1, SCORES // max(width, 1))
    return (slice(at, at + step) for at in range(0, n, step))


def unit(vectors, dim: int | None = None) -> np.ndarray:
    """Rows of length one, as a matrix; a null vector is a zero one, and zero stays zero."""
    found = list(vectors)
    dim = dim or max((len(v) for v in found if v is not None), default=0)
    m = np.array([np.zeros(dim) if v is None else v for v in found], float).reshape(len(found), dim)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n > 0, n, 1.0)


def _scores(vectors, centroids: np.ndarray) -> np.ndarray:
    """Cosines to centroids; zero ones (of a table without a direction) have no number of dimensions."""
    return unit(vectors, centroids.shape[1]) @ centroids.T if centroids.any() else np.zeros((len(vectors), len(centroids)))


def nearest(rows: DataFrame, queries: DataFrame, on: list[str], k: int, key: str, embedding: str) -> DataFrame:
    """(query, key, score): of each group of `on`, the k rows nearest to each of its queries (query, embedding); ties by key."""
    kinds = f"query {queries.schema['query'].dataType.simpleString()}, {key} {rows.schema[key].dataType.simpleString()}, score double"

    def best(mine: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = {"query": [], key: [], "score": []}
        if len(mine) and len(asked):
            m, keys = unit(mine[embedding]), mine[key].to_numpy()
            m = m if m.shape[1] else np.zeros((len(m), max((len(v) for v in asked["embedding"] if v is not None), default=0)))  # nulls alone
            place = np.argsort(np.argsort(keys, kind="stable"), kind="stable")
            for part in slices(len(asked), len(m)):
                some = asked.iloc[part]
                scores = np.round(unit(some["embedding"], m.shape[1]) @ m.T, 12)
                least = np.partition(scores, -min(k, len(m)), axis=1)[:, -min(k, len(m))]
                q, r = np.nonzero(scores >= least[:, None])  # ties of the last may be more than k
                order = np.lexsort((place[r], -scores[q, r], q))
                q, r = q[order], r[order]
                rank = np.arange(len(q)) - np.searchsorted(q, q)
                q, r = q[rank < k], r[rank < k]
                out["query"] += some["query"].to_numpy()[q].tolist()
                out[key] += keys[r].tolist()
                out["score"] += scores[q, r].tolist()
        return pd.DataFrame(out)

    asked = queries.select(*on, "query", F.col("embedding").alias("embedding"))
    return rows.select(*on, key, embedding).groupBy(*on).cogroup(asked.groupBy(*on)).applyInPandas(best, kinds)


def ranked(found: DataFrame, k: int, key: str) -> DataFrame:
    """The k best of each query with rank from 1; Spark keeps k rows a query in each partition before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), key))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


@dataclass(frozen=True)
class Index:
    """centroids; rows (key, embedding, cell, block); table (cell, n, blocks, radius), a row per cell."""

    centroids: np.ndarray
    rows: DataFrame
    table: DataFrame
    key: str
    embedding: str


def _best(rows: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row and its cosine."""
    own, best = np.zeros(len(rows), int), np.zeros(len(rows))
    for part in slices(len(rows), len(centroids)):
        score = rows[part] @ centroids.T
        own[part] = score.argmax(axis=1)
        best[part] = score.max(axis=1)
    return own, best


def fit(sample: np.ndarray, cells: int, seed: int = 0) -> np.ndarray:
    """Centroids of length one by k-means on the sphere; an empty cell starts again at the row that fits worst."""
    rng = np.random.default_rng(seed)
    sample = sample[np.linalg.norm(sample, axis=1) > 0]
    if not len(sample):
        return np.zeros((0, sample.shape[1]))
    c = sample[rng.permutation(len(sample))[:cells]]
    for _ in range(ROUNDS):
        own, best = _best(sample, c)
        worst = iter(np.argsort(best))
        sums = np.zeros_like(c)
        np.add.at(sums, own, sample)
        for j in np.flatnonzero(np.bincount(own, minlength=len(c)) == 0):
            sums[j] = sample[next(worst)]
        c = unit(sums, c.shape[1])
    return c


def build(rows: DataFrame, key: str = "vec_id", embedding: str = "embedding", cells: int | None = None, seed: int = 0) -> Index:
    """An index of all rows: sqrt(n) cells, CELLS at most, fitted on PER_CELL rows for each by the hash of their keys.

    The driver sees the sample and a row per cell, both bounded by the number of cells. Null and zero vectors are indexed as any
    other (their similarity is 0). An empty table gives an empty index.
    """
    spark = rows.sparkSession
    n = rows.count()
    cells = min(CELLS, cells or int(np.ceil(np.sqrt(n))) or 1)
    picked = rows.where(F.col(embedding).isNotNull()).orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(cells * PER_CELL).select(embedding).collect()
    centroids = fit(unit(r[0] for r in picked), cells, seed)
    if not len(centroids):  # nothing but null and zero vectors, all in one cell
        centroids = np.zeros((1, 1))
    shared = spark.sparkContext.broadcast(centroids)

    def assign(frames):
        for f in frames:
            c = shared.value
            own, best = _best(unit(f[embedding], c.shape[1]), c) if c.any() else (np.zeros(len(f), int), np.zeros(len(f)))
            f["cell"], f["fit"] = own.astype("int32"), best
            yield f

    schema = rows.select(key, embedding).schema.add("cell", T.IntegerType()).add("fit", T.DoubleType())
    placed = stored(rows.select(key, embedding).mapInPandas(assign, schema))
    blocks = F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int")
    table = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), blocks.alias("blocks"), F.min("fit").alias("radius"))
    dealt = placed.join(F.broadcast(table.select("cell", "blocks")), "cell").withColumn("block", F.pmod(F.xxhash64(key), "blocks").cast("int"))
    return Index(centroids, dealt.drop("fit", "blocks"), stored(table), key, embedding)


def _into(index: Index, asked: DataFrame, k: int) -> DataFrame:
    """The k nearest that queries (query, embedding, cell) find in each block of the cells that they look into."""
    # A cell's queries are dealt into blocks too, each of which meets every block of the cell.
    parts = asked.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK_QUERIES).cast("int").alias("parts"))
    asked = asked.join(F.broadcast(parts), "cell").join(F.broadcast(index.table.select("cell", "blocks")), "cell")
    asked = asked.withColumn("part", F.pmod(F.xxhash64("query"), "parts").cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = index.rows.join(F.broadcast(parts), "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return nearest(rows, asked, ["cell", "block", "part"], k, index.key, index.embedding)


def probed(index: Index, queries: DataFrame, probes: int, least: str | None = None) -> DataFrame:
    """queries with cell: the `probes` nearest cells of each; with `least`, a column of scores to beat, the others that may hold such rows."""
    shared = queries.sparkSession.sparkContext.broadcast((index.centroids, {r["cell"]: r["radius"] for r in index.table.collect()}))  # a row per cell
    names = queries.columns

    def look(frames):
        centroids, radius = shared.value
        cells = np.array(sorted(radius), int)
        c, reach = centroids[cells], np.arccos(np.clip([radius[x] for x in cells], -1, 1))
        # A query may look into all cells, so that few queries are looked at, and given on, at a time.
        for f in (f.iloc[part] for f in frames for part in slices(len(f), len(cells) * 16)):
            score = _scores(f["embedding"], c)
            order = np.argsort(-score, axis=1, kind="stable")
            q, rank = np.divmod(np.arange(order.size), max(len(cells), 1))
            at = order.ravel()
            if least is None:
                keep = rank < probes
            else:
                # The best row of a cell is at least the difference of two angles away from the query.
                angle = np.arccos(np.clip(score, -1, 1)) - reach
                bound = np.cos(np.maximum(angle, 0)) + 1e-9
                keep = (rank >= probes) & (bound[q, at] >= f[least].fillna(-np.inf).to_numpy(float)[q])
            out = f[names].iloc[q[keep]].reset_index(drop=True)
            out["cell"] = cells[at[keep]].astype("int32")
            yield out

    return queries.mapInPandas(look, T.StructType([*queries.schema.fields, T.StructField("cell", T.IntegerType())]))


def search(index: Index, queries: DataFrame, k: int, probes: int = PROBES, exact: bool = False) -> DataFrame:
    """(query, key, score, rank): the k nearest rows by cosine to every query (query, embedding), from the nearest `probes` cells.

    With exact, also from all cells that may hold a nearer row than the k-th found, so that none is missed. Ties go by key;
    null and zero vectors have similarity 0. Queries must have different names. No queries give no rows.
    """
    queries = queries.select("query", "embedding")
    found = _into(index, probed(index, queries, probes), k)
    if not exact:
        return ranked(found, k, index.key)
    found = stored(ranked(found, k, index.key))
    last = found.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("score"))
    beat = queries.join(last.select("query", F.when(F.col("n") >= k, F.col("score")).alias("to_beat")), "query", "left")
    more = _into(index, probed(index, beat, probes, "to_beat").drop("to_beat"), k)
    return ranked(found.drop("rank").union(more), k, index.key)


def tuned(index: Index, recall: float = 0.95, k: int = 12, queries: int = 100, seed: int = 1) -> int:
    """The least number of probes with which `queries` rows, taken by the hash of their keys, find that share of their k nearest.

    These are found by looking into all cells; the driver sees k keys for each of them.
    """
    asked = index.rows.orderBy(F.xxhash64(F.col(index.key), F.lit(seed)), index.key).limit(queries).select(F.col(index.key).alias("query"), F.col(index.embedding).alias("embedding"))
    asked = stored(asked)
    every = index.table.count()
    true = search(index, asked, k, probes=every).join(index.rows.select(index.key, "cell"), index.key).select("query", "cell").collect()
    vectors = dict(map(tuple, asked.collect()))
    cells = np.array(sorted(r["cell"] for r in index.table.select("cell").collect()), int)
    places = []
    for query, cell in true:
        score = _scores([vectors[query]], index.centroids[cells])
        places.append(int(np.flatnonzero(cells[np.argsort(-score[0], kind="stable")] == cell)[0]) + 1)
    return int(np.quantile(places, recall, method="higher")) if places else 1
