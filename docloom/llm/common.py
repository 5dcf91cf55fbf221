"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark SQL pattern of one word; white space is exactly 0x20 and 0x09 to 0x0D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or on a local master a folder of our own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext
        root = context.getCheckpointDir()
        if root is None:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="docloom-"))
            root = context.getCheckpointDir()
    return str(root).rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = _scratch(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, *keys: str) -> DataFrame:
    """df as a table in the shared folder, bucketed by keys like the session's shuffles: joins on keys do not shuffle it."""
    spark = df.sparkSession
    path = _scratch(spark)
    name = path.rsplit("/", 1)[1].replace("-", "_")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(n, *keys).option("path", path).option("compression", "zstd").format("parquet").saveAsTable(name)
    return spark.table(name)


def _scratch(spark: SparkSession) -> str:
    """A new path in the shared folder; what is written there goes when the driver's JVM ends."""
    name = f"docloom-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}")
    files = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    files.mkdirs(folder)  # only what exists can be marked
    files.deleteOnExit(folder)
    return f"{shared_dir(spark)}/{name}/{name}"


#: Rows of whole texts that a Python worker gets at a time, unless the session sets its own number.
BATCH_ROWS = 1000


def small_batches(df: DataFrame) -> DataFrame:
    """df, after bounding Arrow batches of texts: Spark's own 10,000 rows of long texts would be held several times over.

    The setting stays in the session, as it is read when an action runs; a session's own number is left alone.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(name) == "10000":
        conf.set(name, str(BATCH_ROWS))
    return df


def release_memory() -> None:
    """At the end of a task, gives what a Python worker no longer uses back to the system; workers live on between tasks."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def fresh(columns: list[str], name: str) -> str:
    """A column name that does not clash (case-insensitively) with those given."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_of(column: str = "text"):
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def hash_terms(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges [start, end) of data; equal bytes get equal hashes on every machine."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(data) + 1, np.uint64)
    # Two rounds of a polynomial in the position within the word: bytes are first mixed through a table.
    position = np.arange(len(data), dtype=np.int64)
    length = ends - starts
    offset = np.repeat(starts, length)
    inside = np.repeat(np.arange(len(starts)), length)
    at = np.concatenate([[0], np.cumsum(length)[:-1]])
    index = np.arange(len(inside), dtype=np.int64) - np.repeat(at, length)
    del position, sums
    with np.errstate(over="ignore"):
        value = _BYTE_MIX[data[offset + index]] * _powers(int(length.max()))[index]
        out = np.add.reduceat(value, at)
        return mix64(out + length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over the whole word."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_BYTE_MIX = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        size = 1 << max(10, (n - 1).bit_length())
        with np.errstate(over="ignore"):
            base = np.full(size, 0xD6E8FEB86659FD93, np.uint64)
            base[0] = 1
            _POWERS = np.cumprod(base, dtype=np.uint64)
    return _POWERS


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in UTF-8 bytes; bytes of multi-byte characters are never white space."""
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.flatnonzero(np.diff(np.concatenate([[False], solid, [False]]).astype(np.int8)))
    return edge[::2], edge[1::2]


#: Most bytes of a table that is broadcast, counted as JSON, and rows of one key that go to one task beyond that.
BROADCAST_BYTES, DEAL_ROWS = 8_000_000, 200_000


def join_table(big: DataFrame, small: DataFrame, on: str, by: str, how: str = "inner", spread: str | None = None) -> DataFrame:
    """big joined with small, which has one row per key (big.on = small.by), without one task for the rows of one key.

    small is written and measured: within BROADCAST_BYTES it is broadcast. Beyond that the rows of keys with over
    DEAL_ROWS rows are dealt out by a hash of big's column `spread`, and the key's row of small is repeated. Such keys
    are one in DEAL_ROWS rows at most, so that their table is small.
    """
    small = written(small)
    size = small.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        return big.join(F.broadcast(small), F.col(on) == F.col(by), how)
    names = [*big.columns, *small.columns]
    salt, other, key, parts = (fresh(names, x) for x in ("salt", "salt_of_key", "hot_key", "parts"))
    hot = big.groupBy(F.col(on).alias(key)).agg(F.ceil(F.count(F.lit(1)) / DEAL_ROWS).cast("int").alias(parts)).where(F.col(parts) > 1)
    hot = F.broadcast(written(hot))
    deal = F.coalesce(F.col(parts), F.lit(1))
    dealt = big.join(hot, F.col(on) == F.col(key), "left").withColumn(salt, F.pmod(F.xxhash64(spread or on), deal).cast("int")).drop(key, parts)
    every = small.join(hot, F.col(by) == F.col(key), "left").withColumn(other, F.explode(F.sequence(F.lit(0), deal - 1))).drop(key, parts)
    return dealt.join(every, (F.col(on) == F.col(by)) & (F.col(salt) == F.col(other)), how).drop(salt, other)


def one_of_each(rows: DataFrame, key: str, text: str) -> DataFrame:
    """rows with one row of each key: of several the one whose text has the smallest SHA-256, then by a hash of all columns.

    Null keys stay, every row of them. Keys that repeat are counted first, by the key alone, so that the texts of other
    rows are not shuffled; those of a repeated key are reduced before the shuffle, however many there are.
    """
    columns = rows.columns
    of, several, kept = (fresh(columns, x) for x in ("of", "several", "kept"))
    again = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(of)).agg((F.count(F.lit(1)) > 1).alias(several)).where(several)
    again = written(again)
    if again.isEmpty():  # then rows are not read twice
        return rows
    marked = join_table(rows, again, key, of, "left", text)
    order = F.struct(F.sha2(F.coalesce(F.col(text), F.lit("")), 256), F.xxhash64(*columns))
    chosen = marked.where(several).groupBy(key).agg(F.min_by(F.struct(*columns), order).alias(kept)).select(f"{kept}.*")
    return marked.where(F.col(several).isNull()).select(*columns).union(chosen.select(*columns))


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of the graph with edges (u, v), two columns of long: one row (node, root) per node, root its smallest node.

    Alternates the large-star and small-star steps until the edge set stays as it is. The minimum of a node's
    neighbours is a plain aggregate (combined before the shuffle) joined back on the node, so that a hub with many
    neighbours is a skewed join, which is split, and never one group in one task. Each round ends in a written table.
    Nulls and self-loops are dropped; an empty table gives an empty result.
    """
    u, v = F.col("u"), F.col("v")

    def large(e: DataFrame) -> DataFrame:
        both = e.select("u", "v").union(e.select(v.alias("u"), u.alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()

    def small(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        kept = down.join(least, "u").where("v <> m").select(v.alias("u"), F.col("m").alias("v"))
        return kept.union(least.select("u", F.col("m").alias("v"))).distinct()

    def mark(e: DataFrame):
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = written(edges.select("u", "v").where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = mark(now)
    while before[0]:
        now = written(small(large(now)))
        if (after := mark(now)) == before:
            break
        before = after
    roots = now.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.union(now.select(v.alias("node"), v.alias("root")).distinct())
