"""Document fingerprints by consistent weighted sampling.

A text is a bag of shingles of five words (ASCII letters in lower case), each weighted by how often it occurs. For
every slot of the signature, each term draws a rate r and a level c from Gamma(2, 1) and a shift b from [0, 1); with
weight w it has the quantised exponent t = floor(ln w / r + b) and the value ln c - r (t - b) - r. The term of the
smallest value, together with its t, is the sample. Two texts give the same sample with a probability equal to their
generalised Jaccard similarity, sum of minima over sum of maxima of the weights.

Draws come from tables indexed by separate bits of the term's hash, the same on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hash_terms, mix64, small_batches, text_of, utf8, word_spans

SLOTS = 64
WIDTH = 5
_ROWS = 1 << 14
_BLOCK = 8192
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_DRAWS: list[np.ndarray] = []


def _draws() -> list[np.ndarray]:
    if not _DRAWS:

        def uniform(k: int) -> np.ndarray:
            at = np.arange(1, _ROWS * SLOTS + 1, dtype=np.uint64) + np.uint64(k << 40)
            return ((mix64(at * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)).astype(float) + 0.5).reshape(_ROWS, SLOTS) * 2.0**-53

        gamma = lambda k: -np.log(uniform(k) * uniform(k + 1))
        _DRAWS.extend(x.astype(np.float32) for x in (gamma(1), np.log(gamma(3)), uniform(5)))
    return _DRAWS


def terms(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and weights of the shingles of a whole text; fewer than WIDTH words: one shingle of all; none: nothing."""
    data = _LOWER[np.frombuffer(utf8(text), np.uint8)]
    starts, ends = word_spans(data)
    h = hash_terms(data, starts, ends)
    width = min(WIDTH, len(h))
    if not width:
        return h, np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        out = np.zeros(len(h) - width + 1, np.uint64)
        for i in range(width):
            out = out * np.uint64(0xD1342543DE82EF95) + h[i : i + len(out)]
    return np.unique(mix64(out), return_counts=True)


def signature(text: str | None) -> np.ndarray:
    """SLOTS samples of 16 bits; a text without words has zeros."""
    h, weight = terms(text)
    if not len(h):
        return np.zeros(SLOTS, np.uint16)
    rate, level, shift = _draws()
    best = np.full(SLOTS, np.inf, np.float32)
    code = np.zeros(SLOTS, np.uint64)
    mask = np.uint64(_ROWS - 1)
    slots = np.arange(SLOTS)
    for at in range(0, len(h), _BLOCK):
        x, w = h[at : at + _BLOCK], weight[at : at + _BLOCK]
        r = rate[(x & mask).astype(np.intp)]
        b = shift[((x >> np.uint64(28)) & mask).astype(np.intp)]
        value = b - 1  # for weight 1 the exponent is 0
        many = np.flatnonzero(w > 1)
        t = None
        if len(many):
            t = np.floor(np.log(w[many]).astype(np.float32)[:, None] / r[many] + b[many])
            value[many] -= t
        value *= r
        value += level[((x >> np.uint64(14)) & mask).astype(np.intp)]
        arg = value.argmin(axis=0)
        low = value[arg, slots]
        better = low < best
        best[better] = low[better]
        found = x[arg]
        if t is not None:
            row = np.full(len(x), -1)
            row[many] = np.arange(len(many))
            k = row[arg]
            step = np.where(k >= 0, t[k, slots], 0).astype(np.uint64)
            with np.errstate(over="ignore"):
                found = found + step * np.uint64(0x9E3779B97F4A7C15)
        code[better] = found[better]
    return (mix64(code) >> np.uint64(48)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def _sign(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for texts, edited in batches:
        rows = []
        for x, y in zip(texts, edited):
            a = signature(x)
            b = a if x == y else signature(y)
            rows.append((a.astype(">u2").tobytes().hex(), b.astype(">u2").tobytes().hex(), likeness(a, b)))
        yield pd.DataFrame(rows, columns=["fingerprint", "edited_fingerprint", "near_edited"])


def _compare(a: pd.Series, b: pd.Series) -> pd.Series:
    back = lambda x: np.frombuffer(bytes.fromhex(x), ">u2")
    return pd.Series([None if y is None else likeness(back(x), back(y)) for x, y in zip(a, b)], dtype=float)


def fingerprints(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """Fingerprints of all texts and of their edited texts, in one shuffle of the texts and one of the fingerprints.

    The next document is that of the next smaller id; rows of one id go by text, null ids come last, by a hash of their
    texts, and the last row's next is the first. Ids, and hashes for null ids, are cut into slices at some of their
    values; the document that heads a slice is also sent to the slice before, so that a window within each slice sees
    every next text. Null and empty texts are empty and have the fingerprint of no words; very long texts are read
    whole. An empty table gives an empty result; a single row is its own next. Repeated rows stay. Extra columns are dropped, whatever their names.
    """
    spark = small_batches(docs).sparkSession
    d = docs.select(F.col(id_column).alias("doc_id"), text_of(text).alias("text")).withColumn("mark", F.when(F.col("doc_id").isNull(), F.shiftrightunsigned(F.xxhash64("text"), 16)))
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = F.array(*(F.lit((i + 1) / n) for i in range(n)))
    cuts = d.agg(*(f for x in ("doc_id", "mark") for f in (F.percentile_approx(x, shares, F.lit(10 * n)), F.max(x))), F.min("doc_id")).first()
    heads = [np.array(sorted({*(some or ()), *(() if top is None else (top,))}), np.int64) for some, top in ((cuts[0], cuts[1]), (cuts[2], cuts[3]))]
    if len(heads[0]) and max(cuts[1], -cuts[4]) >= 1 << 53:  # such percentiles are no exact ids: the largest id up to each is
        place = F.pandas_udf(lambda ids: pd.Series(np.searchsorted(heads[0], ids.to_numpy())), "int")
        tops = d.where("doc_id is not null").groupBy(place("doc_id").alias("k")).agg(F.max("doc_id")).collect()  # one row a slice
        heads[0] = np.array(sorted(r[1] for r in tops), np.int64)
    last, first = len(heads[1]), len(heads[0]) + len(heads[1]) - 1  # slices of null ids come before those of ids, and so last in the order

    @F.pandas_udf("array<int>")
    def slices(known: pd.Series, values: pd.Series) -> pd.Series:
        v, is_id = values.to_numpy(), known.to_numpy()
        out, is_head = np.zeros(len(v), np.int64), np.zeros(len(v), bool)
        for mine, at, base in ((is_id, heads[0], last), (~is_id, heads[1], 0)):
            if mine.any():
                k = np.searchsorted(at, v[mine])
                out[mine], is_head[mine] = base + k, at[k] == v[mine]
        guest = np.where(out == first, 0, out + 1)
        return pd.Series([[o, -1 - g] if h else [o] for o, g, h in zip(out.tolist(), guest.tolist(), is_head.tolist())])

    sign, compare = F.pandas_udf(_sign, "fingerprint string, edited_fingerprint string, near_edited double"), F.pandas_udf(_compare, "double")
    placed = d.withColumn("at", F.explode(slices(F.col("doc_id").isNotNull(), F.coalesce(F.col("doc_id").cast("long"), "mark"))))
    placed = placed.select("doc_id", "mark", "text", (F.col("at") < 0).alias("guest"), F.when(F.col("at") < 0, -1 - F.col("at")).otherwise(F.col("at")).alias("slice"))
    order = Window.partitionBy("slice").orderBy("guest", F.col("doc_id").desc_nulls_last(), F.col("mark").desc(), "text")
    half = F.floor(F.col("n_chars") / 2).cast("int")
    out = placed.withColumn("next", F.lead("text").over(order)).withColumn("row", F.row_number().over(order)).withColumn("n_chars", F.length("text").cast("long"))
    out = out.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - half).cast("int")), F.coalesce(F.substring(F.col("next"), F.lit(1), half), F.lit(""))))
    out = out.withColumn("edited_sha256", F.sha2(F.encode("edited", "UTF-8"), 256)).withColumn("signed", sign("text", "edited"))
    out = out.select("doc_id", "guest", "slice", "row", "n_chars", "edited_sha256", "signed.*")  # no text goes further
    out = out.withColumn("next_fingerprint", F.lead("fingerprint").over(Window.partitionBy("slice").orderBy("row"))).where(~F.col("guest"))
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", compare("fingerprint", "next_fingerprint").alias("near_next"))


def query(spark, sf_dir):
    """op3: whole `documents`."""
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
