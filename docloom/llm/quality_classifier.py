"""Quality classifier with hierarchical empirical Bayes.

A logistic regression gives each document a probability of good quality. Documents of a host, and of a path of a
host, share a quality: the mean probability of a host is shrunk to the global mean, that of a path to its host's, by
Beta priors whose strengths come from the spread of the group means (method of moments). A document's score adds
its own evidence to the log odds of its path, the document itself left out of the group's mean.

The regression is fitted on a bounded sample: SAMPLE labelled documents, the smallest by a hash of their id. Means,
strengths and scores cover all documents, by grouped aggregates that are combined before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_terms, join_table, small_batches, utf8, word_spans, written
from .quality_rules import features

SAMPLE = 4000
WIDTH = 256
RIDGE = 1.0


def vector(text: str | None) -> np.ndarray:
    """Shares and logs of the measures of quality_rules, and a hashed bag of words."""
    n, chars, symbols, dup, repeat, lines, function, upper, letters, loud, bare = map(float, features(text))
    m = max(n, 1.0)
    shape = [1.0, np.log1p(n) / 5, chars / m / 5, min(symbols / m, 2.0), dup / max(lines, 1.0), repeat / m, function / m, upper / max(letters, 1.0), loud / m, bare / m, float(n < 50)]
    data = np.frombuffer(utf8(text), np.uint8)
    h = hash_terms(data, *word_spans(data))
    bag = np.bincount((h & np.uint64(WIDTH - 1)).astype(np.int64), minlength=WIDTH)
    return np.concatenate([shape, np.sqrt(bag / m)]).astype(np.float32)


def regression(x: np.ndarray, y: np.ndarray, rounds: int = 25) -> np.ndarray:
    """Weights of the ridge-penalised logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (y - p) - RIDGE * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(len(w)), g)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame) -> np.ndarray | None:
    """Weights from the sample; None if there are no labels."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = known.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(SAMPLE)
    vectors = F.pandas_udf(lambda s: pd.Series([vector(t).tolist() for t in s]), "array<float>")
    texts = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))  # one row an id, however often it is repeated
    rows = texts.select("doc_id", "quality", vectors("text").alias("x")).collect()  # SAMPLE rows
    if not rows:
        return None
    rows.sort(key=lambda r: (r["doc_id"], r["x"]))
    return regression(np.array([r["x"] for r in rows], float), np.array([float(r["quality"] > 0) for r in rows]))


def _strength(groups: DataFrame, mean: str) -> float:
    """The strength of the Beta prior, as a number of documents, from the spread of group means around their own priors."""
    n, d = F.col("n"), F.col("s") / F.col("n") - F.col(mean)
    r = groups.where("n > 0").agg(F.sum(n * d * d).alias("spread"), F.sum("within").alias("within"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).first()
    if not r["n"] or r["n"] <= r["k"]:
        return 10.0
    noise = r["within"] / (r["n"] - r["k"])  # variance within groups
    between = max((r["spread"] - r["k"] * noise) / r["n"], 1e-9)
    return float(np.clip(noise / between, 1.0, 1e6))


def classify(docs: DataFrame, labels: DataFrame, host, path, text: str = "text", id_column: str = "doc_id", threshold: float = 0.5) -> DataFrame:
    """doc_id, doc_prob, host_posterior, path_posterior, score and kept for every row; host and path are columns of docs.

    host_posterior is that of all documents of the host; path_posterior leaves the document itself out of its path's
    mean. Null and empty texts are empty; very long texts are read whole. A null host or path is a group of its own.
    Of several labels of a document the largest holds, of several texts of a labelled id the smallest is learned from.
    Without labels every probability is 0.5 and all are kept; a score of just the threshold is kept. Repeated rows stay
    and count each. Extra columns are dropped, whatever their names. An empty table gives an empty result.
    """
    d = small_batches(docs).select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"), F.coalesce(host, F.lit("\0")).alias("host"), F.coalesce(path, F.lit("\0")).alias("path"))
    weights = fit(d, labels)

    @F.pandas_udf("double")
    def probability(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            if weights is None:
                yield pd.Series([0.5] * len(texts))
            else:
                x = np.array([vector(t) for t in texts], float).reshape(-1, len(weights))
                yield pd.Series(1 / (1 + np.exp(-np.clip(x @ weights, -15, 15))))

    p = written(d.select("doc_id", "host", "path", F.round(probability("text"), 9).alias("p")))
    sums = (F.count(F.lit(1)).alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q"))
    inner = F.greatest(F.col("q") - F.col("s") * F.col("s") / F.col("n"), F.lit(0.0)).alias("within")
    paths = written(p.groupBy("host", "path").agg(*sums).select("*", inner))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).select("*", inner)
    total = paths.agg(F.sum("s"), F.sum("n")).first()
    overall = float(np.clip(total[0] / total[1], 1e-6, 1 - 1e-6)) if total[1] else 0.5
    by_host = _strength(hosts.withColumn("mean", F.lit(overall)), "mean")
    hosts = hosts.select("host", ((F.lit(by_host * overall) + F.col("s")) / (F.lit(by_host) + F.col("n"))).alias("host_posterior"))
    paths = written(paths.join(hosts, "host"))
    by_path = _strength(paths, "host_posterior")

    group = F.to_json(F.struct("host", "path"))
    own = join_table(p.withColumn("group", group), paths.select(group.alias("of"), "n", "s", "host_posterior"), "group", "of", spread="doc_id")
    others = (F.lit(by_path) * F.col("host_posterior") + F.col("s") - F.col("p")) / (F.lit(by_path) + F.col("n") - 1)
    own = own.withColumn("path_posterior", F.least(F.greatest(others, F.lit(1e-6)), F.lit(1 - 1e-6)))
    odds = lambda x: F.log(x / (1 - x))
    score = 1 / (1 + F.exp(-(odds(F.col("p")) + odds(F.col("path_posterior")) - F.lit(float(np.log(overall / (1 - overall)))))))
    return own.select("doc_id", F.col("p").alias("doc_prob"), "host_posterior", "path_posterior", score.alias("score"), (score >= threshold).alias("kept"))


def query(spark, sf_dir):
    """op2: whole `documents` and `labels`; a document's host is its source, its path the language section of it."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return classify(docs, labels, F.col("source"), F.concat_ws("/", "source", "lang"))
