"""Quality rules by weak supervision: rules vote or abstain, and a generative model turns votes into a posterior.

Each rule looks at one property of a document and votes "good", "bad" or abstains. The accuracy of every rule, on
good and on bad documents, is estimated by expectation-maximisation over all documents. Votes are first counted by
pattern: there are at most 3 ** len(RULES) patterns, so the table of counts that the driver sees has a fixed bound
and does not grow with the corpus.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, release_memory, small_batches, utf8, written

#: Frequent function words of the four languages.
FUNCTION_WORDS = frozenset(
    b"the of and to in a is that it for was on are as with by be this or an from at which have has not but they "
    b"le la les de des du et en un une que qui est dans pour sur par au aux avec ce il elle ne pas son se "
    b"der die das und ist in den von zu mit sich des auf dem ein eine nicht es auch als an "
    b"el los las del y que es por una con para su al lo como se no".split()
)
SYMBOLS = "#*$%&|<>"
_OTHER = re.compile(r"[^\x00-\x7f]+")
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_function", "n_upper", "n_letters", "n_loud", "n_bare")
KIND = T.StructType([T.StructField(x, T.LongType()) for x in FEATURES])


def features(text: str | None) -> tuple[int, ...]:
    """The FEATURES of one whole text (null: empty)."""
    text = text or ""
    words = utf8(text).split()  # bytes split at 0x20 and 0x09-0x0D only
    n = len(words)
    repeated = 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(windows) > len(set(windows)):
        again = Counter(windows)
        hit = bytearray(n)
        for i, x in enumerate(windows):
            if again[x] > 1:
                hit[i] = hit[i + 1] = hit[i + 2] = 1
        repeated = sum(hit)
    lines = [x for x in text.split("\n") if x.strip(" \t\r\x0b\x0c")]
    # Capitals and letters of any script; those of ASCII by counts of bytes, without a step per character.
    count = np.bincount(np.frombuffer(utf8(text), np.uint8), minlength=256)
    other = "".join(_OTHER.findall(text))
    upper = int(count[65:91].sum()) + sum(map(str.isupper, other))
    letters = int(count[65:91].sum() + count[97:123].sum()) + sum(map(str.isalpha, other))
    return (
        n, len(text) - sum(map(text.count, " \t\n\r\x0b\x0c")), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated, len(lines),
        sum(map(FUNCTION_WORDS.__contains__, map(bytes.lower, words))), upper, letters, text.count("!!"), sum(1 for w in words if len(w) == 1 and not w.isalnum()),
    )


def _share(a: str, b: str):
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


def _vote(bad, good):
    return F.when(bad, -1).when(good, 1).otherwise(0)


def votes(at: str) -> list:
    """The rules: for each a column of -1 (bad), 0 (abstains) or 1 (good), over the struct column `at`."""
    f = lambda x: f"{at}.{x}"
    n = F.col(f("n_words"))
    return [
        _vote(n < 50, n >= 100),
        _vote((_share(f("word_chars"), f("n_words")) < 2.2) | (_share(f("word_chars"), f("n_words")) > 14), _share(f("word_chars"), f("n_words")).between(3, 10)),
        _vote(_share(f("n_symbols"), f("n_words")) > 0.15, _share(f("n_symbols"), f("n_words")) < 0.03),
        _vote((_share(f("n_dup_lines"), f("n_lines")) > 0.4) & (F.col(f("n_lines")) > 3), F.col(f("n_dup_lines")) <= 1),
        _vote(_share(f("n_repeat_words"), f("n_words")) > 0.4, _share(f("n_repeat_words"), f("n_words")) < 0.15),
        _vote((_share(f("n_function"), f("n_words")) < 0.02) & (n >= 20), _share(f("n_function"), f("n_words")) > 0.08),
        _vote((_share(f("n_upper"), f("n_letters")) > 0.5) & (F.col(f("n_letters")) > 20), _share(f("n_upper"), f("n_letters")) < 0.2),
        _vote(_share(f("n_loud"), f("n_words")) > 0.2, F.col(f("n_loud")) <= 2),
        _vote(_share(f("n_bare"), f("n_words")) > 0.2, _share(f("n_bare"), f("n_words")) < 0.05),
    ]


N_RULES = 9


#: Where the estimation starts: how often a rule that votes is right about good and about bad documents, and the share of good ones.
START = (0.97, 0.35, 0.85)
#: Documents that the start counts as; it keeps rates of rules that never vote, and the meaning of the two classes.
WORTH = 20.0


def fit(counts: dict[tuple[int, ...], int], rounds: int = 200) -> tuple[dict[tuple[int, ...], float], dict]:
    """Posterior of "good" for every possible pattern of votes, and the fitted model.

    Class-conditional vote rates, given that a rule votes; an abstention says nothing. The rates and the share of good
    documents are learned, from a start that takes a bad vote as strong and a good vote as weak evidence and then counts as
    WORTH documents. Empty counts, or no rounds, give the starting model.
    """
    seen = np.array(list(counts) or [(0,) * N_RULES])
    weight = np.array(list(counts.values()) or [0.0], float)
    good, bad, prior = np.full(N_RULES, START[0]), np.full(N_RULES, START[1]), START[2]

    def posterior(v: np.ndarray) -> np.ndarray:
        g = np.where(v == 1, np.log(good), np.where(v == -1, np.log1p(-good), 0)).sum(1) + np.log(prior)
        b = np.where(v == 1, np.log1p(-bad), np.where(v == -1, np.log(bad), 0)).sum(1) + np.log1p(-prior)
        return 1 / (1 + np.exp(np.clip(b - g, -500, 500)))

    for _ in range(rounds):
        p = posterior(seen)
        plus, minus = (seen == 1).T, (seen == -1).T
        g1, g0, b1, b0 = plus @ (weight * p), minus @ (weight * p), minus @ (weight * (1 - p)), plus @ (weight * (1 - p))
        good = (g1 + START[0] * WORTH) / (g1 + g0 + WORTH)
        bad = (b1 + START[1] * WORTH) / (b1 + b0 + WORTH)
        prior = float((weight @ p + START[2] * WORTH) / (weight.sum() + WORTH))
    every = np.array(list(itertools.product((-1, 0, 1), repeat=N_RULES)))
    return dict(zip(map(tuple, every.tolist()), posterior(every).tolist())), {"good": good.tolist(), "bad": bad.tolist(), "prior": prior}


def with_features(docs: DataFrame, text: str = "text") -> tuple[DataFrame, str, str]:
    """docs with a struct of FEATURES and the code of its vote pattern; their column names."""

    @F.pandas_udf(KIND)
    def measure(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([features(x) for x in texts], columns=FEATURES)
        release_memory()

    at = fresh(docs.columns, "measures")
    code = fresh([*docs.columns, at], "pattern")
    out = small_batches(docs).withColumn(at, measure(F.col(text)))
    value = F.lit(0)
    for x in votes(at):
        value = value * 3 + (x + 1)
    return out.withColumn(code, value.cast("int")), at, code


def posteriors(coded: DataFrame, code: str) -> DataFrame:
    """(code, posterior) for each pattern that occurs; the table has at most 3 ** N_RULES rows."""

    def unpack(c: int) -> tuple[int, ...]:
        return tuple(c // 3 ** (N_RULES - 1 - i) % 3 - 1 for i in range(N_RULES))

    counts = {r[0]: r[1] for r in coded.groupBy(code).count().collect()}  # bounded by the number of patterns
    found, _ = fit({unpack(c): n for c, n in counts.items()})
    spark = coded.sparkSession
    rows = [(c, float(found[unpack(c)])) for c in counts]
    return spark.createDataFrame(rows, T.StructType([T.StructField(code, T.IntegerType()), T.StructField("posterior", T.DoubleType())]))


def judged(measured: DataFrame, at: str, code: str, threshold: float = 0.5) -> DataFrame:
    """Adds posterior, base_failed and kept to measured rows."""
    n, repeat = F.col(f"{at}.n_words"), F.col(f"{at}.n_repeat_words")
    out = measured.join(F.broadcast(posteriors(measured, code)), code, "left")
    failed = (n < 50) | (100 * repeat > 50 * n)
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("posterior") >= threshold))


def quality_rules(docs: DataFrame, text: str = "text", id_column: str = "doc_id", threshold: float = 0.5) -> DataFrame:
    """One row per document: its id, the measures, posterior, base_failed and kept.

    Null and empty texts have no words and are base_failed. Very long texts are measured whole. A posterior of just the
    threshold is kept. Null ids and repeated rows are kept as they are and vote each. Extra columns are dropped,
    whatever their names. An empty table gives an empty result.
    """
    measured, at, code = with_features(docs.select(id_column, text), text)
    measured = written(measured.select(id_column, at, code))
    return judged(measured, at, code, threshold).select(id_column, *(F.col(f"{at}.{x}").alias(x) for x in FEATURES), "posterior", "base_failed", "kept")


def keep_good(docs: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents that the rules accept, with their own columns only (whatever they are called).

    Rows are written with their measures once, so that texts are measured once. Documents with null or empty texts go,
    as they have fewer than 50 words; null ids, repeated rows and very long texts are judged like all others. An empty
    table gives an empty result.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    measured, at, code = with_features(plain, names[docs.columns.index(text)])
    out = judged(written(measured), at, code, threshold).where("kept").select(*names)
    return out.toDF(*docs.columns)


def query(spark, sf_dir):
    """op10: whole `documents`."""
    out = quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")
