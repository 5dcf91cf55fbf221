"""From raw documents to training pieces: five stages, each one of the operators of docloom.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet in the shared folder and read
again as the next stage's docs. All but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.llm import mixing, near_copies, pii, quality_rules, sentencepiece_nbest
from docloom.llm.common import written


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules accept.

    Documents of null or empty text go, as any of fewer than 50 words; long texts are read whole, null ids, repeated rows and columns of
    any name stay as they are, and an empty table gives an empty one. So do the stages below.
    """
    return quality_rules.keep_good(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest id.

    SimHash fingerprints of 5-word shingles and covering masks find them, min-hashing those beyond the masks' radius; the
    exact similarity of 0.8 or more decides.

    Null and empty texts are one group. Rows of null id link nothing and stay; of repeated rows of one id one stays.
    """
    return near_copies.keep_one(docs)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced; n_chars follows. Null texts stay null; every row stays."""
    return pii.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; repeats are repeated rows.

    Null and empty texts have no words and go. Null sources are one source; null ids are placed by their texts; ties and
    repeated rows are taken alike.
    """
    return mixing.take(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, piece_ids and n_best_scores of every row; a null text is an empty one."""
    return sentencepiece_nbest.pieces(docs)


STAGES = [
    ("quality_rules", good),
    ("simhash_dedup", distinct),
    ("pii_redaction", redacted),
    ("source_mixing", mixed),
    ("sentencepiece", pieces),
]

#: Fingerprints, boosted trees and a lattice search have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the mixed corpus made from `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
