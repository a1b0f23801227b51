"""A corpus from raw documents: five stages, each written as Parquet and read again.

``STAGES`` names them in order; each function takes (spark, docs, sf_dir) and returns a DataFrame,
all but the last with the columns of ``documents``, further and clashing ones carried along.  An empty
table gives an empty result in each stage, texts of any length are taken whole, and rows that are repeated
are rows of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larkspur.llm import bpe, mixing, simhash, suffix_dedup, toxicity
from larkspur.llm.common import Scratch, read

#: Bytes from which on a repeated string is a passage: some 50 words of English and its neighbours.
PASSAGE = 256


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold; null and empty texts have the score of the bias and stay."""
    return toxicity.scored(docs, toxicity.learn(docs, read(spark, sf_dir, "labels")), keep_below=toxicity.THRESHOLD)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more.

    The smallest doc_id stays, and all rows that have it; rows without a doc_id stay.  Null, empty and blank
    texts are copies of each other.
    """
    return simhash.keep_one(docs, shingle=5, similarity=0.8)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that repeated strings of PASSAGE bytes cover; a null text stays null, a covered one is empty.

    Every place of a repeated string goes, in whichever order its documents come; rows with one doc_id are separate texts.
    """
    return suffix_dedup.removed(docs, length=PASSAGE)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target mix of sources takes them, up to twice.

    Null and empty texts have no words and are taken as their place in the order says; the null source is a source; ties
    in size go by doc_id, ties in that by the text.
    """
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the encoded and the decoded texts, a row each; a null text has no tokens."""
    return bpe.round_trip(docs, bpe.vocabulary())


STAGES = [
    ("toxicity", reject_toxic),
    ("simhash near-dedup", drop_near_copies),
    ("suffix-array dedup", drop_repeats),
    ("mixing sources", mix_sources),
    ("BPE encoding and decoding", encode),
]

#: No SQL expresses the trained classifier, the vocabulary or components; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, last = Scratch(spark), None
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir))
        if last is not None:
            scratch.drop(last)
        last = docs
    return docs
