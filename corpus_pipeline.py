"""A corpus pipeline of five stages: each takes all that its predecessor kept.

All stages but the last keep the columns of documents, whatever others there are, and each gives an
empty table for an empty one. Rows that repeat are alike to a stage unless it says otherwise."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from coffer.llm import bpe, exact_dedup, jaccard_join, langid, mixing
from coffer.llm.queries import PATTERN, PIECES, RANKS
from coffer.llm.workspace import keep, table


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any language go: null texts, empty ones and those without a letter. Others
    stay as often as they occur, with or without an id or a label."""
    return langid.drop_unknown(docs, PIECES)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays, a null id being the smallest. Rows that
    repeat text and id can't be told apart and stay or go together."""
    return exact_dedup.drop_copies(docs)


def drop_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similar word shingles that with the smallest id stays, with all rows of
    that id; rows without an id stay."""
    return jaccard_join.drop_similar(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their target weights: documents go, stay or come again. A null source is a
    source; texts without words are no part of the mix; of rows that repeat id and size each comes
    as often as the mix takes that document. Sources that tie go by their code points."""
    return mixing.mixed_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's text in token ids, and what they decode to, as counts and digests; a null text is
    empty."""
    return bpe.token_digests(docs, RANKS, PATTERN)


STAGES = [("language ID", identify), ("exact dedup", drop_copies), ("n-gram Jaccard join", drop_similar), ("mixing", mix), ("byte-level BPE", tokenize)]

#: None: language ID, the similarity join's components and the tokens have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
