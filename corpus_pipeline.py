"""The corpus pipeline: five stages over documents, each a function (spark, docs, sf_dir) -> DataFrame.

Each stage works on all that the one before kept, and all but the last return the columns of documents.
run() applies them to documents and writes what each returns, so a lost executor costs one stage at most.

Nulls, empty texts, repeated rows, ties, empty tables and extra columns are handled as the operators say.
A document with an empty text is judged by the share of good labels; of all empty documents one stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm.common import table, written
from loomgraph.llm.exact_dedup import without_copies
from loomgraph.llm.mixing import mixed
from loomgraph.llm.near_dedup import without_near_copies
from loomgraph.llm.quality_vote import fit_quality, good_documents
from loomgraph.llm.queries import MIX, TOKENIZERS, domain_of, tokens_of
from loomgraph.llm.sentencepiece_match import encoded


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier rejects; it learns from the labelled rows of docs."""
    return good_documents(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of texts that are equal but for white space."""
    return without_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each group that links of 80 percent of five-word shingles join."""
    return without_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws documents to the target weights; one drawn in several epochs comes as so many rows."""
    return mixed(docs, MIX, domain_of(), tokens_of)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document, and whether decoding them gives its text."""
    return encoded(docs, f"{TOKENIZERS}/piece_bpe_32k.model")


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("mix", mix), ("sentencepiece", encode)]

#: No SQL can express the near-duplicate and encoding stages; tests compare them with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
