"""A training-corpus pipeline over ``documents``: each stage calls one operator of loomframe.llm.

Every stage works on all rows that the one before kept, whole texts included, and returns the
columns of ``documents``, whatever their names, but for the last one.  An empty table passes
through all stages as an empty one; rows are judged one by one, so repeated rows fare alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomframe.llm import bpe, mixing, ngram_join, toxicity
from loomframe.llm.base import documents, durable
from loomframe.llm.queries import tokenizer_path, tokenizer_pattern


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model, fit on the labels, doesn't reject.

    Null and empty texts are clean; without labels of both classes nothing is rejected; rows with a null doc_id are judged by their text.
    """
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.clean(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, a Jaccard similarity of 0.8 or more.

    The least doc_id of a group stays.  Null and empty texts and rows with a null doc_id are near to nothing and stay; rows that share a doc_id are one document.
    """
    return ngram_join.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the source mix takes it.

    A null source is a source of its own; a null text has size 0 and is taken like any other row whose hash is drawn; rows that share a doc_id are drawn together.
    """
    return mixing.mixture(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The byte-level BPE round trip of every row that the mix holds; a null text is an empty one and has no ids."""
    return bpe.digests(docs, tokenizer_path("byte_bpe_multi_50k.tiktoken"), tokenizer_pattern())


STAGES = [("toxicity", reject_toxic), ("ngram_join", drop_near_copies), ("mixing", mix_sources), ("byte_bpe", encode)]

#: The stages train, draw and join in ways SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
