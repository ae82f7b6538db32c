"""Corpus pipeline: the stages in order, and their run over ``documents``.

Each stage works on what its predecessor kept and returns the columns of
``documents``; the last returns the token ids. Null or empty texts pass the
classifier's score like any other, are no duplicates of each other, and are not taken by the mix.
SQL cannot express the classifier, so the run has no oracle; tests hold it against a
brute-force version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from seqlake.llm.disclosure import sanitise
from seqlake.llm.jaccardjoin import keep_one
from seqlake.llm.mixing import mix
from seqlake.llm.ordinal import keep
from seqlake.llm.pieces import encode
from seqlake.llm.queries import table, tokenizer_file
from seqlake.session import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier selects."""
    return keep(docs, table(spark, sf_dir, "labels"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return keep_one(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data generalised and disclosing terms removed."""
    return sanitise(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text."""
    return encode(docs, tokenizer_file(spark, "piece_bpe_32k.model"))


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", deduplicate),
    ("PII", pii),
    ("mixing sources to target weights", mixture),
    ("SentencePiece encoding and decoding", tokens),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
