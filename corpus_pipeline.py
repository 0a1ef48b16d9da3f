"""The corpus pipeline: quality, exact copies, near copies, mixture, tokens.

Counted as part of the subpackage ``tideline.llm``.  Every stage takes
``(spark, docs, sf_dir)``; what it returns is written as Parquet and read again
as the next stage's documents.

In every stage null texts count as empty, extra columns pass through whatever
their names, and an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tideline.llm import bpe, exact_dedup, mixing, near, quality
from tideline.llm.common import materialize, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; each row is judged by itself, so repeated rows and null ids are like others."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id stays; null ids come last, and rows that repeat id and text are one."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays; rows without an id stay, rows of one id go together."""
    return near.drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mixture takes it, not at all, once or twice; a null source is a source of its own."""
    return mixing.repeat_to_mix(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token counts and digests of every document of the mixture, a row for each of its rows."""
    return bpe.bpe_round_trip(docs)


STAGES = [
    ("quality", keep_quality),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixture", mix),
    ("bpe", tokenise),
]

#: SQL can express neither the classifier nor the components of near copies nor the merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
