"""A corpus pipeline of five stages over ``documents``; each is written as Parquet and reread."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import linededup, mixing, packing, rules, simhash
from strandlake.llm.common import stage, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of lines that recur, as they are or nearly so, the first stays."""
    kept = linededup.without_repeated_lines(docs, short_lines=True)
    return kept.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else kept


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays, the one with the smallest id."""
    return simhash.drop_near_copies(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as their rates say, so that the domains' tokens meet their targets."""
    return mixing.mix(docs, table(spark, sf_dir, "labels"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, dealt to sequences of at most 2048 tokens."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [("quality rules", quality), ("line dedup", lines), ("simhash", near_copies), ("mixing", mixture), ("packing", pack)]

#: Tokenising and fuzzy links have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
