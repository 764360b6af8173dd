"""The training-data pipeline: documents through five of the operators, one after another.

Each stage reads what its predecessor wrote, works on all of it, and returns the columns of
``documents`` (``n_chars`` follows the text where a stage changes it); the last returns the packed
pieces. Rows of null id or text pass through the stages as the operators define it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.llm import curriculum, line_dedup, packing, quality, simhash
from reviewlake.llm.common import documents, stored
from reviewlake.sources.tables import read_table

import public_tokenizers  # after the operators, so that their absence is what is missed first


def _with_length(new: DataFrame, columns: list[str]) -> DataFrame:
    """The input's columns, with ``n_chars`` (where it is one) counted again."""
    return new.select(*(F.char_length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in columns))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score 0.7 or more)."""
    scored = quality.score(docs, quality.fit(docs, read_table(spark, sf_dir, "labels")))
    return scored.where(F.col("score") >= 0.7).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs of 50 words or more go; the documents stay."""
    return _with_length(line_dedup.dedup_lines(docs, 50), docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays: 4-word shingles, at most 4 differing bits."""
    return simhash.keep_one(docs, 4, 4, 42)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents dealt over training time, 150 % of their words, sources weighing 3, 1, 2 in turn."""
    return _with_length(curriculum.mix(docs), docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 ids, each document ended by id 0."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), 2048, 0)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality), ("line_dedup", drop_repeated_lines), ("simhash", drop_near_duplicates),
    ("mix", mix_sources), ("pack", pack_sequences)]

#: Training, hashing and packing are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{name}")
    return docs
