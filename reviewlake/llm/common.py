"""Helpers that the operators share: table reads, written lineage cuts, Python workers' path."""

from __future__ import annotations

import os
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.session import scratch_path
from reviewlake.sources.tables import read_table

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def stored(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet under the cluster's shared checkpoint folder and
    read it back. Unlike a local checkpoint it outlives the executors that made it."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    (df.write.option("compression", compression) if compression else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def small_methods(spark: SparkSession):
    """Plans of stages whose generated method would be over 8000 bytes, which the JVM never
    compiles, run operator by operator meanwhile."""
    key = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(key)
    spark.conf.set(key, "8000")
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextmanager
def small_batches(spark: SparkSession, rows: int):
    """Queries that run meanwhile hand Python at most ``rows`` rows at once (rows that are large)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def with_workers(spark: SparkSession) -> SparkSession:
    """Let Python workers on this machine import the package when it isn't installed. On a
    cluster the package is shipped with ``--py-files`` or installed on the nodes."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = ":".join([*paths, ROOT])
    return spark
