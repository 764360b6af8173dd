"""Sources and sinks: landed webhook deliveries in, reports / audit / rejects out.

Batch writes overwrite a target folder or, with a run id, commit a run: the rows go to a folder of
this attempt, then one row of the manifest names the attempt as the run's. Readers follow the
manifest, so a run that was written again counts once, an attempt that died halfway counts for
nothing, and a rerun that dies leaves the earlier attempt in place. Streaming writes go through
``foreachBatch`` with a checkpoint so a lost executor or driver restart replays the
micro-batch instead of losing or duplicating it.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DELIVERY_SCHEMA = "delivery_id BIGINT, raw_body STRING, signature_header STRING"


def scan_deliveries(spark: SparkSession, path: str, streaming: bool = False, fmt: str = "parquet",
                    max_files_per_trigger: int | None = None) -> DataFrame:
    """A1: landed webhook bodies (batch or file stream; schema fixed, never inferred)."""
    if streaming:
        r = spark.readStream.schema(DELIVERY_SCHEMA).format(fmt)
        if max_files_per_trigger:
            r = r.option("maxFilesPerTrigger", max_files_per_trigger)
        return r.load(path)
    return spark.read.schema(DELIVERY_SCHEMA).format(fmt).load(path)


MANIFEST_SCHEMA = "run_id STRING, attempt STRING, committed_ns BIGINT"


def commit_run(df: DataFrame, path: str, run_id: str) -> str:
    """Write ``df`` as run ``run_id`` of the table at ``path``, in place of what that run wrote before.

    Two appends, each of which Spark commits as a whole: the attempt's rows, then its manifest row.
    Nothing that was committed is touched. Returns the attempt's name."""
    spark = df.sparkSession
    base, attempt = path.rstrip("/"), uuid.uuid4().hex
    (df.withColumns({"run_id": F.lit(run_id), "attempt": F.lit(attempt)})
     .write.mode("append").partitionBy("run_id", "attempt").parquet(f"{base}/data"))
    (spark.range(1).select(F.lit(run_id).alias("run_id"), F.lit(attempt).alias("attempt"),
                           F.lit(time.time_ns()).cast("long").alias("committed_ns"))
     .coalesce(1).write.mode("append").parquet(f"{base}/manifest"))
    return attempt


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """The rows of every run's last committed attempt, with ``run_id`` (a string, as it was given).

    One row a run is joined; on the run and attempt folders it prunes the scan."""
    base = path.rstrip("/")
    manifest = spark.read.schema(MANIFEST_SCHEMA).parquet(f"{base}/manifest")
    last = manifest.groupBy("run_id").agg(F.max_by("attempt", "committed_ns").alias("attempt"))
    found = spark.read.parquet(f"{base}/data").schema
    text = T.StructType([T.StructField(f.name, T.StringType() if f.name in ("run_id", "attempt") else f.dataType) for f in found])
    return spark.read.schema(text).parquet(f"{base}/data").join(last, ["run_id", "attempt"], "left_semi").drop("attempt")


def write_reports(df: DataFrame, path: str, dry_run: bool = False, log_path: str | None = None,
                  mode: str = "overwrite", run_id: str | None = None) -> str:
    """A6 sink: deliverable reports to ``path``; in dry-run mode to a log table instead. With
    ``run_id`` the target is a table of runs (:func:`commit_run`, :func:`read_runs`)."""
    target = (log_path or path.rstrip("/") + "_dryrun") if dry_run else path
    if run_id is None:
        df.write.mode(mode).parquet(target)
    else:
        commit_run(df, target, run_id)
    return target


def write_audit(df: DataFrame, path: str, mode: str = "append", run_id: str | None = None) -> None:
    """A8 sink: audit rows as JSON documents (diff columns already dropped), appended or, with
    ``run_id``, committed as that run."""
    cols = [c for c in df.columns]
    rows = df.select(F.col("pr_id"), F.to_json(F.struct(*cols)).alias("audit_json"))
    if run_id is None:
        rows.write.mode(mode).parquet(path)
    else:
        commit_run(rows, path, run_id)
