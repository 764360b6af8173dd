"""Session helpers: one place for the configs the operators rely on."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "reviewlake") -> SparkSession:
    """Build (or reuse) a session with AQE on, UTC time and a sane shuffle width.

    On a cluster ``master`` stays None and the submit-time settings win; tests and the
    bench pass ``local[N]``.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
        if master.startswith("local"):
            b = b.config("spark.driver.memory", "8g")
    b = (b.config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         # Text shuffles compress well; a small floor keeps regex-heavy stages after a
         # shuffle from being coalesced into a handful of CPU-bound tasks.
         .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false"))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder (``spark.checkpoint.dir``).

    The folder named by the cluster is used as is. Where it is unset, a local session (tests,
    bench) writes under its own temp folder; any other is refused, since executors would each
    write to their own disks.
    """
    sc = spark.sparkContext
    d = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        master = sc.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = os.path.join(os.environ.get("TMPDIR", "/tmp"), f"reviewlake-{sc.applicationId}")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for written intermediate tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{os.getpid()}-{uuid.uuid4().hex[:12]}"


def spread(df):
    """Give a CPU-heavy per-row stage every core when its (batch) input arrives in fewer
    partitions than the cluster's default parallelism (e.g. one small parquet file).
    A no-op for inputs that are already split wider, as at cluster scale."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df
