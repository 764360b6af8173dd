"""Operator 1, token counts through a digest cache.

Each text is normalised (null becomes the empty text; nothing else may change, or counts would),
and digested (SHA-256). The digests are joined to the cache, a Parquet table of
(digest, n_tokens) per tokenizer version; only one text of each digest that the cache misses is
encoded, and its count appended. A later call on the same or grown data encodes what is new.

Rows of equal id and text all match the one (digest, id) that stands for a text, and a skewed
partition that Spark splits hands them to several tasks, each of which encodes the text once. So the
counts are grouped by digest before they are appended, and the cache again when it is read, since
two writers at a time may append the same digest; equal digests have equal counts.

The text itself is shuffled once, keyed by document, so that a text with very many copies makes no
hot task; the joins on the digest carry 40-byte rows, and Spark splits their skewed partitions (of
the last join too, since the grouped counts are written before it).

Defined cases: null text counts as empty (0 bytes, 0 tokens); repeated rows each get their row;
an empty table gives no rows; other columns are kept by ``token_counts`` (its own result columns
are ``n_bytes`` and ``n_tokens``; input columns of those names are replaced).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .common import stored, text_or_empty, with_workers
from .tokens import encoder, tokenizer_version

CACHE_SCHEMA = "digest BINARY, n_tokens BIGINT, version STRING"


def read_cache(spark, cache_path: str, version: str) -> DataFrame:
    """The counts stored for a tokenizer version; a cache that doesn't exist yet is empty."""
    try:
        cache = spark.read.schema(CACHE_SCHEMA).parquet(cache_path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE_SCHEMA)
    return (cache.where(F.col("version") == version).groupBy("digest")
            .agg(F.min("n_tokens").alias("n_tokens")).withColumn("version", F.lit(version)))


def _count_batches(tokenizer_path: str):
    def run(batches):
        import pyarrow as pa

        enc, seen = encoder(tokenizer_path), set()
        for batch in batches:
            digests, texts = batch.column("digest").to_pylist(), batch.column("t")
            new = [i for i, d in enumerate(digests) if d not in seen and not seen.add(d)]
            counts = [len(x) // 4 for i in range(0, len(new), 256)
                      for x in enc.encode([texts[j].as_py() for j in new[i:i + 256]])]
            yield pa.RecordBatch.from_arrays(
                [pa.array([digests[i] for i in new], pa.binary()), pa.array(counts, pa.int64())], ["digest", "n_tokens"])
    return run


def token_counts(docs: DataFrame, tokenizer_path: str, cache_path: str, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with ``n_bytes`` (UTF-8) and ``n_tokens``."""
    spark = with_workers(docs.sparkSession)
    version = tokenizer_version(tokenizer_path)
    text = text_or_empty(text_col)
    digest = F.unhex(F.sha2(text, 256))
    kept = [c for c in docs.columns if c not in (text_col, "n_bytes", "n_tokens", "digest")]
    keyed = stored(docs.select(*kept, F.octet_length(text).cast("long").alias("n_bytes"), digest.alias("digest")),
                   "token-digests")
    missing = (keyed.groupBy("digest").agg(F.min(id_col).alias("id"))
               .join(read_cache(spark, cache_path, version), "digest", "left_anti"))
    texts = docs.select(F.col(id_col).alias("own_id"), text.alias("t"), digest.alias("own_digest"))
    to_encode = texts.join(missing.hint("shuffle_hash"),
                           F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_digest") == F.col("digest")))
    (to_encode.select("digest", "t").mapInArrow(_count_batches(tokenizer_path), "digest BINARY, n_tokens BIGINT")
     .groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))
     .withColumn("version", F.lit(version)).write.mode("append").partitionBy("version").parquet(cache_path))
    counts = stored(read_cache(spark, cache_path, version).drop("version"), "token-counts")
    return keyed.join(counts, "digest", "left").select(*kept, "n_bytes", "n_tokens")
