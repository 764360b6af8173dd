"""Operator 6, token files as wavelet matrices.

Documents are range-partitioned by id and encoded in order; every run of about ``shard_tokens``
ids becomes one shard, written as one file. A shard's bytes are a JSON header, the documents'
lengths and the wavelet matrix of its ids: one bit-plane per bit of the vocabulary, from the most
significant down, each in the order that the planes above leave (zeros before ones, stably), with
the count of ones before every 512th bit. From these bytes alone one may read a token at a place,
count a token before a place, and find a token's k-th place, without decoding the rest; reading
all ids back undoes the planes from the last to the first.

The file is a Parquet file of one row, so that Spark's commit protocol places it in any shared
store and a lost task leaves nothing half written. Shards are numbered by partition and by order
in it, so ascending shard is ascending document id; a document's start is its start in the shard
plus the ids of all shards before (one row per shard is summed, never rows of documents).

Defined cases: null text is the empty text (only the end id); documents of equal id stand side by
side, in the order they were read in, in as many shards as they fill; an id past ``bits`` raises; null ids come first; an empty table makes no files and gives no rows; other
columns aren't read.
"""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import text_or_empty, with_workers
from .tokens import encoder

MAGIC = b"WVM1"
BLOCK = 512  #: bits between two stored counts
SHARD_SCHEMA = "shard BIGINT, n_docs BIGINT, n_tokens BIGINT, data BINARY"


class WaveletMatrix:
    """Planes of a sequence of ids; ``from_ids`` builds, ``ids`` undoes."""

    def __init__(self, n: int, planes: list[np.ndarray], counts: list[np.ndarray], zeros: list[int]):
        self.n, self.planes, self.counts, self.zeros = n, planes, counts, zeros

    @classmethod
    def from_ids(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        if len(ids) and int(ids.max()) >> bits:
            raise ValueError(f"id {int(ids.max())} needs more than {bits} bits")
        a = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        planes, counts, zeros = [], [], []
        for level in range(bits - 1, -1, -1):
            one = (a & a.dtype.type(1 << level)).astype(bool)
            planes.append(np.packbits(one))
            words = np.zeros(-(-len(a) // BLOCK) * BLOCK // 64, dtype=np.uint64)
            words.view(np.uint8)[:len(planes[-1])] = planes[-1]
            ones = np.bitwise_count(words).reshape(-1, BLOCK // 64).sum(1, dtype=np.uint32)
            counts.append(np.concatenate([[0], np.cumsum(ones)]).astype("<u4"))
            zero = np.compress(~one, a)
            zeros.append(len(zero))
            a = np.concatenate([zero, np.compress(one, a)])
        return cls(len(ids), planes, counts, zeros)

    def ids(self) -> np.ndarray:
        a = np.zeros(self.n, dtype=np.uint16 if len(self.planes) <= 16 else np.uint32)
        for level, (plane, z) in enumerate(zip(reversed(self.planes), reversed(self.zeros), strict=True)):
            one = np.unpackbits(plane, count=self.n).view(bool)
            out = np.empty_like(a)
            out[~one] = a[:z]
            out[one] = a[z:] | a.dtype.type(1 << level)
            a = out
        return a.astype("<u4")

    def _rank1(self, k: int, i: int) -> int:
        """Ones of plane ``k`` before place ``i``."""
        b = i // BLOCK
        bits = np.unpackbits(self.planes[k][b * BLOCK // 8:(i + 7) // 8], count=i - b * BLOCK) if i % BLOCK else ()
        return int(self.counts[k][b]) + int(np.sum(bits))

    def _bit(self, k: int, i: int) -> int:
        return int(self.planes[k][i >> 3]) >> (7 - (i & 7)) & 1

    def access(self, i: int) -> int:
        value = 0
        for k in range(len(self.planes)):
            bit, ones = self._bit(k, i), self._rank1(k, i)
            i = self.zeros[k] + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _down(self, token: int, i: int) -> tuple[int, int]:
        """Where the token's run starts after the last plane, and where places before ``i`` end."""
        start, depth = 0, len(self.planes)
        if token < 0 or token >> depth:
            return 0, 0
        for k in range(depth):
            a, b = self._rank1(k, start), self._rank1(k, i)
            if token >> (depth - 1 - k) & 1:
                start, i = self.zeros[k] + a, self.zeros[k] + b
            else:
                start, i = start - a, i - b
        return start, i

    def rank(self, token: int, i: int) -> int:
        """How often the token stands before place ``i``."""
        start, end = self._down(token, i)
        return end - start

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def _select(self, k: int, bit: int, nth: int) -> int:
        """Place of the ``nth`` (from 0) such bit of plane ``k``."""
        ones = self.counts[k].astype(np.int64)
        before = ones if bit else np.minimum(np.arange(len(ones)) * BLOCK, self.n) - ones
        b = int(np.searchsorted(before, nth, side="right")) - 1
        bits = np.unpackbits(self.planes[k][b * BLOCK // 8:(b + 1) * BLOCK // 8], count=min(BLOCK, self.n - b * BLOCK))
        return b * BLOCK + int(np.flatnonzero(bits == bit)[nth - before[b]])

    def select(self, token: int, nth: int) -> int:
        """Place of the token's ``nth`` occurrence (from 0); -1 if there are fewer."""
        start, end = self._down(token, self.n)
        if not 0 <= nth < end - start:
            return -1
        i, depth = start + nth, len(self.planes)
        for k in range(depth - 1, -1, -1):
            bit = token >> (depth - 1 - k) & 1
            i = self._select(k, bit, i - self.zeros[k] if bit else i)
        return i


def to_bytes(doc_ids: list, lengths: list[int], ids: np.ndarray, bits: int) -> bytes:
    """One shard: magic, header length, header, documents, counts, planes."""
    w = WaveletMatrix.from_ids(ids, bits)
    docs = zlib.compress(json.dumps([doc_ids, [int(x) for x in lengths]]).encode(), 1)
    counts = zlib.compress(b"".join(np.diff(c).astype("<u2").tobytes() for c in w.counts), 1)
    header = json.dumps({"n": w.n, "bits": bits, "zeros": w.zeros, "docs": len(docs), "counts": len(counts)}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(header)), header, docs, counts, *(p.tobytes() for p in w.planes)])


def from_bytes(data: bytes) -> tuple[list, list[int], WaveletMatrix]:
    """(document ids, lengths, matrix) of a shard's bytes."""
    if data[:4] != MAGIC:
        raise ValueError("not a wavelet shard")
    (size,) = struct.unpack_from("<I", data, 4)
    h = json.loads(data[8:8 + size])
    at = 8 + size
    doc_ids, lengths = json.loads(zlib.decompress(data[at:at + h["docs"]]))
    at += h["docs"]
    blocks = -(-h["n"] // BLOCK)
    diffs = np.frombuffer(zlib.decompress(data[at:at + h["counts"]]), "<u2").reshape(h["bits"], blocks)
    at += h["counts"]
    counts = [np.concatenate([[0], np.cumsum(d, dtype=np.uint32)]) for d in diffs]
    width = -(-h["n"] // 8)
    planes = [np.frombuffer(data, np.uint8, width, at + k * width) for k in range(h["bits"])]
    return doc_ids, lengths, WaveletMatrix(h["n"], planes, counts, h["zeros"])


def _shard_batches(tokenizer_path: str, end_id: int, bits: int, shard_tokens: int):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        enc, first = encoder(tokenizer_path), TaskContext.get().partitionId() << 32
        end = np.array([end_id], dtype="<u4").tobytes()
        docs: list = []
        parts: list[bytes] = []
        held = made = 0

        def flush():
            nonlocal docs, parts, held, made
            data = to_bytes(docs, [len(p) // 4 for p in parts], np.frombuffer(b"".join(parts), "<u4"), bits)
            row = pa.RecordBatch.from_arrays([pa.array([first + made], pa.int64()), pa.array([len(docs)], pa.int64()),
                                              pa.array([held], pa.int64()), pa.array([data], pa.binary())],
                                             ["shard", "n_docs", "n_tokens", "data"])
            docs, parts, held, made = [], [], 0, made + 1
            return row

        for batch in batches:
            texts = batch.column("t")
            for i, doc in enumerate(batch.column("doc_id").to_pylist()):
                ids = enc.encode([texts[i].as_py()])[0] + end
                docs.append(doc)
                parts.append(ids)
                held += len(ids) // 4
                if held >= shard_tokens:
                    yield flush()
        if docs:
            yield flush()
    return run


def write_shards(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, bits: int = 16,
                 shard_tokens: int = 4_000_000, shards: int | None = None, id_col: str = "doc_id",
                 text_col: str = "text") -> str:
    """Write ``docs`` as shard files under ``path``. ``shards``: range partitions (by default the
    session's shuffle partitions)."""
    spark = with_workers(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("t"))
    numbered = texts.withColumn("row", F.monotonically_increasing_id())  # splits the rows of one id
    by = ("doc_id", "row")
    ordered = numbered.repartitionByRange(shards, *by) if shards else numbered.repartitionByRange(*by)
    (ordered.sortWithinPartitions("doc_id", "row").drop("row")
     .mapInArrow(_shard_batches(tokenizer_path, end_id, bits, shard_tokens), SHARD_SCHEMA)
     .write.option("maxRecordsPerFile", 1).option("compression", "zstd").parquet(path))
    return path


def _read_batches(batches):
    import pyarrow as pa

    for batch in batches:
        for shard, data in zip(batch.column("shard").to_pylist(), batch.column("data"), strict=True):
            doc_ids, lengths, matrix = from_bytes(data.as_py())
            ids = matrix.ids()
            ends = np.cumsum(lengths)
            starts = ends - lengths
            for at in range(0, len(doc_ids), 4096):
                own = slice(at, at + 4096)
                yield pa.RecordBatch.from_arrays([
                    pa.array([shard] * len(doc_ids[own]), pa.int64()), pa.array(doc_ids[own], pa.int64()),
                    pa.array(starts[own], pa.int64()), pa.array(lengths[own], pa.int64()),
                    pa.array([ids[a:b].tobytes() for a, b in zip(starts[own], ends[own], strict=True)], pa.binary())],
                    ["shard", "doc_id", "own_start", "n_tokens", "token_ids"])


def read_shards(spark: SparkSession, path: str, **derived: Column) -> DataFrame:
    """Per document of the files under ``path``: ``doc_id``, ``start`` (ids of all documents
    before), ``n_tokens`` and ``token_ids`` (unsigned 32-bit, little-endian).

    ``derived`` columns over ``token_ids`` replace it: they are made where the shard is read, so
    that only they move to meet the shards' starts."""
    with_workers(spark)
    files = spark.read.schema(SHARD_SCHEMA).parquet(path)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("shard", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("shard_start"))
    read = files.select("shard", "data").mapInArrow(
        _read_batches, "shard BIGINT, doc_id BIGINT, own_start BIGINT, n_tokens BIGINT, token_ids BINARY")
    wanted = [c.alias(n) for n, c in derived.items()] or [F.col("token_ids")]
    read = read.select("shard", "doc_id", "own_start", "n_tokens", *wanted)
    return read.join(starts, "shard").select(
        "doc_id", (F.col("shard_start") + F.col("own_start")).alias("start"), "n_tokens", *read.columns[4:])
