"""Operator 9, SimHash near-duplicates by tiled exact comparison.

Fingerprints: XXH64 of each word shingle, repeats included; a bit of the fingerprint is 1 if it is
set in over half of the hashes. Equal fingerprints collapse before anything is compared, so copies
cost one row. The distinct fingerprints are sorted by the population counts of their four 16-bit
quarters and cut into blocks, and blocks into tiles; a pair of tiles is skipped if the ranges of
their counts are further apart than the radius, since differing bits are at least that many. All
other tile pairs are compared whole: numpy exclusive-or and bit counts. Blocks are dealt over a
triangular grid of tasks, so each is sent about as often as the square root of twice the number of
tasks, however many block pairs there are; a task skips block pairs too far apart before numpy sees
them. Every link found is used, but a block pair returns only a spanning forest of its links (never
all pairs of a group), from which large-star and small-star steps over the edge table make the
components.

Defined cases: null text and text without words have fingerprint zero and link like any other;
texts of fewer words than a shingle hash the whole word sequence; null ids take part and get the
component of their fingerprint (null where no id in it is known); repeated rows each get their row;
an empty table gives no rows; ``near_duplicates`` reads no other columns, ``keep_one`` keeps them
whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, text_or_empty, with_workers

NO_ID = -(1 << 63)
BLOCK_SCHEMA = "block BIGINT, low INT, high INT, lows ARRAY<INT>, highs ARRAY<INT>, fps BINARY"
_SPACE = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")
#: the bits of a byte as eight counters of one byte each, most significant bit first
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).reshape(256, 8).copy().view(np.uint64).ravel()


def shingle_hashes(text: str, size: int, seed: int) -> list[int]:
    """XXH64 of each run of ``size`` words (A-Z lowered), joined by single blanks."""
    from xxhash import xxh64_intdigest as h

    words = [w for w in text.encode().lower().translate(_SPACE).split(b" ") if w]  # bytes.lower(): A-Z only
    if len(words) <= size:
        return [h(b" ".join(words), seed)] if words else []
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]])[:len(words) - size + 1].tolist()
    return [h(line[a:b], seed) for a, b in zip(starts, (ends[size - 1:] - 1).tolist(), strict=True)]


def fold(hashes: np.ndarray) -> int:
    """The fingerprint of a text's shingle hashes (uint64)."""
    n = len(hashes)
    if not n:
        return 0
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 65025):
        spread = _SPREAD[hashes[at:at + 65025].astype(">u8").view(np.uint8).reshape(-1, 8)]
        counters = np.add.reduceat(spread, np.arange(0, len(spread), 255), axis=0)  # one-byte counters hold 255
        votes += counters.view(np.uint8).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > n).tobytes(), "big")


def _fingerprint_batches(size: int, seed: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column("_text")
            out = [fold(np.array(shingle_hashes(t.as_py(), size, seed), dtype=np.uint64)) for t in texts]
            out = pa.array(np.array(out, dtype=np.uint64).view(np.int64), pa.int64())
            keep = [i for i, n in enumerate(batch.schema.names) if n != "_text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), out],
                                             [*(batch.schema.names[i] for i in keep), "fp"])
    return run


def fingerprints(docs: DataFrame, size: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, fp): id, text hash, and the 64-bit fingerprint as a signed long."""
    with_workers(docs.sparkSession)
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("th"), text.alias("_text"))
    return rows.mapInArrow(_fingerprint_batches(size, seed), "id BIGINT, th BIGINT, fp BIGINT")


def quarters(fps: np.ndarray) -> np.ndarray:
    """Population counts of the four 16-bit quarters, one row per fingerprint."""
    return np.bitwise_count(np.ascontiguousarray(fps, dtype="<u8").view("<u2").reshape(-1, 4)).astype(np.int16)


def links(a: np.ndarray, b: np.ndarray, radius: int, tile: int = 512):
    """Row and column numbers of all pairs at most ``radius`` bits apart, tile pair by tile pair.
    Either side is best sorted by ``quarters``; tiles too far apart in them are skipped."""
    qa, qb = quarters(a), quarters(b)
    tiles = [(j, qb[j:j + tile].min(0), qb[j:j + tile].max(0)) for j in range(0, len(b), tile)]
    lows, highs = (np.array([t[k] for t in tiles]).reshape(-1, 4) for k in (1, 2))
    for i in range(0, len(a), tile):
        low, high = qa[i:i + tile].min(0), qa[i:i + tile].max(0)
        apart = (np.maximum(lows - high, 0) + np.maximum(low - highs, 0)).sum(1)
        for t in np.flatnonzero(apart <= radius):
            j = tiles[t][0]
            near = np.bitwise_count(a[i:i + tile, None] ^ b[None, j:j + tile]) <= radius
            if near.any():
                r, c = np.nonzero(near)
                yield i + r, j + c


class Forest:
    """Which rows a block pair's links join; labels are the smallest row number."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, rows: np.ndarray, cols: np.ndarray) -> None:
        while True:
            x, y = self.label[rows], self.label[cols]
            open_ = x != y
            if not open_.any():
                return
            rows, cols, x, y = rows[open_], cols[open_], x[open_], y[open_]
            np.minimum.at(self.label, np.maximum(x, y), np.minimum(x, y))
            while (up := self.label[self.label]).tobytes() != self.label.tobytes():
                self.label = up


def _block_batches(size: int):
    """Pack a sorted partition's fingerprints into blocks."""
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        held = np.zeros(0, dtype=np.int64)

        def packed(part, k):
            q = quarters(part.view(np.uint64))
            ranges = [pa.array([f(q.sum(1)).item()], pa.int32()) for f in (np.min, np.max)]
            ranges += [pa.array([f(q, 0).tolist()], pa.list_(pa.int32())) for f in (np.min, np.max)]
            return pa.RecordBatch.from_arrays(
                [pa.array([k], pa.int64()), *ranges, pa.array([part.astype("<i8").tobytes()], pa.binary())],
                ["block", "low", "high", "lows", "highs", "fps"])

        for batch in batches:
            held = np.concatenate([held, batch.column("fp").to_numpy(zero_copy_only=False)])
            while len(held) >= size:
                yield packed(held[:size], block)
                held, block = held[size:], block + 1
        if len(held):
            yield packed(held, block)
    return run


def _compare(radius: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for row in range(batch.num_rows):
                a = np.frombuffer(batch.column("fps")[row].as_py(), "<u8")
                b = np.frombuffer(batch.column("other_fps")[row].as_py(), "<u8")
                both = np.concatenate([a, b])
                forest = Forest(len(both))
                for r, c in links(a, b, radius):
                    forest.join(r, c + len(a))
                child = np.flatnonzero(forest.label != np.arange(len(both)))
                src, dst = both[child].view(np.int64), both[forest.label[child]].view(np.int64)
                apart = src != dst  # a block against itself holds every row twice
                yield pa.RecordBatch.from_arrays([pa.array(src[apart]), pa.array(dst[apart])], ["a", "b"])
    return run


def link_forest(fps: DataFrame, radius: int, block_rows: int = 16384) -> DataFrame:
    """Edges (a, b) between distinct fingerprints whose components are those of all links."""
    spark = with_workers(fps.sparkSession)
    count = lambda shift: F.bit_count(F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit(0xFFFF)))
    pop = F.bit_count("fp")
    blocks = stored(
        fps.repartitionByRange(pop, count(0), count(16), count(32), "fp").sortWithinPartitions(pop, count(0), count(16), count(32), "fp")
        .mapInArrow(_block_batches(block_rows), BLOCK_SCHEMA), "simhash-blocks")
    # cells (i, j), i <= j, of a grid with about as many cells as tasks: a block goes to the cells of its row and column
    groups = max(1, math.isqrt(2 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    own = blocks.withColumn("g", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int"))
    rows = own.withColumn("i", F.col("g")).withColumn("j", F.explode(F.sequence(F.col("g"), F.lit(groups - 1)))).drop("g")
    columns = (own.select(F.col("g").alias("j"), F.explode(F.sequence(F.lit(0), F.col("g"))).alias("i"),
                          *(F.col(c).alias(f"other_{c}") for c in blocks.columns)))
    gaps = F.zip_with(F.zip_with("other_lows", "highs", lambda x, y: x - y), F.zip_with("lows", "other_highs", lambda x, y: x - y),
                      lambda x, y: F.greatest(x, y, F.lit(0)))
    pairs = (rows.join(columns.hint("merge"), ["i", "j"])
             .where("i < j OR block <= other_block")
             .where((F.col("other_low") - F.col("high") <= radius) & (F.col("low") - F.col("other_high") <= radius))
             .where(F.aggregate(gaps, F.lit(0), lambda s, x: s + x) <= radius))
    return pairs.select("fps", "other_fps").mapInArrow(_compare(radius), "a BIGINT, b BIGINT")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of the edges (a, b): its component's smallest node, by
    large-star and small-star steps until the stars stay. Each step is written, so that plans stay
    short and a lost executor costs one step."""
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = (small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(least.select("u", F.col("m").alias("v"))).distinct())
        new = stored(small, name)
        changed = new.join(e, ["u", "v"], "left_anti").isEmpty() and e.join(new, ["u", "v"], "left_anti").isEmpty()
        e = new
        if changed:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, size: int = 4, radius: int = 4, seed: int = 42, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(id, th, fp, root, component_id) per row: its component's smallest fingerprint and the
    smallest id that links of at most ``radius`` bits reach."""
    rows = stored(fingerprints(docs, size, seed, id_col, text_col), "simhash")
    distinct = rows.groupBy("fp").agg(F.min("id").alias("id"))
    roots = components(link_forest(distinct.select("fp"), radius), "simhash-stars").withColumnRenamed("node", "fp")
    by_fp = stored(distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "simhash-roots")
    least = by_fp.groupBy("root").agg(F.min("id").alias("component_id"))
    return rows.join(by_fp.select("fp", "root").join(least, "root"), "fp").select("id", "th", "fp", "root", "component_id")


def hex_fingerprint(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))



def keep_one(docs: DataFrame, size: int = 4, radius: int = 4, seed: int = 42, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: the smallest id's (a null id last), of equal ids
    the smallest text hash, of rows equal in both any one."""
    found = near_duplicates(docs, size, radius, seed, id_col, text_col)
    stay = stored(found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "th")).alias("m"))
                  .select(F.coalesce("m.id", F.lit(NO_ID)).alias("_d"), F.col("m.th").alias("_th")), "simhash-stay")
    keyed = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_d"),
                        F.xxhash64(text_or_empty(text_col)).alias("_th"))
    one = Window.partitionBy("_d", "_th").orderBy("_th")
    return (keyed.join(stay.hint("shuffle_hash"), ["_d", "_th"], "left_semi").withColumn("n", F.row_number().over(one))
            .where("n = 1").select("row.*"))
