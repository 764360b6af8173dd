"""Operator 10, exact top-k by tiled integer matrix products.

Vectors become integers, floor(scale * x), and are packed into tiles of some thousand rows; the
queries into blocks likewise. Every block meets every tile once (the stated query set against all
rows, block by block; tiles and blocks are dealt over a grid of tasks): one matrix product, in which
the rows of a query's own id rank last, then a partial selection of each query's k best of the
tile, merged at once into the lists of the task. The rows are sorted before they are cut into tiles, so that a task that
runs again, whose shuffle read comes in another order, packs the same tiles. A task keeps the lists of at most ``kept_queries``
queries (24 MB with the defaults) and emits them when there are more and at its end, so each query has k rows of each task that
it is dealt to, whatever the number of tiles; these meet by query.

Scores are exact: a product is made in doubles while no sum can pass 2^53, in 64-bit integers
while none can pass 2^63, else in Python's integers, where a score outside a long raises an error.

Defined cases: a vector that is null or holds null, NaN or infinity takes no part, nor does a
row without ``id``; rows of equal id and vector count once (where vectors of one id differ, each is
a candidate, and as a query they share one list); a candidate of the query's own id is
no candidate; shorter vectors count as filled up with zeros; ties go to the smaller id; queries
with fewer than k candidates list all; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import with_workers

TILE_SCHEMA = "tile BIGINT, width INT, ids BINARY, m BINARY"
HIT_SCHEMA = "query_id BIGINT, vec_id BIGINT, score BIGINT"


def integer_vectors(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(vec_id, v array<double> of whole numbers) of the rows that take part."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    good = ~F.exists(F.col(vec_col), lambda x: x.isNull() | F.isnan(x.cast("double"))
                     | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    return (vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & good)
            .select(F.col(id_col).cast("long").alias("vec_id"),
                    F.transform(v, lambda x: _floor(x * F.lit(float(scale)))).alias("v"))
            .dropDuplicates(["vec_id", "v"]))


def _floor(x):
    """floor() of a double as a double: those past 2^52 are whole as they are."""
    return F.when(F.abs(x) < F.lit(2.0 ** 52), F.floor(x).cast("double")).otherwise(x)


def _tiles(size: int):
    """Pack a partition's vectors into tiles of at most ``size`` rows."""
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        made = TaskContext.get().partitionId() << 32

        def packed(ids, rows, k):
            width = max(map(len, rows), default=0)
            m = np.zeros((len(rows), width))
            for i, r in enumerate(rows):
                m[i, :len(r)] = r
            order = np.argsort(np.array(ids, dtype=np.int64), kind="stable")
            return pa.RecordBatch.from_arrays([
                pa.array([k], pa.int64()), pa.array([width], pa.int32()),
                pa.array([np.array(ids, dtype="<i8")[order].tobytes()], pa.binary()),
                pa.array([m[order].astype("<f8").tobytes()], pa.binary())], ["tile", "width", "ids", "m"])

        ids, rows = [], []
        for batch in batches:
            ids += batch.column("vec_id").to_pylist()
            rows += [r.values.to_numpy(zero_copy_only=False) for r in batch.column("v")]
            while len(ids) >= size:
                yield packed(ids[:size], rows[:size], made)
                ids, rows, made = ids[size:], rows[size:], made + 1
        if ids:
            yield packed(ids, rows, made)
    return run


def tiled(whole: DataFrame, size: int) -> DataFrame:
    """Tiles of at most ``size`` rows, the same whatever the order of the rows in a partition."""
    return whole.sortWithinPartitions("vec_id", "v").mapInArrow(_tiles(size), TILE_SCHEMA)


def scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact products of whole-number matrices; the narrower is filled up with zeros."""
    width = min(q.shape[1], v.shape[1])
    q, v = q[:, :width], v[:, :width]
    most = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * max(1, width)
    if most < 2.0 ** 53:
        return (q @ v.T).astype(np.int64)
    if most < 2.0 ** 62:
        return q.astype(np.int64) @ v.astype(np.int64).T
    exact = np.array([[int(x) for x in r] for r in q], dtype=object).reshape(q.shape) @ \
        np.array([[int(x) for x in r] for r in v], dtype=object).reshape(v.shape).T
    if exact.size and max(abs(int(exact.max())), abs(int(exact.min()))) >= 2 ** 63:
        raise OverflowError("a score doesn't fit a 64-bit integer")
    return exact.astype(np.int64)


def best(s: np.ndarray, k: int) -> np.ndarray:
    """Column numbers of each row's k highest, ties to the smaller column; any order."""
    n = s.shape[1]
    if n <= k:
        return np.broadcast_to(np.arange(n), s.shape)
    if max(abs(int(s.max())), abs(int(s.min()))) < 2 ** 62 // n:
        return np.argpartition(s * n + (n - 1 - np.arange(n)), n - k, axis=1)[:, n - k:]
    return np.argsort(-s.astype(object), axis=1, kind="stable")[:, :k]


def own_last(s: np.ndarray, q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """``s`` with the scores of rows of the query's own id (``v`` is in order) below all others."""
    first, end = np.searchsorted(v, q, "left"), np.searchsorted(v, q, "right")
    met = np.flatnonzero(first < end)
    if len(met):
        least = int(s.min()) - 1
        if least < -2 ** 63:
            raise OverflowError("a score doesn't fit beside the mark below it")
        for i in met:
            s[i, first[i]:end[i]] = least
    return s


class Lists:
    """The k best candidates of each query of a block so far."""

    def __init__(self, queries: np.ndarray, k: int):
        self.queries, self.k = queries, k
        self.score = np.zeros((len(queries), 0), np.int64)
        self.vec = np.zeros((len(queries), 0), np.int64)
        self.good = np.zeros((len(queries), 0), bool)

    def add(self, score: np.ndarray, vec: np.ndarray) -> None:
        """Candidates of each query, one row each; those of its own id are left out."""
        score, vec = np.concatenate([self.score, score], 1), np.concatenate([self.vec, vec], 1)
        good = np.concatenate([self.good, vec[:, self.good.shape[1]:] != self.queries[:, None]], 1)
        order = np.lexsort((vec, ~score, ~good), axis=1)[:, :self.k]  # ~ turns the order without an overflow
        self.score, self.vec, self.good = (np.take_along_axis(x, order, 1) for x in (score, vec, good))

    def batch(self):
        import pyarrow as pa

        every = np.broadcast_to(self.queries[:, None], self.good.shape)
        return pa.RecordBatch.from_arrays([pa.array(x[self.good], pa.int64()) for x in (every, self.vec, self.score)],
                                          ["query_id", "vec_id", "score"])


def _products(k: int, kept_queries: int):
    def run(batches):
        lists: dict[int, Lists] = {}
        kept = 0
        for batch in batches:
            for row in range(batch.num_rows):
                at = lambda c: batch.column(c)[row].as_py()  # noqa: B023, E731
                qi, vi = np.frombuffer(at("q_ids"), "<i8"), np.frombuffer(at("ids"), "<i8")
                q = np.frombuffer(at("q_m"), "<f8").reshape(len(qi), at("q_width"))
                v = np.frombuffer(at("m"), "<f8").reshape(len(vi), at("width"))
                if at("q_tile") not in lists:
                    if kept and kept + len(qi) > kept_queries:
                        yield from (own.batch() for own in lists.values())
                        lists.clear()
                        kept = 0
                    lists[at("q_tile")] = Lists(qi, k)
                    kept += len(qi)
                found = []
                for i in range(0, len(qi), 256):
                    s = own_last(scores(q[i:i + 256], v), qi[i:i + 256], vi)
                    col = best(s, k)
                    found.append((np.take_along_axis(s, col, 1), vi[col]))
                lists[at("q_tile")].add(*(np.concatenate(x) for x in zip(*found, strict=True)))
        yield from (own.batch() for own in lists.values())
    return run


def top_k(vectors: DataFrame, is_query, k: int = 20, scale: int = 64, id_col: str = "vec_id",
          vec_col: str = "embedding", tile_rows: int = 4096, block_rows: int = 1024, kept_queries: int = 65_536) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best rows for each row that ``is_query`` (a column
    over ``vec_id``) picks."""
    spark = with_workers(vectors.sparkSession)
    whole = integer_vectors(vectors, id_col, vec_col, scale)
    tiles, blocks = tiled(whole, tile_rows), tiled(whole.where(is_query), block_rows)
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    across = max(1, round((width / 20) ** 0.5))  # queries are far fewer than rows
    down = -(-width // across)
    pairs = (tiles.withColumn("i", F.pmod(F.xxhash64("tile"), F.lit(down)).cast("int"))
             .withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))
             .join(blocks.select(F.pmod(F.xxhash64("tile"), F.lit(across)).cast("int").alias("j"),
                                 F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("i"),
                                 F.col("tile").alias("q_tile"), F.col("width").alias("q_width"), F.col("ids").alias("q_ids"),
                                 F.col("m").alias("q_m")), ["i", "j"]))
    hits = pairs.mapInArrow(_products(k, kept_queries), HIT_SCHEMA)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id").asc())
    return (hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
