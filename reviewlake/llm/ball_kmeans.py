"""Operator 13, vector codes by product quantisation, its codebooks trained by ball k-means.

Vectors become integers, floor(scale * x), and are cut into ``parts`` equal parts; each part has a
codebook of its own. Vectors are written once as blocks of some thousand rows (a matrix each) and
never shuffled: a round sends the codebooks (entries times width, a fixed size) to the blocks, which
return sums and counts of each entry's members, added up by Spark to one row a component.

How a block finds each part's nearest entry (the method): the members of an entry in the last round
are its ball, whose radius is the distance of the farthest from the entry as it is now. Entries
farther away than twice that radius can win none of them; the others are its neighbours. A member
nearer to its entry than half way to the nearest neighbour is in the stable core and keeps its code
without another distance. The rest lie in rings between the halves of the sorted neighbour
distances, and a member of the i-th ring is held against the first i neighbours only. Balls are
taken per block, so the radii are no larger than the whole table's and the result is the same:
exactly the nearest entry, ties to the lower index. The last round's members are no stored state: a
block replays the earlier rounds, whose codebooks come along, from one full comparison on. This
costs a few skipped distances and saves a written and joined table a round.

Exact: distances are made in doubles while no value can pass 2^53, in 64-bit integers while none can
pass 2^62, else in Python's integers; an error past a long raises.

Defined cases: a vector that is null or holds null, NaN or infinity gives no row; all vectors count
as filled up with zeros to the longest one's length, and that to a multiple of ``parts``; repeated
rows count each; rows of equal id give one first entry (the smaller vector), null ids stand after all
others; with fewer ids than entries there are fewer entries; null labels are one label; an empty
table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, with_workers

BLOCK_ROWS, BLOCK_COMPONENTS = 16_384, 1 << 20
SUMS = "part INT, entry INT, place INT, limb INT, total DECIMAL(38,0)"
LIMB = 10 ** 18  #: sums are sent in digits of this base, so that any whole double's fits


def _kept(column, scale: int):
    """(places of the kept rows, their lengths, all their components as whole doubles)."""
    import pyarrow as pa

    lengths = np.array([x or 0 for x in column.value_lengths().to_pylist()], dtype=np.int64)
    flat = column.flatten()
    null = flat.is_null().to_numpy(zero_copy_only=False)
    x = flat.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore", invalid="ignore"):
        whole = np.floor(scale * x)
    row = np.repeat(np.arange(len(column)), lengths)
    good = column.is_valid().to_numpy(zero_copy_only=False).copy()
    good[row[null | ~np.isfinite(whole)]] = False
    return np.flatnonzero(good), lengths[good], whole[good[row]]


def _block_batches(scale: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            at, lengths, x = _kept(batch.column("v"), scale)
            ends = np.cumsum(lengths)
            first = 0
            while first < len(at):
                width = int(lengths[first:first + BLOCK_ROWS].max())
                last = min(len(at), first + max(1, min(BLOCK_ROWS, BLOCK_COMPONENTS // max(width, 1))))
                own = lengths[first:last]
                width = int(own.max())
                m = np.zeros((last - first, width))
                m[np.arange(width) < own[:, None]] = x[ends[first] - own[0]:ends[last - 1]]
                top = np.abs(m).max(initial=0)
                kind = "<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<f8"
                rows = pa.array(at[first:last])
                lists = [pa.ListArray.from_arrays(pa.array([0, last - first], pa.int32()), batch.column(c).take(rows))
                         for c in ("vec_id", "label")]
                yield pa.RecordBatch.from_arrays(
                    [*lists, pa.array([width], pa.int32()), pa.array([kind]), pa.array([m.astype(kind).tobytes()], pa.binary())],
                    ["ids", "labels", "width", "kind", "data"])
                first = last
    return run


def _matrix(kind: str, data: bytes, n: int, width: int, full: int, largest: int):
    """A block's rows filled up to ``full`` components, in a type that holds every distance;
    ``largest``: of the codebooks' components."""
    m = np.zeros((n, full))
    m[:, :width] = np.frombuffer(data, kind).reshape(n, width)
    most = 4 * full * (int(np.abs(m).max(initial=0)) + largest) ** 2  # four times a squared distance
    if most < 1 << 53:
        return m
    if most < 1 << 62:
        return m.astype(np.int64)
    return np.array([int(v) for v in m.ravel()], dtype=object).reshape(m.shape)


def nearest(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Each row's nearest entry, all distances made."""
    return np.stack([((x - c) ** 2).sum(1) for c in book]).argmin(0)


def ball_step(x: np.ndarray, codes: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Each row's nearest entry, from its entry in the round before."""
    between = ((book[:, None, :] - book[None, :, :]) ** 2).sum(2)
    out = codes.copy()
    for j in range(len(book)):
        members = np.flatnonzero(codes == j)
        if not len(members):
            continue
        own = ((x[members] - book[j]) ** 2).sum(1)
        reach = 4 * own
        others = [k for k in range(len(book)) if k != j and between[j, k] <= reach.max()]  # the ball's neighbours
        if not others:
            continue
        others.sort(key=lambda k: between[j, k])
        rings = np.searchsorted(np.array([between[j, k] for k in others], dtype=x.dtype), reach, side="right")
        order = np.argsort(-rings, kind="stable")
        order = order[:np.count_nonzero(rings)]  # the others are in the stable core
        left, best, who = members[order], own[order], np.full(len(order), j)
        rings = rings[order]
        for i, k in enumerate(others):
            n = np.searchsorted(-rings, -i, side="left")  # rows of a ring beyond the i-th neighbour
            if not n:
                break
            d = ((x[left[:n]] - book[k]) ** 2).sum(1)
            wins = (d < best[:n]) | ((d == best[:n]) & (k < who[:n]))
            best[:n][wins] = d[wins]
            who[:n][wins] = k
        out[left] = who
    return out


def _coded(row_data, books: list):
    """Per part: (the block's part, codes under the last codebooks). ``books``: of each round, lists
    by part and entry of whole numbers."""
    full = sum(len(part[0]) for part in books[0])
    largest = max((abs(v) for b in books for part in b for e in part for v in e), default=0)
    x = _matrix(*row_data, full, largest)
    at = 0
    for p in range(len(books[0])):
        w = len(books[0][p][0])
        own = x[:, at:at + w]
        made = [np.array(b[p], dtype=x.dtype).reshape(len(b[p]), w) for b in books]
        codes = nearest(own, made[0])
        for book in made[1:]:
            codes = ball_step(own, codes, book)
        yield p, own, codes, made[-1]
        at += w


def _blocks_of(batch):
    for i in range(batch.num_rows):
        ids, labels, width, kind, data = (batch.column(c)[i] for c in ("ids", "labels", "width", "kind", "data"))
        yield ids.values, labels.values, (kind.as_py(), data.as_py(), len(ids), width.as_py())


def limbs(v: int):
    """(place, digit) of ``v`` to the base LIMB, all digits of its sign."""
    sign, v, i = (-1 if v < 0 else 1), abs(v), 0
    while v or not i:
        v, digit = divmod(v, LIMB)
        yield i, sign * digit
        i += 1


def _sum_batches(books: list):
    def run(batches):
        import pyarrow as pa

        sums: dict[tuple, list[int]] = {}
        for batch in batches:
            for _, _, data in _blocks_of(batch):
                for p, own, codes, book in _coded(data, books):
                    for e in np.unique(codes):
                        members = own[codes == e]
                        # in exact parts: a sum of doubles below 2^53 each may pass it
                        whole = members.astype(np.int64) if members.dtype != object else members
                        new = [len(members), *map(int, whole.sum(0))]
                        had = sums.get((p, int(e)))
                        sums[p, int(e)] = [a + b for a, b in zip(had, new, strict=True)] if had else new
        rows = [(p, e, k - 1, i, Decimal(digit)) for (p, e), own in sums.items() for k, v in enumerate(own) for i, digit in limbs(v)]
        types = (*[pa.int32()] * 4, pa.decimal128(38, 0))
        for at in range(0, len(rows), 8192):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at:at + 8192], strict=True), types, strict=True)],
                                             ["part", "entry", "place", "limb", "total"])
    return run


def _first_batches(entries: int):
    """A block's rows that may be among the smallest ids of all."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for ids, _, (kind, data, n, width) in _blocks_of(batch):
                m = np.frombuffer(data, kind).reshape(n, width).astype("<f8")
                ids = ids.to_pylist()
                best: dict = {}
                chosen = sorted({i for i in ids if i is not None})[:entries]
                wanted = {*chosen, None} if len(chosen) < entries else {*chosen}
                for i, v in zip(ids, m, strict=True):
                    if i in wanted:
                        v = v.tolist()
                        best[i] = min(best.get(i, v), v)
                yield pa.RecordBatch.from_arrays([pa.array([*best], pa.int64()), pa.array([*best.values()], pa.list_(pa.float64()))],
                                                 ["vec_id", "v"])
    return run


def _code_batches(books: list):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for ids, labels, data in _blocks_of(batch):
                codes, error = [], 0
                for _, own, c, book in _coded(data, books):
                    codes.append(c)
                    error = error + ((own - book[c]) ** 2).sum(1)
                names = [f"{e:02x}" for e in range(max(map(len, books[-1])))]
                text = ["".join(names[e] for e in row) for row in np.stack(codes, 1).tolist()]
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array(text), pa.array([int(e) for e in error], pa.int64())],
                                                 ["vec_id", "label", "code", "error"])
    return run


def blocks(vectors: DataFrame, scale: int, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """The kept vectors as integer matrices, written once."""
    with_workers(vectors.sparkSession)
    read = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v"), F.col(label_col).alias("label"))
    kind = read.schema["label"].dataType.simpleString()
    return stored(read.mapInArrow(_block_batches(scale), f"ids ARRAY<BIGINT>, labels ARRAY<{kind}>, width INT, kind STRING, data BINARY"),
                  "pq-blocks")


def first_entries(made: DataFrame, parts: int, entries: int) -> list:
    """Codebooks from the vectors of the smallest ids: lists by part and entry; [] without rows."""
    (longest,) = made.agg(F.max("width")).first()
    if longest is None:
        return []
    w = -(-longest // parts)
    rows = (made.mapInArrow(_first_batches(entries), "vec_id BIGINT, v ARRAY<DOUBLE>").groupBy("vec_id").agg(F.min("v").alias("v"))
            .orderBy(F.col("vec_id").asc_nulls_last()).limit(entries).collect())
    whole = [[*map(int, r.v), *[0] * (w * parts - len(r.v))] for r in rows]
    return [[v[p * w:(p + 1) * w] for v in whole] for p in range(parts)]


def train(made: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6) -> list:
    """The codebooks of every round, from the first entries to the final ones."""
    books = [first_entries(made, parts, entries)]
    if not books[0]:
        return []
    for _ in range(rounds):
        sums = (made.mapInArrow(_sum_batches(books), SUMS).groupBy("part", "entry", "place", "limb")
                .agg(F.sum("total").alias("total")).collect())  # one row a component of an entry (and digit)
        total: dict[tuple, int] = {}
        for r in sums:
            at = (r.part, r.entry, r.place)
            total[at] = total.get(at, 0) + int(r.total) * LIMB ** r.limb
        books.append([[[total[p, e, k] // total[p, e, -1] for k in range(len(old))] if (p, e, -1) in total else old
                       for e, old in enumerate(book)] for p, book in enumerate(books[-1])])
    return books


def digest(books: list) -> str:
    """SHA-256 of the final entries' components by part, entry and place, comma-joined."""
    return hashlib.sha256(",".join(str(v) for part in books[-1] for e in part for v in e).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096,
             id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Per kept row: ``vec_id``, ``label``, ``code`` (two hex digits a part), ``error`` (squared
    distance to its entries), ``label_error`` (summed over its label), ``codebooks_sha256``."""
    if not 1 <= entries <= 256:
        raise ValueError("a code of two hex digits names 1 to 256 entries")
    made = blocks(vectors, scale, id_col, vec_col, label_col)
    books = train(made, parts, entries, rounds)
    kind = made.schema["labels"].dataType.elementType.simpleString()
    schema = f"vec_id BIGINT, label {kind}, code STRING, error BIGINT"
    if not books:
        coded = made.sparkSession.createDataFrame([], schema)
        return coded.withColumns({"label_error": F.lit(0).cast("long"), "codebooks_sha256": F.lit("")})
    coded = stored(made.mapInArrow(_code_batches(books), schema), "pq-codes")
    by_label = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of_label")
    return (coded.join(by_label, F.col("label").eqNullSafe(F.col("of_label")), "left")
            .drop("of_label").withColumn("codebooks_sha256", F.lit(digest(books))))
