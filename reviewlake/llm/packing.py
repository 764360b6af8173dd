"""Operator 3, best-fit packing of documents into training sequences.

Each task encodes its documents and packs them as they come: a document of more than ``capacity``
ids is cut so that all its pieces but the first are full; a full piece is a sequence of its own;
any other goes to the open bin with the least room that still fits (bounded-space best fit). Open
bins are kept by free room, with one bit per room that occurs, so that the best bin is the lowest
set bit from the piece's length on. At most ``open_bins`` are open: when one more is needed, the
fullest closes first. The pieces of one batch are placed longest first, which only changes the
order in which they come.

A task emits a sequence's pieces when its bin closes. The pieces of the bins that are still open and have
more than 1/64 of their room left at its end (at most ``open_bins`` bins) come last, marked; ``merge_tasks``
tasks' pieces of that kind meet and are packed once more in the same way, longest first. So the number of
sequences does not follow the number of partitions. All pieces are stored once under the checkpoint
folder for that; the marked ones alone are shuffled, at most ``merge_tasks * open_bins * capacity`` ids
to a task (128 MB with the defaults). A task's sequences are numbered by its partition, and a task that runs again
replaces its rows as a whole.

Defined cases: null text is the empty text (its only id is the end id); repeated rows are packed
each; an empty table gives no rows; columns other than id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, text_or_empty, with_workers
from .tokens import encoder

SCHEMA = ("doc_id BIGINT, piece INT, start BIGINT, length BIGINT, token_ids BINARY, sequence_id BIGINT, "
          "offset BIGINT")
NAMES = ["doc_id", "piece", "start", "length", "token_ids", "sequence_id", "offset"]
MERGED = 1 << 62  # sequences of the second packing are numbered from here on


class Bins:
    """Open bins of one task, by free room."""

    def __init__(self, capacity: int, open_bins: int, first_id: int):
        self.capacity, self.most, self.next_id = capacity, open_bins, first_id
        self.rooms: dict[int, list[int]] = {}
        self.bits = self.count = 0
        self.closed: list[int] = []  # since the caller last looked

    def _take(self, room: int) -> int:
        bins = self.rooms[room]
        found = bins.pop()
        self.count -= 1
        if not bins:
            del self.rooms[room]
            self.bits ^= 1 << room
        return found

    def place(self, length: int) -> tuple[int, int]:
        """(sequence, offset) of a piece of ``length`` ids."""
        fitting = self.bits >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            found = self._take(room)
        else:
            room, found = self.capacity, self.next_id
            self.next_id += 1
        left = room - length
        if left:
            if self.count == self.most:  # the fullest closes
                self.closed.append(self._take((self.bits & -self.bits).bit_length() - 1))
            self.rooms.setdefault(left, []).append(found)
            self.bits |= 1 << left
            self.count += 1
        else:
            self.closed.append(found)
        return found, self.capacity - room


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids; only the first may be short."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    return ([(0, first)] if first else []) + [(s, capacity) for s in range(first, n, capacity)]


def _table(rows, marked: bool | None = None):
    """Rows (doc, piece, start, length, ids, sequence, offset) as an Arrow batch."""
    import pyarrow as pa

    types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
    columns = [pa.array([r[c] for r in rows], t) for c, t in enumerate(types)]
    if marked is None:
        return pa.RecordBatch.from_arrays(columns, NAMES)
    return pa.RecordBatch.from_arrays([*columns, pa.array([marked] * len(rows), pa.bool_())], [*NAMES, "marked"])


def _pack_batches(tokenizer_path: str, capacity: int, end_id: int, open_bins: int):
    def run(batches):
        import numpy as np
        from pyspark import TaskContext

        enc = encoder(tokenizer_path)
        bins = Bins(capacity, open_bins, TaskContext.get().partitionId() << 32)
        end = np.array([end_id], dtype="<u4").tobytes()
        held: dict[int, list] = {}  # the pieces of open bins
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                pieces = []
                for doc, ids in zip(part.column("doc_id").to_pylist(), enc.encode(part.column("t").to_pylist()), strict=True):
                    ids += end
                    pieces += [(n, doc, k, s, ids[4 * s:4 * (s + n)])
                               for k, (s, n) in enumerate(cut(len(ids) // 4, capacity))]
                pieces.sort(key=lambda p: -p[0])
                for n, doc, k, s, ids in pieces:
                    sequence, offset = bins.place(n)
                    held.setdefault(sequence, []).append((doc, k, s, n, ids, sequence, offset))
                yield _table([r for sequence in bins.closed for r in held.pop(sequence)], False)
                bins.closed.clear()
        left = {found: room > capacity // 64 for room, some in bins.rooms.items() for found in some}
        for marked in (False, True):
            rows = [r for sequence, own in held.items() if left[sequence] == marked for r in own]
            for at in range(0, len(rows), 2048):
                yield _table(rows[at:at + 2048], marked)
    return run


def _pack_again(capacity: int, open_bins: int):
    """The marked pieces of some tasks, in new sequences."""
    def run(key, table):
        import pyarrow as pa

        bins = Bins(capacity, open_bins, MERGED + (key[0].as_py() << 32))
        table = table.select(NAMES).sort_by([("length", "descending"), ("sequence_id", "ascending"), ("offset", "ascending")])
        placed = [bins.place(n) for n in table.column("length").to_pylist()]
        return (table.set_column(5, "sequence_id", pa.array([p[0] for p in placed], pa.int64()))
                .set_column(6, "offset", pa.array([p[1] for p in placed], pa.int64())))
    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, open_bins: int = 1024,
         id_col: str = "doc_id", text_col: str = "text", merge_tasks: int = 16) -> DataFrame:
    """One row per piece: where it stands in its document and in its sequence, and its ids
    (unsigned 32-bit, little-endian)."""
    with_workers(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("t"))
    first = stored(texts.mapInArrow(_pack_batches(tokenizer_path, capacity, end_id, open_bins), SCHEMA + ", marked BOOLEAN"),
                   "packed-pieces", "zstd")
    tasks = F.floor(F.shiftright("sequence_id", 32) / merge_tasks)
    again = (first.where("marked").groupBy(tasks.cast("long").alias("tasks"))
             .applyInArrow(_pack_again(capacity, open_bins), SCHEMA))
    return first.where("NOT marked").drop("marked").unionByName(again)
