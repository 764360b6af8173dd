"""Operator 11, first-fit decreasing packing in randomised groups of documents.

Documents are encoded where they are read and dealt to random groups of about ``group_bytes`` of
text; each group is packed by itself. A document longer than a sequence gives whole sequences and
one last piece; the pieces of a group are placed longest first, each into the first sequence with
room for it. The free room of all sequences stands in a tournament tree (each inner place holds the
larger of its two below), so that the first one with enough room is found in as many steps as the
tree has levels, and one that was never used is simply the first with all its room.

What first fit leaves open is closed by cuts: the sequences with the least in them are emptied into
the gaps of the others, and what the last one holds is dealt to sequences whose lengths are powers
of two, which need no padding. So a group has no padding at all, and cuts a shorter document only
there.

A group is drawn from a hash of id, text, the number of equal rows before it in its task and, for
repeats, the task: copies spread over all groups, a rerun of a task draws the same groups in
whatever order its rows come, and no group grows with the table. One task works on one group at a
time and holds its ids alone (4 bytes a token).

Defined cases: null text is the empty text (its only id is the end id); repeated rows are packed
each; a null id is an id like any other; an empty table gives no rows; columns other than id and
text are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, with_workers
from .tokens import encoder

ENCODED = "grp BIGINT, h BIGINT, doc_id BIGINT, ids BINARY"
SCHEMA = ("doc_id BIGINT, start BIGINT, length BIGINT, token_ids BINARY, doc_tokens BIGINT, sequence_id BIGINT, "
          "offset BIGINT")


class RoomTree:
    """Free rooms of numbered bins; ``place`` takes room in the first bin that has enough."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(bins - 1, 0).bit_length()
        self.most = [capacity] * (2 * self.leaves)

    def place(self, length: int) -> int:
        most, at = self.most, 1
        if most[1] < length:
            raise ValueError("no bin has room")
        while at < self.leaves:
            at *= 2
            if most[at] < length:
                at += 1
        found = at - self.leaves
        most[at] -= length
        while at > 1:
            at >>= 1
            larger = max(most[2 * at], most[2 * at + 1])
            if most[at] == larger:
                break
            most[at] = larger
        return found


def first_fit_decreasing(pieces: list[tuple], capacity: int) -> list[list[tuple]]:
    """Sequences of ``pieces`` (length, key, document, start), all of at most ``capacity`` ids."""
    pieces = sorted(pieces, key=lambda p: (-p[0], *p[1:]))
    # any two neighbouring sequences hold more than one full one
    tree = RoomTree(2 * -(-sum(p[0] for p in pieces) // capacity) + 1, capacity)
    bins: list[list[tuple]] = []
    for p in pieces:
        at = tree.place(p[0])
        if at == len(bins):
            bins.append([])
        bins[at].append(p)
    return bins


def _split(piece: tuple, length: int) -> tuple[tuple, tuple]:
    """The first ``length`` ids of a piece, and its rest."""
    n, key, doc, start = piece
    return (length, key, doc, start), (n - length, key, doc, start + length)


def close_gaps(bins: list[list[tuple]], capacity: int) -> list[list[tuple]]:
    """The same ids in sequences that are full or hold a power of two: the emptiest give way."""
    full, rest = [], []
    for b in bins:
        (full if sum(p[0] for p in b) == capacity else rest).append(b)
    rest.sort(key=lambda b: -sum(p[0] for p in b))
    taker, giver = 0, len(rest) - 1
    while taker < giver:
        gap = capacity - sum(p[0] for p in rest[taker])
        while gap and taker < giver:
            piece = rest[giver].pop()
            if piece[0] > gap:
                piece, left = _split(piece, gap)
                rest[giver].append(left)
            rest[taker].append(piece)
            gap -= piece[0]
            if not rest[giver]:
                giver -= 1
        if not gap:
            full.append(rest[taker])
            taker += 1
    if taker == giver:
        last = rest[taker][::-1]
        size = sum(p[0] for p in last)
        while size:
            part, room = [], min(capacity, 1 << (size.bit_length() - 1))
            size -= room
            while room:
                piece = last.pop()
                if piece[0] > room:
                    piece, left = _split(piece, room)
                    last.append(left)
                part.append(piece)
                room -= piece[0]
            full.append(part)
    return full


def pack_group(lengths: list[int], keys: list, capacity: int) -> list[list[tuple]]:
    """Sequences of one group: lists of (length, key, document's place in the group, start)."""
    whole, pieces = [], []
    for doc, (n, key) in enumerate(zip(lengths, keys, strict=True)):
        cut = n - n % capacity
        whole += [[(capacity, key, doc, s)] for s in range(0, cut, capacity)]
        if n > cut:
            pieces.append((n - cut, key, doc, cut))
    return whole + close_gaps(first_fit_decreasing(pieces, capacity), capacity)


def _mix(h: int) -> int:
    """The 64 bits of ``h``, each made to depend on all (the finaliser of splitmix64)."""
    h &= (1 << 64) - 1
    h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
    h = (h ^ h >> 27) * 0x94D049BB133111EB & (1 << 64) - 1
    return h ^ h >> 31


def _encode_batches(tokenizer_path: str, end_id: int, groups: int, seed: int):
    def run(batches):
        import pyarrow as pa
        import xxhash
        from pyspark import TaskContext

        enc = encoder(tokenizer_path)
        end, task = np.array([end_id], dtype="<u4").tobytes(), TaskContext.get().partitionId() + 1
        seen: dict[int, int] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                docs, texts = part.column("doc_id").to_pylist(), part.column("t").to_pylist()
                keys, drawn = [], []
                for doc, text in zip(docs, texts, strict=True):
                    h = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), _mix(seed * 31 + (doc or 0)))
                    before = seen.get(h, 0)
                    seen[h] = before + 1
                    keys.append(h >> 1)
                    drawn.append(_mix(h + (before * 1_000_003 + task if before else 0)) % groups)
                yield pa.RecordBatch.from_arrays([
                    pa.array(drawn, pa.int64()), pa.array(keys, pa.int64()), pa.array(docs, pa.int64()),
                    pa.array([ids + end for ids in enc.encode(texts)], pa.binary())], ["grp", "h", "doc_id", "ids"])
    return run


def _pack_batches(capacity: int):
    def run(batches):
        import pyarrow as pa

        def packed(grp, keys, docs, ids):
            # equal keys: equal documents (or as good as), so the id settles the order
            order = sorted(range(len(docs)), key=lambda i: (keys[i], docs[i] is not None, docs[i] or 0, len(ids[i]), ids[i]))
            docs, ids = [docs[i] for i in order], [ids[i] for i in order]
            seqs = pack_group([len(x) // 4 for x in ids], [keys[i] for i in order], capacity)
            out = [(docs[d], s, n, ids[d][4 * s:4 * (s + n)], len(ids[d]) // 4, (grp << 32) + k, off)
                   for k, seq in enumerate(seqs)
                   for (n, _, d, s), off in zip(seq, np.cumsum([0] + [p[0] for p in seq]).tolist())]  # noqa: B905
            for at in range(0, len(out), 4096):
                cols = list(zip(*out[at:at + 4096], strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.binary() if k == 3 else pa.int64()) for k, c in enumerate(cols)],
                    ["doc_id", "start", "length", "token_ids", "doc_tokens", "sequence_id", "offset"])

        now, held = None, ([], [], [])
        for batch in batches:
            for grp, *row in zip(*(batch.column(c).to_pylist() for c in ("grp", "h", "doc_id", "ids")), strict=True):
                if grp != now:
                    if held[0]:
                        yield from packed(now, *held)
                    now, held = grp, ([], [], [])
                for column, x in zip(held, row, strict=True):
                    column.append(x)
        if held[0]:
            yield from packed(now, *held)
    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 2, group_bytes: int = 4 << 20,
         seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: where it stands in its document (``start``, of ``doc_tokens`` ids) and in
    its sequence (``offset``), and its ids (unsigned 32-bit, little-endian)."""
    with_workers(docs.sparkSession)
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("t"))
    size = texts.agg(F.sum(F.octet_length("t").cast("long") + 1)).first()[0] or 0
    groups = max(1, -(-size // group_bytes))
    encoded = texts.mapInArrow(_encode_batches(tokenizer_path, end_id, groups, seed), ENCODED)
    return (encoded.repartition("grp").sortWithinPartitions("grp")
            .mapInArrow(_pack_batches(capacity), SCHEMA))
