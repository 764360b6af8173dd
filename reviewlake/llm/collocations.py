"""Operator 12, phrase collocations by Rabin-Karp fingerprints.

1. Texts become chunks of about ``chunk_bytes`` of one language: lower case, words apart by blanks,
   pieces by line feeds. Chunks are compressed and written once.
2. In a chunk, each word has a hash, and prefix polynomials over the words (numpy, modulo 2^64; an
   odd base has an inverse, so that a run's value doesn't depend on its place) give every n-gram's
   fingerprint. Equal fingerprints are counted; whether their words are equal too is seen at once
   by the chunk's exact word numbers, and where not, they are counted apart.
3. Counts go with one occurrence pointer each (chunk and place in it) to buckets of fingerprint
   ranges, as arrays; a bucket adds them up and keeps the fingerprints that reach ``min_count``.
4. Only their pointers go back to the chunks, which write those phrases out; the final counts are
   grouped by language and text, so fingerprints that collide between chunks part here. A phrase's
   count is at most its fingerprint's, so that none is lost.
5. Cuts, scores and ranks are joins and windows over the frequent phrases alone, in decimals of 38
   digits (exact while the counts stay under 10^16).

A common phrase is one entry a chunk, whatever its number. Buckets grow in number with the bytes, and
a chunk's entries and a bucket's arrays are all that a task holds (a text longer than a chunk is a
chunk of its own).

Defined cases: null text is the empty text; a null language is ``und``, as is that of a language
named so; repeated rows count each; an empty table gives no rows; id and other columns aren't read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, stored, text_or_empty, with_workers

CHUNKS = "chunk BIGINT, lang STRING, words BIGINT, text BINARY"
ENTRIES = "bucket BIGINT, chunk BIGINT, data BINARY"
HITS = "chunk BIGINT, data BINARY"
PHRASES = "lang STRING, n INT, phrase BINARY, f BIGINT"
ENTRY = np.dtype([("fp", "<u8"), ("f", "<u4"), ("at", "<u4")])
HIT = np.dtype([("f", "<u4"), ("at", "<u4"), ("n", "u1")])

_MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2^64
INVERSE = pow(BASE, -1, 1 << 64)


def _letters() -> bytes:
    """Byte by byte: A-Z lower, tab a blank, the signs that end a piece a line feed."""
    table = bytearray(range(256))
    for c in range(ord("A"), ord("Z") + 1):
        table[c] = c + 32
    table[ord("\t")] = ord(" ")
    for c in b".,;:!?\n\x0b\x0c\r":
        table[c] = ord("\n")
    return bytes(table)


LETTERS = _letters()


def _chunk_batches(chunk_bytes: int):
    def run(batches):
        import pyarrow as pa
        import zstandard
        from pyspark import TaskContext

        made = TaskContext.get().partitionId() << 32
        pack = zstandard.ZstdCompressor()
        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}

        def chunk(lang):
            nonlocal made
            text = b"\n".join(held.pop(lang))
            del sizes[lang]
            b = np.frombuffer(text, dtype=np.uint8)
            inside = (b != 32) & (b != 10)
            words = int(inside[:1].sum() + np.count_nonzero(inside[1:] & ~inside[:-1]))
            made += 1
            return pa.RecordBatch.from_arrays(
                [pa.array([made - 1]), pa.array([lang]), pa.array([words]), pa.array([pack.compress(text)], pa.binary())],
                ["chunk", "lang", "words", "text"])

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("t"), strict=True):
                text = text.as_buffer().to_pybytes().translate(LETTERS)
                held.setdefault(lang, []).append(text)
                sizes[lang] = sizes.get(lang, 0) + len(text) + 1
                if sizes[lang] >= chunk_bytes:
                    yield chunk(lang)
                while sum(sizes.values()) >= 4 * chunk_bytes:  # many languages: the largest part goes
                    yield chunk(max(sizes, key=sizes.get))
        for lang in [*held]:
            yield chunk(lang)
    return run


def split_words(packed: bytes) -> list[bytes]:
    """A chunk's words in order; a line feed stands for the end of a piece."""
    import zstandard

    text = zstandard.ZstdDecompressor().decompress(packed)
    return [w for w in text.replace(b"\n", b" \n ").split(b" ") if w]


class _Numbers(dict):
    def __missing__(self, word):
        n = self[word] = len(self)
        return n


def numbered(words: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """Each word's exact number in the chunk (0: the end of a piece), and the words by number."""
    numbers = _Numbers({b"\n": 0})
    ids = np.fromiter(map(numbers.__getitem__, words), dtype=np.int64, count=len(words))
    return ids, [*numbers]


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 ... base^(n-1) modulo 2^64."""
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def fingerprints(ids: np.ndarray, words: list[bytes], lang: str, most: int, bits: int):
    """For n = 1 ... ``most``: (places of the n-grams inside pieces, their fingerprints)."""
    import xxhash

    seed = xxhash.xxh64_intdigest(lang.encode())
    hashes = np.array([xxhash.xxh64_intdigest(w, seed) for w in words], dtype=np.uint64)[ids]
    up, down = _powers(BASE, len(ids)), _powers(INVERSE, len(ids))
    prefix = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(hashes * up, dtype=np.uint64)])
    inside = ids != 0
    for n in range(1, most + 1):
        if len(ids) < n:
            return
        if n > 1:
            inside = inside[:-1] & (ids[n - 1:] != 0)
        at = np.flatnonzero(inside)
        fp = (prefix[at + n] - prefix[at]) * down[at]
        fp ^= np.uint64(n * 0xD6E8FEB86659FD93 & _MASK)
        fp = (fp ^ (fp >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)  # the high bits depend on all
        yield n, at, (fp ^ (fp >> np.uint64(32))) >> np.uint64(64 - bits)


def counted(ids: np.ndarray, at: np.ndarray, fp: np.ndarray, n: int) -> np.ndarray:
    """Entries (fingerprint, count, place of one occurrence), one for each different phrase."""
    order = np.argsort(fp, kind="stable")
    fp, at = fp[order], at[order]
    new = np.ones(len(fp), dtype=bool)
    new[1:] = fp[1:] != fp[:-1]
    for k in range(n):  # against the words themselves
        word = ids[at + k]
        if (~new[1:] & (word[1:] != word[:-1])).any():
            exact = np.lexsort([*(ids[at + i] for i in range(n)), fp])
            fp, at = fp[exact], at[exact]
            new[1:] = fp[1:] != fp[:-1]
            for i in range(n):
                word = ids[at + i]
                new[1:] |= word[1:] != word[:-1]
            break
    first = np.flatnonzero(new)
    out = np.empty(len(first), dtype=ENTRY)
    out["fp"], out["at"] = fp[first], at[first]
    out["f"] = np.diff(np.append(first, len(fp)))
    return out


def _packed(a: np.ndarray) -> bytes:
    """Records as byte planes, column by column, compressed; the (sorted) fingerprints as
    differences. The high bytes of these and of counts and places are mostly zero."""
    import zstandard

    planes = []
    for c in a.dtype.names:
        v = np.diff(a[c], prepend=a[c].dtype.type(0)) if c == "fp" else np.ascontiguousarray(a[c])
        planes.append(v.view(np.uint8).reshape(len(v), -1).T.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _records(data: bytes, dtype: np.dtype) -> np.ndarray:
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(data)
    n, at = len(data) // dtype.itemsize, 0
    out = np.empty(n, dtype=dtype)
    for c in dtype.names:
        width = dtype[c].itemsize
        v = np.frombuffer(data, np.uint8, n * width, at).reshape(width, n).T
        v = np.ascontiguousarray(v).view(dtype[c]).ravel()
        out[c] = np.cumsum(v, dtype=v.dtype) if c == "fp" else v
        at += n * width
    return out


def _entry_batches(most: int, buckets: int, bits: int):
    def run(batches):
        import pyarrow as pa

        edges = np.array([-(-(k << bits) // buckets) for k in range(1, buckets)], dtype=np.uint64)
        for batch in batches:
            for i in range(batch.num_rows):
                chunk, lang = batch.column("chunk")[i].as_py(), batch.column("lang")[i].as_py()
                ids, words = numbered(split_words(batch.column("text")[i].as_py()))
                for n, at, fp in fingerprints(ids, words, lang, most, bits):
                    entries = counted(ids, at, fp, n)
                    cuts = [0, *np.searchsorted(entries["fp"], edges).tolist(), len(entries)]
                    used = [k for k in range(buckets) if cuts[k] < cuts[k + 1]]
                    for part in range(0, len(used), 4096):
                        own = used[part:part + 4096]
                        yield pa.RecordBatch.from_arrays([
                            pa.array([k * most + n - 1 for k in own], pa.int64()), pa.array([chunk] * len(own), pa.int64()),
                            pa.array([_packed(entries[cuts[k]:cuts[k + 1]]) for k in own], pa.binary())],
                            ["bucket", "chunk", "data"])
    return run


def _merge_batches(most: int, min_count: int):
    def run(batches):
        import pyarrow as pa

        def merged(bucket, chunks, data):
            entries = [_records(d, ENTRY) for d in data]
            owner = np.repeat(np.arange(len(chunks)), [len(e) for e in entries])
            fp = np.concatenate([e["fp"] for e in entries])
            f = np.concatenate([e["f"] for e in entries])
            order = np.argsort(fp, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], fp[order[1:]] != fp[order[:-1]]]))
            total = np.add.reduceat(f[order].astype(np.int64), first)
            kept = np.repeat(total >= min_count, np.diff(np.append(first, len(fp))))
            frequent = np.zeros(len(fp), dtype=bool)
            frequent[order[kept]] = True
            at = np.concatenate([e["at"] for e in entries])
            starts = np.concatenate([[0], np.cumsum([len(e) for e in entries])])
            out = []
            for c in np.unique(owner[frequent]):
                own = np.flatnonzero(frequent[starts[c]:starts[c + 1]]) + starts[c]
                hits = np.empty(len(own), dtype=HIT)
                hits["f"], hits["at"], hits["n"] = f[own], at[own], bucket % most + 1
                out.append((chunks[c], _packed(hits)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], pa.int64()), pa.array([d for _, d in out], pa.binary())],
                                                 ["chunk", "data"])

        now, chunks, held = None, [], []
        for batch in batches:
            for bucket, chunk, data in zip(*(batch.column(c).to_pylist() for c in ("bucket", "chunk", "data")), strict=True):
                if bucket != now:
                    if held:
                        yield from merged(now, chunks, held)
                    now, chunks, held = bucket, [], []
                chunks.append(chunk)
                held.append(data)
        if held:
            yield from merged(now, chunks, held)
    return run


def _phrase_batches(batches):
    import pyarrow as pa

    for batch in batches:
        for i in range(batch.num_rows):
            lang = batch.column("lang")[i].as_py()
            words = split_words(batch.column("text")[i].as_py())
            for data in batch.column("hits")[i].as_py():
                hits = _records(data, HIT)
                for part in range(0, len(hits), 65_536):
                    own = hits[part:part + 65_536]
                    phrases = [b" ".join(words[a:a + n]) for a, n in zip(own["at"].tolist(), own["n"].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([lang] * len(own)), pa.array(own["n"].astype(np.int32)), pa.array(phrases, pa.binary()),
                        pa.array(own["f"].astype(np.int64))], ["lang", "n", "phrase", "f"])


def chunked(docs: DataFrame, chunk_bytes: int = 6 << 20, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The texts as written chunks, with their numbers of words."""
    with_workers(docs.sparkSession)
    read = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
                       text_or_empty(text_col).cast("binary").alias("t"))
    return stored(read.mapInArrow(_chunk_batches(chunk_bytes), CHUNKS), "collocation-chunks")


def frequent_phrases(chunks: DataFrame, min_count: int = 10, most: int = 3, bucket_bytes: int = 16 << 20,
                     bits: int | None = None) -> DataFrame:
    """``lang``, ``n``, ``phrase``, ``f``: every run of up to ``most`` words that occurs at least
    ``min_count`` times in its language. ``bits``: of a fingerprint; fewer make more collisions, which
    cost time and change nothing. By default one n-gram in 2^16 collides."""
    size = chunks.agg(F.sum("words")).first()[0] or 0
    bits = min(64, (size * most).bit_length() + 16) if bits is None else bits
    if not 1 <= most <= 255 or not 1 <= bits <= 64:
        raise ValueError("phrases have 1 to 255 words, fingerprints 1 to 64 bits")
    buckets = max(1, -(-size * ENTRY.itemsize // bucket_bytes))
    entries = chunks.select("chunk", "lang", "text").mapInArrow(_entry_batches(most, buckets, bits), ENTRIES)
    hits = (entries.repartition("bucket").sortWithinPartitions("bucket", "chunk")
            .mapInArrow(_merge_batches(most, min_count), HITS)
            .groupBy("chunk").agg(F.collect_list("data").alias("hits")))  # at most the chunk's own entries
    phrases = chunks.select("chunk", "lang", "text").join(hits, "chunk").select("lang", "text", "hits").mapInArrow(_phrase_batches, PHRASES)
    return (phrases.groupBy("lang", "n", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= min_count)
            .select("lang", "n", F.col("phrase").cast("string").alias("phrase"), "f"))


def _run(words: Column, first: int, n: int) -> Column:
    """``n`` words from the ``first`` (0-based) on."""
    return F.array_join(F.slice(words, first + 1, n), " ")


def scored(frequent: DataFrame) -> DataFrame:
    """Candidates (two words or more): ``lang``, ``phrase``, ``n_words``, ``a`` and the lowest-scoring
    cut's ``l``, ``r``, ``score``."""
    most = frequent.agg(F.max("n")).first()[0] or 0
    words = F.split("phrase", " ")
    cuts = None
    for n in range(2, most + 1):
        of_n = frequent.where(F.col("n") == n).select(
            "lang", "phrase", F.col("n").alias("n_words"), F.col("f").alias("a"),
            F.inline(F.array(*(F.struct(F.lit(k).alias("k"), _run(words, 0, k).alias("first"), _run(words, k, n - k).alias("rest"))
                               for k in range(1, n)))))
        cuts = of_n if cuts is None else cuts.unionByName(of_n)
    if cuts is None:
        cuts = frequent.where("false").select("lang", "phrase", F.col("n").alias("n_words"), F.col("f").alias("a"),
                                              F.lit(1).alias("k"), F.col("phrase").alias("first"), F.col("phrase").alias("rest"))
    left = frequent.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = frequent.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    score = F.expr("cast(cast(a AS decimal(16,0)) * cast(a AS decimal(16,0)) * 1000000BD AS decimal(38,0)) div "
                   "cast(cast(l AS decimal(16,0)) * cast(r AS decimal(16,0)) AS decimal(38,0))")
    return (cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).withColumn("score", score)
            .groupBy("lang", "phrase", "n_words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
            .select("lang", "phrase", "n_words", "a", "cut.l", "cut.r", "cut.score"))


def without_parts(candidates: DataFrame, percent: int) -> DataFrame:
    """Candidates that aren't ``percent`` of the time (or more) part of one longer candidate."""
    words = F.split("phrase", " ")
    most = candidates.agg(F.max("n_words")).first()[0] or 0
    longer = None
    for n in range(3, most + 1):
        parts = [_run(words, i, m) for m in range(2, n) for i in range(n - m + 1)]
        of_n = candidates.where(F.col("n_words") == n).select("lang", F.explode(F.array(*parts)).alias("phrase"), F.col("a").alias("f"))
        longer = of_n if longer is None else longer.unionByName(of_n)
    if longer is None:
        return candidates
    longer = longer.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    return (candidates.join(longer, ["lang", "phrase"], "left")
            .where(F.col("longer").isNull() | (100 * F.col("longer") < percent * F.col("a"))).drop("longer"))


def collocations(docs: DataFrame, min_count: int = 10, most: int = 3, percent: int = 50, top: int = 2000,
                 chunk_bytes: int = 6 << 20, bucket_bytes: int = 16 << 20, bits: int | None = None,
                 text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Each language's ``top`` phrases by score: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``,
    ``n`` (words of the language), ``score``."""
    with small_batches(docs.sparkSession, 128):
        chunks = chunked(docs, chunk_bytes, text_col, lang_col)
        frequent = stored(frequent_phrases(chunks, min_count, most, bucket_bytes, bits), "collocation-phrases")
    candidates = stored(scored(frequent), "collocation-scores")
    order = F.desc("score"), F.desc("a"), F.col("phrase")
    slots = F.pmod(F.xxhash64("phrase"), F.lit(64))  # a language's first ones meet in two steps
    best = (without_parts(candidates, percent)
            .withColumn("rank", F.row_number().over(Window.partitionBy("lang", slots).orderBy(*order))).where(F.col("rank") <= top)
            .withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")))
    words = chunks.groupBy("lang").agg(F.sum("words").alias("n"))
    return (best.where(F.col("rank") <= top).join(words, "lang")
            .select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
