import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from llm_cases import EDGES, edges, nothing, sample  # noqa: F401
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from reviewlake.llm import packing, token_counts, wavelet
from reviewlake.llm.tokens import encoder
from reviewlake.session import scratch_path

BYTE, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def whole(path, texts):
    t = Tokenizer.from_file(path)
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.mark.parametrize("path", [BYTE, WORDS])
def test_word_by_word_equals_whole_texts(path):
    parts = ["the", "Word", "café,", "naïve", "don't", "it's", "x1y2", "3.14", "$$$", "!!", "漢字", "🙂", "é", "́", "ΟΔΟΣ", "İx",
             "²", "_a_", "<|endoftext|>", "<|startoftext|>", "a b", "　", "​", "\x1c", "\x85", "|", "a.b", "A's", "'ll"]
    gaps = [" ", " ", " ", "\n", "  ", "\n\n", " \n", "\t", "\r\n", " "]
    rnd = random.Random(5)
    texts = ["".join(rnd.choice(parts) + rnd.choice(gaps) for _ in range(rnd.randint(0, 12))) for _ in range(3000)]
    texts += [t.strip() for t in texts[:500]] + [t for _, t in EDGES if t is not None]
    got = encoder(path).encode(texts)
    for text, ids, want in zip(texts, got, whole(path, texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == want, repr(text)


def test_counts_and_cache(spark, edges, nothing):
    path = scratch_path(spark, "cache-test")
    want = sorted((-1 if i is None else i, len((t or "").encode()), len(ids)) for (i, t), ids in zip(EDGES, whole(BYTE, [t for _, t in EDGES]), strict=True))
    for _ in range(2):  # the second call encodes nothing
        got = token_counts.token_counts(edges, BYTE, path).collect()
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
        assert {r.source for r in got} >= {None, "src1"}
        cache = spark.read.parquet(path)
        assert cache.count() == cache.select("digest").distinct().count() == len({t or "" for _, t in EDGES})
    # a wrong stored count shows that a known digest is read, not encoded again
    other = scratch_path(spark, "cache-test")
    cache.withColumn("n_tokens", F.lit(99).cast("long")).write.partitionBy("version").parquet(other)
    assert {r.n_tokens for r in token_counts.token_counts(edges, BYTE, other).collect()} == {99}
    assert token_counts.token_counts(nothing, BYTE, scratch_path(spark, "cache-test")).count() == 0


def test_a_repeated_row_in_several_tasks_counts_once(spark):
    rnd = random.Random(7)
    text = " ".join(f"w{rnd.randrange(10 ** 6)}" for _ in range(2000))
    rows = [(3, text)] * 300 + [(i, f"own text {i}") for i in range(10, 60)]
    split = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k",
             "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in split}
    try:
        for k, v in split.items():
            spark.conf.set(k, v)
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
        path = scratch_path(spark, "cache-test")
        assert token_counts.token_counts(docs, BYTE, path).count() == len(rows)
        cache = spark.read.parquet(path)
        assert cache.count() == cache.select("digest").distinct().count() == 51
        cache.write.mode("append").partitionBy("version").parquet(path)  # as a second writer might
        assert token_counts.token_counts(docs, BYTE, path).count() == len(rows)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def check_packing(rows, docs, capacity, end):
    pieces, seqs = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append(r)
    for (i, _), ids in zip(docs, whole(BYTE, [t for _, t in docs]), strict=True):
        ids, own = [*ids, end], sorted(pieces[i], key=lambda r: r.piece)
        if [x for x, _ in docs].count(i) == 1:
            assert [x for r in own for x in np.frombuffer(r.token_ids, "<u4")] == ids
            assert [r.start for r in own] == list(np.cumsum([0] + [r.length for r in own])[:-1])
            assert all(r.length == capacity for r in own[1:]) and (len(own) == 1 or len(ids) > capacity)
    for own in seqs.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(seqs)


def test_packing(spark, edges, nothing, sample):
    df, docs = sample
    rows = packing.pack(df.coalesce(1), BYTE, 512, 0).collect()
    n = check_packing(rows, [(i, t) for i, t, _ in docs], 512, 0)
    assert n <= -(-sum(r.length for r in rows) // 512) + 2
    least = -(-sum(r.length for r in rows) // 512)
    for parts in (7, 60):  # many partitions cost few sequences
        rows = packing.pack(df.repartition(parts), BYTE, 512, 0).collect()
        assert check_packing(rows, [(i, t) for i, t, _ in docs], 512, 0) <= 1.02 * least + 2 * (1 + parts // 16)
    check_packing(packing.pack(edges, BYTE, 64, 3, open_bins=2).collect(), EDGES, 64, 3)
    assert packing.pack(nothing, BYTE).count() == 0


def test_bins_close_the_fullest_first():
    bins = packing.Bins(10, 2, 0)
    assert [bins.place(n) for n in (6, 7, 3, 8, 4, 2)] == [(0, 0), (1, 0), (1, 7), (2, 0), (0, 6), (2, 8)]
    bins = packing.Bins(10, 1, 0)
    assert [bins.place(n) for n in (6, 7, 4, 3)] == [(0, 0), (1, 0), (2, 0), (2, 4)]  # bin 0, then bin 1 closed


def test_wavelet_matrix_answers(spark):
    rnd = np.random.default_rng(3)
    for n in (0, 1, 7, 511, 512, 513, 3000):
        ids = rnd.integers(0, 40, n).astype(np.uint32) * 977
        data = wavelet.to_bytes([5], [n], ids, 16)
        doc_ids, lengths, w = wavelet.from_bytes(data)
        assert (doc_ids, lengths, w.n) == ([5], [n], n) and w.ids().tolist() == ids.tolist()
        for i in range(0, n, 37):
            assert w.access(i) == ids[i]
        for token in {0, 977, 977 * 39, 5, 70000, *ids[:3].tolist()}:
            at = np.flatnonzero(ids == token).tolist()
            assert w.count(token) == len(at) and w.rank(token, n // 2) == sum(x < n // 2 for x in at)
            assert [w.select(token, k) for k in range(len(at))] == at and w.select(token, len(at)) == -1


def test_ids_beyond_the_planes_raise():
    with pytest.raises(ValueError):
        wavelet.WaveletMatrix.from_ids(np.array([3, 70_000]), 16)
    assert wavelet.WaveletMatrix.from_ids(np.array([3, 70_000]), 17).ids().tolist() == [3, 70_000]


def test_a_third_of_all_rows_is_one_id(spark):
    docs = [(None if i % 3 == 0 else i, f"text {i % 3 and i} with some words") for i in range(600)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(8)
    path = wavelet.write_shards(df, scratch_path(spark, "wavelet-test"), WORDS, 2, shards=6)
    own = spark.read.parquet(path).select("n_docs").collect()
    assert len(own) >= 6 and max(r.n_docs for r in own) <= 200
    got = sorted(wavelet.read_shards(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((i for i, _ in docs), key=lambda i: (i is not None, i or 0))
    assert [r.start for r in got] == list(np.cumsum([0] + [r.n_tokens for r in got])[:-1])


def test_long_words_are_not_remembered():
    enc = encoder(BYTE)
    word = "x" * 5000
    assert np.frombuffer(enc.encode([f"a {word} b"])[0], "<u4").tolist() == whole(BYTE, [f"a {word} b"])[0]
    assert word not in enc.words and max(map(len, enc.words)) <= 64


def test_wavelet_files(spark, edges, nothing):
    path = wavelet.write_shards(edges, scratch_path(spark, "wavelet-test"), WORDS, 2, shard_tokens=50, shards=3)
    got = [(r.doc_id, r.start, r.n_tokens, zlib.crc32(r.token_ids)) for r in wavelet.read_shards(spark, path).collect()]
    order = sorted(EDGES, key=lambda e: (e[0] is not None, e[0] or 0, e[1] or ""))
    want, at = [], 0
    for (i, _), ids in zip(order, whole(WORDS, [t for _, t in order]), strict=True):
        want.append((i, at, len(ids) + 1, zlib.crc32(np.array([*ids, 2], "<u4").tobytes())))
        at += len(ids) + 1
    assert sorted(got, key=lambda r: r[1]) == want
    empty = wavelet.write_shards(nothing, scratch_path(spark, "wavelet-test"), WORDS, 2)
    assert wavelet.read_shards(spark, empty).count() == 0
