import random
import re

import numpy as np
import pytest
import xxhash
from llm_cases import EDGES, WORD, edges, frame, nothing, sample  # noqa: F401
from pyspark.sql import functions as F

from reviewlake.llm import line_dedup, simhash


def fingerprint(text, size=4, seed=42):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), seed) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(fps, radius):
    near = np.bitwise_count(np.array(fps, np.uint64)[:, None] ^ np.array(fps, np.uint64)[None]) <= radius
    label = np.arange(len(fps))
    while True:
        new = np.array([label[near[i]].min() for i in range(len(fps))])
        if (new == label).all():
            return label
        label = new


@pytest.mark.parametrize("n", [0, 1, 254, 255, 256, 511, 70_000])
def test_fold_counts_every_bit(n):
    h = np.random.default_rng(n).integers(0, 2 ** 64, n, dtype=np.uint64)
    bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(n, 8), axis=1).sum(0, dtype=np.int64)
    assert simhash.fold(h) == sum(1 << (63 - k) for k in range(64) if 2 * bits[k] > n)


def test_links_skip_no_pair():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2 ** 64, 40, dtype=np.uint64)
    fps = np.concatenate([base, *[base ^ np.bitwise_or.reduce([np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)
                                                              for _ in range(k)]) for k in (1, 3, 4, 5, 6)]])
    for order in (np.arange(len(fps)), np.lexsort(simhash.quarters(fps).T)):
        a = fps[order]
        got = {(int(i), int(j)) for r, c in simhash.links(a, a, 4, tile=16) for i, j in zip(r, c, strict=True)}
        near = np.bitwise_count(a[:, None] ^ a[None]) <= 4
        assert got == set(zip(*map(np.ndarray.tolist, np.nonzero(near)), strict=True))


def test_near_duplicates_equal_brute_force(spark, edges, nothing, sample):
    df, docs = sample
    for frame_, rows in ((df, [(i, t) for i, t, _ in docs]), (edges, EDGES)):
        label = groups(fps := [fingerprint(t) for _, t in rows], 4)
        least = {k: min((i for (i, _), x in zip(rows, label, strict=True) if x == k and i is not None), default=None) for k in set(label)}
        want = sorted((str(i), f"{f:016x}", least[k]) for (i, _), f, k in zip(rows, fps, label, strict=True))
        got = simhash.near_duplicates(frame_).withColumn("hex", simhash.hex_fingerprint()).collect()
        assert sorted((str(r.id), r.hex, r.component_id) for r in got) == want
        kept = simhash.keep_one(frame_)
        assert kept.columns == frame_.columns
        ids = [r.doc_id for r in kept.collect()]
        assert sorted(map(str, ids)) == sorted(str(x) for x in least.values())
    assert simhash.near_duplicates(nothing).count() == simhash.keep_one(nothing).count() == 0


def test_components_of_chains_and_hubs(spark):
    rnd = random.Random(2)
    edges_ = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(200, 201), (202, 201), (5, 5)]
    rnd.shuffle(edges_)
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges_, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 160), 100), **dict.fromkeys((200, 201, 202), 200)}


def deleted_lines(docs, least):
    """Per (id, text) the lines of later copies of maximal runs, by comparing every pair of places."""
    keys = sorted({(i, t) for i, t in docs if t is not None}, key=lambda k: (k[0] is not None, k[0] or 0))
    split = {k: k[1].split("\n") for k in keys}
    gone = {k: set() for k in keys}
    for n, k in enumerate(keys):
        for p in range(len(split[k])):
            for j in keys[:n + 1]:
                for q in range(p if j == k else len(split[j])):
                    m = 0
                    while p + m < len(split[k]) and q + m < len(split[j]) and split[k][p + m] == split[j][q + m]:
                        m += 1
                    if sum(len(WORD.findall(x)) for x in split[k][p:p + m]) >= least:
                        gone[k] |= set(range(p, p + m))
    return gone


def check_lines(df, docs, least):
    out = line_dedup.dedup_lines(df, least)
    want, seen = deleted_lines(docs, least), []
    for r in out.collect():
        seen.append(r.doc_id)
        source = [t for i, t in docs if i == r.doc_id]
        if source == [None]:
            assert r.text is None and r.n_lines == r.n_deleted == 0
            continue
        got = {k for run in r.deleted for k in range(run.s, run.e)}
        fits = [t for t in source if want[(r.doc_id, t)] == got]
        assert fits, (r.doc_id, sorted(got))
        assert r.text in ["\n".join(x for k, x in enumerate(t.split("\n")) if k not in got) for t in fits]
        assert r.n_deleted == len(got) and r.n_lines in [len(t.split("\n")) for t in fits]
    assert sorted(map(str, seen)) == sorted(str(i) for i, _ in docs)
    return out


def test_line_runs_on_random_documents(spark):
    rnd = random.Random(7)
    lines = ["a b c", "d", "e f", "", "g h i j", "k l"]
    docs = [(i, "\n".join(rnd.choice(lines) for _ in range(rnd.randint(0, 14)))) for i in range(14)]
    for least in (1, 4, 9):
        check_lines(frame(spark, docs), docs, least)


def test_line_runs_of_the_driver_table_and_edges(spark, edges, nothing, sample):
    df, docs = sample
    docs = [(i, t) for i, t, _ in docs][:60]
    out = check_lines(df.where("doc_id < 60"), docs, 50)
    assert sum(r.n_deleted for r in out.select("n_deleted").collect()) > 0
    out = check_lines(edges, [e for e in EDGES if e[0] != 3] + [EDGES[0], EDGES[3]], 2)
    # repeated rows are one document: neither is the other's copy
    assert [r.n_deleted for r in out.where("doc_id = 3").collect()] == [0, 0]
    assert [r.text for r in out.where("doc_id = 7").collect()] == ["tie"]  # one word is under the least of two
    assert line_dedup.dedup_lines(nothing).count() == 0


def test_later_copies_go_and_the_first_stays(spark):
    passage = " ".join(f"p{i}" for i in range(55))
    docs = [(1, f"own one\n{passage}\nend"), (2, f"{passage}\nown two"), (3, f"own three\n{passage}"), (4, passage)]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(frame(spark, docs), 50).collect()}
    assert got == {1: docs[0][1], 2: "own two", 3: "own three", 4: ""}


def test_every_block_pair_is_compared(spark):
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(300)}
    for f in list(fps)[:150]:  # neighbours within and beyond the radius
        for bits in (2, 4, 5):
            fps.add(f ^ sum(1 << b for b in rng.sample(range(64), bits)))
    fps = sorted(fps)
    table = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long").repartition(5)
    label = groups(fps, 4)
    want = {frozenset(f for f, k in zip(fps, label, strict=True) if k == c) for c in set(label)}
    for block_rows in (7, 64, 16384):
        edges = simhash.link_forest(table, 4, block_rows)
        sets = {f: {f} for f in fps}
        for r in edges.collect():
            a, b = r.a % (1 << 64), r.b % (1 << 64)
            assert 0 < (a ^ b).bit_count()
            if sets[a] is not sets[b]:
                sets[a] |= sets[b]
                for f in sets[b]:
                    sets[f] = sets[a]
        assert {frozenset(x) for x in sets.values()} == want


def test_a_block_is_sent_by_the_grid_not_by_its_pairs(spark):
    plan = simhash.link_forest(spark.range(1000).select(F.xxhash64("id").alias("fp")), 4, 10)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("SortMergeJoin") == 1 and text.count("Exchange hashpartitioning(i") == 2
