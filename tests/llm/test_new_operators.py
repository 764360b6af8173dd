"""First-fit decreasing packing, phrase collocations and vector codes against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from llm_cases import EDGES, edges, frame, nothing, sample  # noqa: F401
from tokenizers import Tokenizer

from reviewlake.llm import ball_kmeans, collocations, ffd_packing

WORDS = public_tokenizers.path("word_bpe_49k.json")


# --- first-fit decreasing ------------------------------------------------------------------

def check_packed(rows, docs, capacity, end):
    """Every id of every document once and in order, sequences without gaps or padding."""
    t = Tokenizer.from_file(WORDS)
    want = Counter((i, tuple(t.encode(x or "", add_special_tokens=False).ids) + (end,)) for i, x in docs)
    seqs, pieces = {}, {}
    for r in rows:
        ids = tuple(np.frombuffer(r.token_ids, "<u4").tolist())
        assert len(ids) == r.length > 0
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, []).append((r.start, ids, r.doc_tokens))
    for own in seqs.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at == capacity or at & (at - 1) == 0 and at < capacity
    have = Counter(x for ids in pieces.values() for _, own, _ in ids for x in own)
    assert have == Counter(x for (_, ids), n in want.items() for x in ids * n)
    for (i, ids), n in want.items():
        if sum(m for (j, _), m in want.items() if j == i) == 1:
            own = sorted(pieces[i])
            assert tuple(x for _, part, _ in own for x in part) == ids and {k for *_, k in own} == {len(ids)}
            assert [s for s, *_ in own] == list(np.cumsum([0] + [len(p) for _, p, _ in own])[:-1])
    return seqs


def test_packing_keeps_every_id(spark, edges, nothing, sample):
    df, docs = sample
    rows = ffd_packing.pack(df, WORDS, 512, 2, group_bytes=1 << 18).collect()
    check_packed(rows, [(i, t) for i, t, _ in docs], 512, 2)
    assert len({r.sequence_id >> 32 for r in rows}) > 1
    for capacity in (64, 100, 1):
        check_packed(ffd_packing.pack(edges, WORDS, capacity, 2).collect(), EDGES, capacity, 2)
    assert ffd_packing.pack(nothing, WORDS).count() == 0


def test_few_short_documents_are_cut(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = ffd_packing.pack(df, WORDS).collect()
    cut = {r.doc_id for r in rows if r.doc_tokens <= 4096 and r.length < r.doc_tokens}
    assert len(cut) < 0.03 * df.count()


def test_groups_do_not_follow_copies_or_partitions(spark):
    rows = [(3, "the same text in a third of all rows")] * 400 + [(i, f"own text number {i} of many") for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    size = sum(len(t) + 1 for _, t in rows)
    for parts in (1, 7, 60):
        got = ffd_packing.pack(docs.repartition(parts), WORDS, 256, 2, group_bytes=size // 12).collect()
        check_packed(got, rows, 256, 2)
        groups = Counter(r.sequence_id >> 32 for r in got)
        assert len(groups) >= 12 and max(groups.values()) < 3 * len(got) / len(groups)
    # the same rows in another order within their tasks give the same groups
    drawn = []
    for order in ("text", "doc_id"):
        one = docs.coalesce(1).sortWithinPartitions(order, "doc_id")
        out = ffd_packing.pack(one, WORDS, 256, 2, group_bytes=size // 12)
        drawn.append(Counter((r.doc_id, r.start, r.sequence_id, r.offset) for r in out.collect()))
    assert drawn[0] == drawn[1]


def test_the_tree_finds_the_first_bin_with_room():
    rnd = random.Random(4)
    for _ in range(200):
        capacity = rnd.choice([1, 7, 64, 1000])
        lengths = sorted((rnd.randint(1, capacity) for _ in range(rnd.randint(1, 60))), reverse=True)
        room, want = [], []
        for n in lengths:  # the rule, bin by bin
            at = next((k for k, r in enumerate(room) if r >= n), len(room))
            if at == len(room):
                room.append(capacity)
            room[at] -= n
            want.append(at)
        tree = ffd_packing.RoomTree(len(lengths), capacity)
        assert [tree.place(n) for n in lengths] == want
        bins = ffd_packing.first_fit_decreasing([(n, k, k, 0) for k, n in enumerate(lengths)], capacity)
        assert [sum(p[0] for p in b) for b in bins] == [capacity - r for r in room]
        closed = ffd_packing.close_gaps(bins, capacity)
        sizes = [sum(p[0] for p in b) for b in closed]
        assert sum(sizes) == sum(lengths) and all(s == capacity or s < capacity and s & (s - 1) == 0 for s in sizes)
    with pytest.raises(ValueError):
        ffd_packing.RoomTree(1, 5).place(6)
    assert ffd_packing.pack_group([], [], 8) == []


# --- collocations --------------------------------------------------------------------------

def phrases(rows, min_count=10, most=3, percent=50, top=2000):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    f, n_words = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(lower)):
            w = re.findall("[^\x20\x09]+", piece)
            n_words[lang] += len(w)
            f.update((lang, *w[i:i + n]) for n in range(1, most + 1) for i in range(len(w) - n + 1))
    candidates = {p: a for p, a in f.items() if len(p) > 2 and a >= min_count}
    longer = {}
    for (lang, *w), a in candidates.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                longer[(lang, *w[i:i + m])] = max(a, longer.get((lang, *w[i:i + m]), 0))
    out = {}
    for p, a in candidates.items():
        if 100 * longer.get(p, -1) >= percent * a:
            continue
        score, _, left, right = min((1000000 * a * a // (f[p[:k + 1]] * f[(p[0], *p[k + 1:])]), k, f[p[:k + 1]], f[(p[0], *p[k + 1:])])
                                    for k in range(1, len(p) - 1))
        out.setdefault(p[0], []).append((-score, -a, " ".join(p[1:]).encode(), left, right))
    return sorted((lang, k + 1, p.decode(), -a, left, right, n_words[lang], -s)
                  for lang, own in out.items() for k, (s, a, p, left, right) in enumerate(sorted(own)[:top]))


def found(df, *args, **kw):
    return sorted(tuple(r) for r in collocations.collocations(df, *args, **kw).collect())


def test_collocations(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.lang, r.text) for r in df.collect()]
    want = phrases(rows)
    assert len(want) > 500 and found(df) == want
    # fingerprints of 8 bits collide in every chunk and between chunks; results stay
    assert found(df.repartition(3), bits=8, chunk_bytes=1 << 17, bucket_bytes=1 << 18) == want
    assert found(df, 4, 5, 80, 30, chunk_bytes=1 << 16) == phrases(rows, 4, 5, 80, 30)


def test_collocation_cases(spark, edges, nothing):
    texts = [("EN", "A\tb  a b. a,b!a\x0bb\x0ca\rb a b a b"), (None, "und und und\nund und"), ("und", "und und"), ("en", None), ("en", ""),
             ("en", "\x00 \x1c \x85 É é 　 \x00 \x1c"), ("en", "x x x x x x x"), ("EN", "a b"), ("EN", "a b")]
    df = spark.createDataFrame([(i, t, lang, lang, lang, 1, "x") for i, (lang, t) in enumerate(texts)],
                               "doc_id int, text string, lang string, phrase string, chunk string, n int, first string")
    for least in (1, 2):
        assert found(df, least) == phrases(texts, least)
        assert found(df, least, 2) == phrases(texts, least, 2)
    assert found(df, 1, 1) == [] and found(df, 1, 3, 50, 1) == phrases(texts, 1, 3, 50, 1)
    assert found(edges, 1) == phrases([("en", t) for _, t in EDGES], 1)
    assert found(nothing) == []


def test_a_phrase_in_a_third_of_all_rows(spark):
    texts = [("en", "one two three four" if i % 3 == 0 else f"w{i % 40} w{i % 7} one two") for i in range(900)]
    df = spark.createDataFrame([(t, lang) for lang, t in texts], "text string, lang string").repartition(60)
    assert found(df, chunk_bytes=1 << 12) == phrases(texts)


# --- vector codes --------------------------------------------------------------------------

def codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    kept = [(i, [math.floor(scale * float(x)) for x in v], label) for i, v, label in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    w = -(-max(len(v) for _, v, _ in kept) // parts)
    kept = [(i, v + [0] * (w * parts - len(v)), label) for i, v, label in kept]
    first = {}
    for i, v, _ in kept:
        first[i] = min(first.get(i, v), v)
    first = [first[i] for i in sorted(first, key=lambda i: (i is None, i or 0))[:entries]]
    books = [[v[p * w:(p + 1) * w] for v in first] for p in range(parts)]

    def near(x, book):
        return min(range(len(book)), key=lambda e: (sum((a - c) ** 2 for a, c in zip(x, book[e], strict=True)), e))

    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for _, v, _ in kept:
                members.setdefault(near(v[p * w:(p + 1) * w], books[p]), []).append(v[p * w:(p + 1) * w])
            books[p] = [[sum(c) // len(members[e]) for c in zip(*members[e], strict=True)] if e in members else old
                        for e, old in enumerate(books[p])]
    out, sums = [], Counter()
    for i, v, label in kept:
        own = [near(v[p * w:(p + 1) * w], books[p]) for p in range(parts)]
        error = sum((a - c) ** 2 for p in range(parts) for a, c in zip(v[p * w:(p + 1) * w], books[p][own[p]], strict=True))
        out.append((i, label, "".join(f"{e:02x}" for e in own), error))
        sums[label] += error
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return Counter((i, code, error, sums[label], digest) for i, label, code, error in out)


def coded(df, **kw):
    return Counter((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in ball_kmeans.compress(df, **kw).collect())


def test_codes(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    assert coded(df.repartition(5)) == codes(rows)
    assert coded(df, parts=3, entries=5, rounds=2, scale=100) == codes(rows, 3, 5, 2, 100)


def test_code_cases(spark):
    inf, nan = math.inf, math.nan
    rows = [(5, [1.0, -1.0, 0.5], 1), (5, [1.0, -2.0, 0.5], None), (7, [0.0] * 9, None), (None, [0.25] * 5, 2), (9, None, 1),
            (10, [1.0, None], 1), (11, [nan], 1), (12, [-inf, 1.0], 1), (13, [], 2), (7, [0.0] * 9, None), (1, [-0.0001, 0.0001], 2)]
    schema = "vec_id long, embedding array<double>, label int, ids int, data string, error int, code int, v int"

    def table(rows):
        return spark.createDataFrame([(i, v, label, 1, "x", 2, 3, 4) for i, v, label in rows], schema)
    for kw in ({}, {"entries": 2}, {"parts": 2, "rounds": 1}, {"rounds": 0}, {"parts": 16}):
        assert coded(table(rows), **kw) == codes(rows, **kw)
    assert ball_kmeans.compress(table([])).count() == 0
    assert ball_kmeans.compress(table([(1, [nan], 2), (2, None, 3)])).count() == 0
    assert coded(table([(1, [], 4), (2, [], 4)])) == codes([(1, [], 4), (2, [], 4)])
    far = [(i, [1e15 * (i % 3)] * 4 + [1e300 * (i % 2)] * 4, i % 2) for i in range(12)]  # whole numbers of any size
    assert coded(table(far), entries=6) == codes(far, entries=6)
    third = [(i, [0.5] * 8 if i % 3 == 0 else [((i * 37 + k * 11) % 100) / 50 - 1 for k in range(8)], i % 3) for i in range(300)]
    assert coded(table(third).repartition(40)) == codes(third)


def test_ball_steps_are_exact_on_ties():
    rnd = np.random.default_rng(6)
    for width in (1, 2, 3):
        for kind in (float, np.int64, object):
            x = rnd.integers(-4, 5, (400, width)).astype(kind)
            book = rnd.integers(-4, 5, (9, width)).astype(kind)  # small numbers: many equal distances and entries
            before = rnd.integers(0, 9, 400)
            assert ball_kmeans.ball_step(x, before, book).tolist() == ball_kmeans.nearest(x, book).tolist()
