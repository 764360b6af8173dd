import hashlib
import math
import struct
from collections import Counter, defaultdict

import __spark_entry__ as entry_mod
import corpus_pipeline
import public_tokenizers
from llm_cases import EDGES, edges, frame, nothing, sample  # noqa: F401
from test_duplicates import deleted_lines, fingerprint, groups
import regex
import xxhash
from pyspark.sql import functions as F
from test_tokens import check_packing

from reviewlake.llm import imatch, quality


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def long_hash(v, seed=42):
    return signed(xxhash.xxh64_intdigest(struct.pack("<q", v), seed % (1 << 64)))


def list_hash(values):
    h = 42
    for v in sorted(values):
        h = long_hash(v, h)
    return h % (1 << 64)


def terms(text):
    """Hashes of a text's distinct terms."""
    return {signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in regex.split(r"[^\p{L}\p{M}\p{N}]+", text.lower()) if w}


def in_band(texts, min_df=2, max_share=0.05):
    texts = set(texts)
    df = Counter(x for t in texts for x in terms(t))
    return {x for x, n in df.items() if min_df <= n <= max(min_df, int(max_share * len(texts)))}


def signature_list(text, band, families=8):
    """A text's fingerprint by the rules, term by term: it depends on the text and the band alone."""
    all_terms = terms(text)
    level = min(13, max(0, math.floor(math.log2(max(len(all_terms), 1) / 2))))

    def kept(x, family, at):
        lane = (x if family < 4 else long_hash(x)) >> 16 * (family % 4) & 0xFFFF
        return lane % (1 << at) == 0
    # all eight families sample, whatever number of them is listed
    sampled = {x for x in all_terms if any(kept(x, f, level) for f in range(8))}
    described = sampled & band if len(sampled & band) >= 0.5 * len(sampled) else sampled
    found = []
    for f in range(families):
        for at in range(level, level + 3):
            own = [x for x in described if kept(x, f, at)]
            if own:
                found.append(f"{f}.{at}.{list_hash(own):016x}"[:len(f"{f}.{at}.") + 10])
    return f"L{level}," + (",".join(found) or f"all.{list_hash(all_terms):x}")


def alike(a, b):
    if a == b:
        return 1.0
    (la, *xs), (lb, *ys) = a.split(","), b.split(",")
    low, high = max(int(la[1:]), int(lb[1:])), min(int(la[1:]), int(lb[1:])) + 2
    on = [{x for x in own if not x.startswith("all.") and low <= int(x.split(".")[1]) <= high} for own in (xs, ys)]
    either = {x.rsplit(".", 1)[0] for x in on[0] | on[1]}
    return len(on[0] & on[1]) / len(either) if either else 0.0


def check(df, docs):
    docs = sorted({(i, t or "") for i, t in docs}, key=lambda k: (k[0] is not None, k[0] or 0))
    band = in_band(t for _, t in docs)
    got = defaultdict(list)
    for r in imatch.fingerprints(df).collect():
        got[r.doc_id].append(r)
    by_text = {}
    for n, (i, t) in enumerate(docs):
        following = docs[(n + 1) % len(docs)][1]
        h = len(t) // 2
        edited = t[:len(t) - h] + following[:h]
        r = got[i][0]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        own, changed, after = (signature_list(x, band) for x in (t, edited, following))
        assert (r.fingerprint, r.edited_fingerprint) == (own, changed)
        assert math.isclose(r.near_edited, alike(own, changed)) and math.isclose(r.near_next, alike(own, after))
        assert by_text.setdefault(edited, r.edited_fingerprint) == r.edited_fingerprint  # as a text or as an edited one
        assert by_text.setdefault(t, r.fingerprint) == r.fingerprint  # equal texts, equal fingerprints
        if terms(edited) == terms(t):
            assert r.near_edited == 1
    return got


def test_fingerprints(spark, edges, nothing):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = check(df, [(r.doc_id, r.text) for r in df.collect()])
    rows = [r for own in got.values() for r in own]
    near = sum(r.near_edited for r in rows) / len(rows)
    assert near > 0.15 and sum(r.near_next for r in rows) / len(rows) < 0.02
    edge = check(edges, EDGES)
    assert {i: len(r) for i, r in edge.items()} == dict(Counter(i for i, _ in EDGES))
    assert edge[6][0].fingerprint == edge[7][0].fingerprint and edge[6][0].near_next == 1
    assert imatch.fingerprints(nothing).count() == 0
    (alone,) = imatch.fingerprints(frame(spark, [(1, "only one text")])).collect()
    assert alone.near_next == 1


def test_equal_texts_have_equal_fingerprints_on_either_side(spark):
    p, q, r, z = (" ".join(f"{c}{i}" for i in range(60)) for c in "pqrz")
    common = [(100 + i, " ".join(f"{c}{(i * 7 + k) % 60}" for c in "pr" for k in range(40))) for i in range(30)]
    docs = [(1, f"{p} {q}"), (2, f"{r} {z}"), (3, f"{p} {r}"), (4, f"{p} other words"), *common]
    n = len(docs[0][1])
    docs[2] = (3, docs[0][1][:n - n // 2] + docs[1][1][:n // 2])  # the edited text of 1, once more as a text
    got = check(frame(spark, docs), docs)
    assert got[1][0].edited_sha256 == hashlib.sha256(docs[2][1].encode()).hexdigest()
    assert got[1][0].edited_fingerprint == got[3][0].fingerprint != got[1][0].fingerprint


def test_band_leaves_out_rare_and_common_terms(spark):
    docs = [(i, f"common w{i % 5} own{i}") for i in range(40)]
    sets = frame(spark, docs).select(imatch.terms(imatch.text_or_empty()).alias("terms"))
    got = imatch.lexicon(sets, 2, 0.25).collect()
    assert {r.term for r in got} == in_band((t for _, t in docs), 2, 0.25)
    hashes = spark.createDataFrame([(f"w{i}",) for i in range(5)], "w string").selectExpr("xxhash64(w) AS term").collect()
    assert sorted(got) == sorted(hashes)


def test_terms_end_at_signs_of_any_script(spark):
    texts = ["one two three", "«one» “two”—three…", "one\u00a0two\u3000three", "ONE、two。three！", "one_two $three~"]
    sets = frame(spark, list(enumerate(texts))).select(imatch.terms(F.col("text")).alias("terms")).collect()
    assert len({tuple(sorted(r.terms)) for r in sets}) == 1
    (r,) = frame(spark, [(1, "cafe\u0301 हिन्दी x1")]).select(imatch.terms(F.col("text")).alias("terms")).collect()
    assert len(r.terms) == 3


def run_stages(spark, df, sf_dir):
    out = [df]
    for _, stage in corpus_pipeline.STAGES:
        out.append(corpus_pipeline.stored(stage(spark, out[-1], sf_dir), "stage"))
    return out


def test_pipeline_stages_equal_plain_python(spark, tmp_path):
    sf = tmp_path / "sf"
    source = "/root/testdata/sf0.001"
    passage = " ".join(f"p{i}" for i in range(60))
    base = spark.read.parquet(f"{source}/documents.parquet").where("doc_id < 60")
    more = [(1000, f"{passage}\nfirst here and there"), (1001, f"second words of it\n{passage}"), (1002, None), (1003, ""), (1004, "THE!! END!!")]
    extra = spark.createDataFrame([(i, t, "en", "src1", len(t or "")) for i, t in more], base.schema)
    base.union(extra).union(extra.where("doc_id = 1000")).write.parquet(f"{sf}/documents.parquet")
    spark.read.parquet(f"{source}/labels.parquet").write.parquet(f"{sf}/labels.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "line_dedup", "simhash", "mix", "pack"]
    docs = corpus_pipeline.documents(spark, str(sf))
    stages = run_stages(spark, docs, str(sf))
    rows = [[r for r in s.collect()] for s in stages]
    assert all(s.columns == docs.columns for s in stages[:-1])
    # quality: what the scores say, row by row
    weights = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    ok = []
    for r in rows[0]:
        at, x = quality.features(r.text or "")
        ok += [r] if quality._sigmoid(float(weights.astype("f4")[at] @ x + weights.astype("f4")[-1])) >= 0.7 else []
    assert Counter(rows[1]) == Counter(ok)
    # line dedup
    gone = deleted_lines([(r.doc_id, r.text) for r in rows[1]], 50)
    want = [(r.doc_id, None if r.text is None else "\n".join(x for k, x in enumerate(r.text.split("\n")) if k not in gone[(r.doc_id, r.text)]))
            for r in rows[1]]
    assert Counter((r.doc_id, r.text) for r in rows[2]) == Counter(want)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows[2])
    # SimHash: one of each group
    fps = [fingerprint(r.text) for r in rows[2]]
    label = groups(fps, 4)
    assert sorted(r.doc_id for r in rows[3]) == sorted(min(r.doc_id for r, k in zip(rows[2], label, strict=True) if k == c) for c in set(label))
    # mixing: whole words of kept documents; packing: every id of the mix once
    assert sum(len((r.text or "").split()) for r in rows[4]) >= sum(len((r.text or "").split()) for r in rows[3])
    unique = Counter(r.doc_id for r in rows[4])
    check_packing([r for r in rows[5] if unique[r.doc_id] == 1], [(r.doc_id, r.text) for r in rows[4] if unique[r.doc_id] == 1], 2048, 0) \
        if all(v == 1 for v in unique.values()) else None
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = sum(len(e.ids) + 1 for e in t.encode_batch([r.text or "" for r in rows[4]], add_special_tokens=False))
    assert sum(r.length for r in rows[5]) == ids
    whole = corpus_pipeline.run(spark, str(sf))
    assert sum(r.length for r in whole.collect()) == ids


def test_pipeline_of_nothing_and_edges(spark, edges, nothing, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    for df in (nothing, edges):
        last = run_stages(spark, df, str(tmp_path))[-1]
        assert (last.count() == 0) == (df is nothing)


def test_every_operator_has_one_query():
    names = list(entry_mod.queries())
    for n in range(1, 14):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names


def test_a_near_copy_group_of_a_third_keeps_its_likeness(spark):
    words = [f"t{i}" for i in range(80)]
    docs = [(i, " ".join([*words[:i % 80], f"c{i % 7}", *words[i % 80 + 1:]]) if i % 3 == 0 else
             " ".join(f"o{(i * 31 + j * 17) % 997}" for j in range(80))) for i in range(300)]
    got = check(frame(spark, docs), docs)
    group = [got[i][0].near_edited for i, _ in docs if i % 3 == 0]  # the next document is none of the group
    assert sum(group) / len(group) > 0.1 and sum(x > 0 for x in group) > 0.8 * len(group)
    ahead = [(2 * i, t) for i, t in docs if i % 3 == 0] + [(10_000 + i, t) for i, t in docs if i % 3]
    near = [r[0].near_next for i, r in check(frame(spark, ahead), ahead).items() if i < 590]  # followed by a near copy
    assert sum(near) / len(near) > 0.5 and sum(x > 0 for x in near) > 0.9 * len(near)


def test_the_band_counts_distinct_texts(spark):
    copies = [(i, "alpha beta gamma delta") for i in range(30)]
    others = [(100 + i, f"alpha w{i % 20} v{i % 15}") for i in range(60)]
    got = check(frame(spark, copies + others), copies + others)
    alone = check(frame(spark, copies[:1] + others), copies[:1] + others)
    assert all(got[i][0].fingerprint == alone[i][0].fingerprint for i, _ in copies[:1] + others)
