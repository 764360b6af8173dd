import math
import zlib

import numpy as np
import pytest
from llm_cases import EDGES, edges, nothing, sample  # noqa: F401
from pyspark.sql import functions as F

from reviewlake.llm import quality, topk


def brute(rows, every, k):
    v = {(i, tuple(math.floor(64 * np.float64(np.float32(x))) for x in e)) for i, e in rows
         if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)}
    out = []
    for q in {i for i, _ in v if i % every == 0}:
        hits = sorted((-sum(a * b for a, b in zip(x, y)), j) for i, x in v if i == q for j, y in v if j != q)[:k]
        out += [(q, r + 1, j, -s) for r, (s, j) in enumerate(hits)]
    return sorted(out)


def run(df, every, k, **more):
    return sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % every == 0, k, **more).collect())


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 5) / 8]) for i in range(90)]  # few values: many ties
    rows += [rows[0], (90, None), (91, [0.5, None, 0.0, 0.0, 0.0]), (92, [math.nan] * 5), (93, [math.inf] + [0.0] * 4), (None, [1.0] * 5),
             (95, [0.25, 0.5]), (96, []), (97, [-0.01] * 5)]
    df = spark.createDataFrame([(i, e, 1) for i, e in rows], "vec_id long, embedding array<float>, tile int")
    for size in (7, 4096):
        assert run(df, 5, 6, tile_rows=size, block_rows=4, kept_queries=6) == brute(rows, 5, 6)
    assert run(df.limit(0), 5, 6) == []
    few = df.where("vec_id < 3")
    assert run(few, 1, 20) == brute([r for r in rows if r[0] is not None and r[0] < 3], 1, 20)


def test_an_id_of_many_rows_lists_others_and_tasks_emit_k_a_query(spark):
    rows = [(0, [i / 64, 1.0]) for i in range(300)] + [(i, [i / 64, -1.0]) for i in range(1, 40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(9)
    assert run(df, 20, 5, tile_rows=16) == brute(rows, 20, 5)
    lists = topk.Lists(np.array([0, 7]), 3)
    for lo in range(0, 60, 6):
        vec = np.broadcast_to(np.arange(lo, lo + 6) // 2, (2, 6))
        lists.add(topk.own_last(vec * 0 + np.array([[5], [2 ** 62]]), lists.queries, vec[0]), vec)
    got = lists.batch().to_pydict()
    assert got == {"query_id": [0] * 3 + [7] * 3, "vec_id": [1, 1, 2, 0, 0, 1], "score": [5] * 3 + [2 ** 62] * 3}


def test_tiles_are_the_same_in_any_order_of_rows(spark):
    rows = [(i // 2, [float(i), 1.0]) for i in range(50)]
    made = [topk.tiled(spark.createDataFrame(r, "vec_id long, v array<double>").coalesce(1), 8).collect() for r in (rows, rows[::-1])]
    assert len(made[0]) == 7 and sorted(made[0]) == sorted(made[1])


def test_products_stay_exact_at_any_size():
    for top in (2 ** 20, 2 ** 28, 2 ** 31):
        q = np.array([[top, 1.0], [-top, 3.0]])
        want = [[int(a) * int(c) + int(b) * int(d) for c, d in q] for a, b in q]
        assert topk.scores(q, q).tolist() == want
    with pytest.raises(OverflowError):
        topk.scores(np.array([[2.0 ** 40]]), np.array([[2.0 ** 40]]))
    s = np.array([[2 ** 61, 2 ** 61 + 1, 5, 2 ** 61 + 1]])
    assert sorted(topk.best(s, 2)[0].tolist()) == [1, 3] and topk.best(s, 9).tolist() == [[0, 1, 2, 3]]


def test_quality_on_held_out_rows(spark, sample):
    df, docs = sample
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality.classify(big, labels).join(labels, "doc_id").where("held_out").collect()
    right = sum(r.predicted == r.quality for r in got) / len(got)
    assert len(got) > 50 and right > 0.95
    assert all(r.predicted for r in got if r.quality == 1)  # clean documents stay
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)


def test_labels_of_held_out_rows_teach_nothing(spark, sample):
    df, docs = sample
    labels = spark.createDataFrame([(i, i % 2) for i, _, _ in docs], "doc_id long, quality int")
    turned = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert np.array_equal(quality.fit(df, labels), quality.fit(df, turned))


def test_a_repeated_labelled_id_teaches_once(spark):
    rows = [(i, f"{'good clean words' if i % 2 else 'bad junk !!!'} number {i}") for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    fit = lambda r: quality.fit(spark.createDataFrame(r, "doc_id long, text string").repartition(5), labels)
    alone = fit(rows)
    hot = next(i for i, _ in rows if zlib.crc32(str(i).encode()) % 4 != 2)
    assert len(alone) and np.array_equal(alone, fit(rows + [rows[hot]] * 60))
    rest, own = [r for r in rows if r[0] != hot], [(hot, f"another text {k}") for k in range(3)]
    assert sum(np.array_equal(fit(rest + own * 20), fit(rest + [r])) for r in own) == 1


def test_ftrl_follows_its_definition():
    m, z, n, w = quality.Ftrl(0.5, 1.0, 0.1, 0.2), {}, {}, {}
    data = [([1, 5], [0.6, 0.8], 1), ([5, 9], [0.5, 0.5], 0), ([1], [1.0], 0), ([9, 1], [0.3, 0.1], 1)]
    for at, x, label in data * 3:
        m.learn(np.array(at), np.array(x, np.float32), label)
        at, x = [*at, 1 << quality.BITS], [*(float(np.float32(v)) for v in x), 1.0]
        for i in at:
            z_, n_ = z.get(i, 0.0), n.get(i, 0.0)
            w[i] = 0.0 if abs(z_) <= 0.1 else -(z_ - math.copysign(0.1, z_)) / ((1.0 + math.sqrt(n_)) / 0.5 + 0.2)
        p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in zip(at, x))))
        for i, v in zip(at, x):
            g = (p - label) * v
            sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / 0.5
            z[i], n[i] = z.get(i, 0.0) + g - sigma * w[i], n.get(i, 0.0) + g * g
    for i in z:
        assert m.z[i] == pytest.approx(z[i], abs=1e-6) and m.n[i] == pytest.approx(n[i], abs=1e-6)


def test_quality_edges(spark, edges, nothing):
    labels = spark.createDataFrame([(3, 1), (3, 1), (11, 0), (1, 0), (6, None), (7, 5), (None, 1)], "doc_id long, quality int")
    got = quality.classify(edges, labels).collect()
    assert len(got) == len(EDGES) and all(0 <= r.score <= 1 for r in got)
    empty = {r.score for r in got if not r.text}
    assert len(empty) == 1  # the bias alone
    assert len({r.score for r in got if r.doc_id == 3}) == 1
    none = quality.classify(edges, labels.limit(0)).collect()
    assert {r.score for r in none} == {1.0} and {r.predicted for r in none} == {1}
    assert quality.classify(nothing, labels).count() == 0


def test_scores_keep_columns_of_any_name(spark):
    rows = [(i, f"some text {i} here", f"x{i}", i, "y") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _text string, _TEXT_ int, Score string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    got = quality.classify(docs, labels).collect()
    assert sorted((r.doc_id, r["_text"], r["_TEXT_"]) for r in got) == [(i, f"x{i}", i) for i in range(40)]
    assert all(0 <= r.score <= 1 for r in got)


def test_texts_and_features_reach_python_in_small_batches(spark, monkeypatch):
    ids = [i for i in range(2400) if zlib.crc32(str(i).encode()) % 4 != 2]
    docs = spark.createDataFrame([(i, f"word{i} and more") for i in ids], "doc_id long, text string").coalesce(1)
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, quality int").coalesce(1)

    def largest(*_):
        def run(batches):
            import pyarrow as pa
            most = max(b.num_rows for b in batches)
            yield pa.RecordBatch.from_arrays([pa.array([most], pa.int32()), pa.array([1.0])], ["place", "weight"])
        return run
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    monkeypatch.setattr(quality, "_train", largest)
    assert np.flatnonzero(quality.fit(docs, labels)).tolist() <= [512]
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_null_texts_score_as_empty_ones_whatever_their_column(spark):
    weights = np.zeros((1 << quality.BITS) + 1)
    weights[-1] = 0.5
    rows = [(1, None, "a"), (2, "", "b"), (3, "some words", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, other string")
    got = {r.doc_id: (r.text, r.other, r.score) for r in quality.score(df, weights).collect()}
    assert got[1][2] == got[2][2] == pytest.approx(1 / (1 + math.exp(-0.5))) and [(k, *got[k][:2]) for k in (1, 2, 3)] == rows
    assert quality.score(df, weights, "TEXT").count() == 3
