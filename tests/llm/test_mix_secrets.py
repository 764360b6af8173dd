import hashlib
import re
from collections import defaultdict

from llm_cases import EDGES, WORD, edges, frame, nothing, sample  # noqa: F401
from pyspark.sql import functions as F

from reviewlake.llm import curriculum, secret_scan


def aims(words):
    """Targets by the rule as it is told: share by weight, hand on what full sources leave."""
    order = sorted((s for s in words if s is not None)) + [None] * (None in words)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    got, open_, rest = dict.fromkeys(order, 0.0), set(order), 1.5 * sum(words.values())
    while open_ and rest > 1e-9:
        share = rest / sum(weight[s] for s in open_)
        for s in open_:
            got[s] += weight[s] * share
        rest = sum(max(0.0, got[s] - 2 * words[s]) for s in open_)
        for s in list(open_):
            if got[s] >= 2 * words[s]:
                got[s] = 2.0 * words[s]
                open_.discard(s)
    return got


def check_plan(df, docs):
    n = lambda t: len(WORD.findall(t or ""))
    words = defaultdict(int)
    for _, t, s in docs:
        words[s] += n(t)
    want, taken = aims(words), defaultdict(int)
    rows = curriculum.plan(df).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r.source_size == words[r.source] and abs(r.target - want[r.source]) < 1e-6 and 0 <= r.taken <= 2 * r.size
        assert (r.position is None) == (r.taken == 0)
        assert all(0 <= x <= 1 for x in (r.position, r.again) if x is not None)
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in words)
    assert sorted((str(r.doc_id), r.size) for r in rows) == sorted((str(i), n(t)) for i, t, _ in docs)
    return rows


def test_plan_meets_targets(spark, edges, nothing, sample):
    df, docs = sample
    rows = check_plan(df, docs)
    again = curriculum.plan(df).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    check_plan(edges, [(i, t, None if i is None else f"src{i % 3}") for i, t in EDGES])
    assert curriculum.plan(nothing).count() == curriculum.mix(nothing).count() == 0


def test_due_inverts_the_integral(spark):
    for schedule in curriculum.SCHEDULES + ((0.0, 2.0), (3.0, 0.5, 0.5, 1.0)):
        step = 1 / (len(schedule) - 1)

        def done(t, schedule=schedule, step=step):
            total = 0.0
            for k, (a, b) in enumerate(zip(schedule, schedule[1:], strict=False)):
                x = min(max(t - k * step, 0.0), step)
                total += a * x + (b - a) / step * x * x / 2
            return total
        df = spark.range(21).select((F.col("id") / 20).alias("share"))
        for r in df.select("share", curriculum.due(schedule, F.col("share")).alias("t")).collect():
            assert abs(done(r.t) / done(1.0) - r.share) < 1e-9


def test_mix_makes_the_planned_copies(spark, edges, sample):
    df, docs = sample
    for frame_ in (df, edges):
        planned, mixed = curriculum.plan(frame_).collect(), curriculum.mix(frame_)
        assert mixed.columns == frame_.columns
        want, got = defaultdict(int), defaultdict(int)
        for r in planned:
            want[r.doc_id] += r.taken
        texts = defaultdict(set)
        for r in frame_.collect():
            texts[r.doc_id].add(r.text)
        for r in mixed.collect():
            got[r.doc_id] += len(WORD.findall(r.text))
            assert any(t and t.startswith(r.text) for t in texts[r.doc_id])
        assert got == {k: v for k, v in want.items() if v}


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def base_spans(text):
    found = [(m.start(), 0, "assign", m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, "access", m.end(), m[0]) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return sorted(found + [(m.start(), 2, "hex", m.end(), m[0]) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32])


def key_spans(text):
    base = base_spans(text)
    return [(m.start(), 3, "key", m.end(), m[0]) for m in re.finditer("[A-Za-z0-9+/_-]+", text)
            if len(m[0]) >= 20 and re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0])
            and not any(b[0] <= m.start() and m.end() <= b[3] for b in base)]


def check_scan(df, docs):
    owners, repositories = defaultdict(set), defaultdict(set)
    for i, t, s in docs:
        for x in base_spans(t or "") + key_spans(t or ""):
            owners[x[4]].add(s)
            repositories[x[4]].add((i, t))
    example = lambda x: len(owners[x[4]]) >= 3 and len(repositories[x[4]]) >= 5
    got = secret_scan.scan(df).select(
        "doc_id", secret_scan.written(F.col("base")).alias("base"), secret_scan.written(F.array_sort(F.concat("base", "added"))).alias("spans"),
        "n_example", "n_live_base").collect()
    told = lambda xs: ",".join(f"{k}:{a}:{e}" for a, _, k, e, _ in sorted(xs))
    want = []
    for i, t, _ in docs:
        base = base_spans(t or "")
        added = [x for x in key_spans(t or "") if not example(x)]
        shared = sum(map(example, base))
        want.append((str(i), told(base), told(base + added), shared, len(base) - shared))
    assert sorted((str(r.doc_id), *tuple(r)[1:]) for r in got) == sorted(want)
    return got


def test_scan_equals_brute_force(spark, edges, nothing):
    key, shared = "Zk9" + "aB3xQ" * 5, "Ex4mpleKey" * 3
    texts = ["password: token: abcdefgh12", "token=secret=abcdefghij", 'API_KEY = "é漢🙂" apikey:"abc.def-123" 🙂 Passwd=short',
             "AKIA" + "A" * 11, "x AKIA" + "AKIA" * 4 + " y", "0" * 31 + " " + "a1" * 20 + "g", f"own {key} here", f"{shared} and {key}",
             shared, f"SECRET={shared}", "toKen  =  'abcdefgh'", "ſecret=abcdefghijk toKen=abcdefghijk", "", None, "a" * 40, key, key + " " + key]
    docs = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, f"token={key}"), (40, shared), (41, shared), (42, f"api_key={shared}")]
    df = frame(spark, docs)
    got = check_scan(df, [(i, t, None if i is None else f"src{i % 3}") for i, t in docs])
    assert sum("key:" in r.spans for r in got) > 0 and sum(r.n_example for r in got) > 0
    check_scan(edges, [(i, t, None if i is None else f"src{i % 3}") for i, t in EDGES])
    assert secret_scan.scan(nothing).count() == 0


def test_scan_of_the_driver_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = check_scan(df, [(r.doc_id, r.text, r.source) for r in df.collect()])
    assert sum(r.base != "" for r in got) > 0


def test_many_secrets_in_one_text(spark):
    text = " ".join(f"token={hashlib.md5(str(i).encode()).hexdigest()}" for i in range(1500))
    check_scan(frame(spark, [(1, text)]), [(1, text, "src1")])


def test_examples_need_owners_and_repositories(spark):
    keys = {name: f"{name}Key0" * 4 for name in ("one", "few", "many", "wide")}
    docs = [(i, f"holds {keys['one']} here", "src0") for i in range(9)]  # nine documents of one owner
    docs += [(20 + i, f"holds {keys['few']} here", f"src{i}") for i in range(4)]  # four owners, four documents
    docs += [(30 + i, f"holds {keys['many']} here", f"src{i % 2}") for i in range(9)]
    docs += [(40 + i, f"holds {keys['wide']} here", f"src{i % 3}") for i in range(5)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    live = {r.doc_id for r in check_scan(df, docs) if "key:" in r.spans}
    assert live == {i for i, _, _ in docs if i < 40}


def test_a_hundred_thousand_spans_in_one_text(spark):
    text = " ".join(f"{i:032x} Zk{i:030d}" for i in range(50_000))
    (r,) = secret_scan.scan(frame(spark, [(1, text)])).select(F.size("base").alias("n"), F.size("added").alias("k")).collect()
    assert (r.n, r.k) == (len(base_spans(text)), 50_000)


def test_the_plan_keeps_columns_of_any_name(spark):
    names = ["h", "th", "bucket", "offset", "inside", "begin", "aim", "place", "weight", "s", "b", "row", "id"]
    docs = spark.createDataFrame([(i, f"one two three {i}", f"src{i % 3}", *(f"{n}{i}" for n in names)) for i in range(60)],
                                 "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names))
    planned = curriculum.plan(docs).collect()
    assert all(r[n] == f"{n}{r.doc_id}" for r in planned for n in names) and len(planned) == 60
    mixed = curriculum.mix(docs)
    assert mixed.columns == docs.columns
    assert all(r[n] == f"{n}{r.doc_id}" for r in mixed.collect() for n in names)


def test_a_row_repeated_in_a_third_of_all_rows(spark):
    rows = [(i, f"word{i} " * (i % 7 + 1), f"src{i % 4}") for i in range(400)]
    rows += [(5, "the same five words again", "src1")] * 150 + [(None, "a text without an id", None)] * 100
    rows += [(None, f"other {i % 20} text", "src2") for i in range(60)] + [(9, None, "src0")] * 30
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, source string, n long").repartition(7)
    planned = check_plan(docs, rows)
    assert sorted(r.n for r in planned) == list(range(len(rows)))
    texts, mixed = dict(enumerate(t for _, t, _ in rows)), curriculum.mix(docs).collect()
    got = defaultdict(int)
    for r in mixed:
        assert texts[r.n].startswith(r.text)
        got[r.source] += len(WORD.findall(r.text))
    want = defaultdict(int)
    for r in planned:
        want[r.source] += r.taken
    assert dict(got) == {s: n for s, n in want.items() if n}
    by_row = defaultdict(int)
    for r in mixed:
        by_row[r.n] += 1
    assert max(by_row.values()) <= 2
    narrow = curriculum.plan(docs.drop("n").coalesce(1)).collect()  # whatever the parts, rows alike take the same
    key = lambda r: (str(r.doc_id), str(r.source), r.size, r.taken, str(r.position), str(r.again))
    assert sorted(map(key, narrow)) == sorted(map(key, planned))
