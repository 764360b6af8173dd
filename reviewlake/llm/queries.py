"""The operators' registered queries and, where SQL can express one, its DuckDB twin.

Each query applies an operator with production parameters to its whole table and derives the
result's digest columns from the operator's own output.
"""

from __future__ import annotations

import re

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.session import scratch_path
from reviewlake.sources.tables import read_table

from . import (ball_kmeans, collocations, curriculum, ffd_packing, imatch, line_dedup, packing, quality, secret_scan, simhash,
               token_counts, topk, wavelet)
from .common import documents

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all documents, through a cache made for this call."""
    counts = token_counts.token_counts(documents(spark, sf_dir), public_tokenizers.path(BYTE_BPE),
                                       scratch_path(spark, "token-cache"))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learned from the labels of three quarters of the ids."""
    scored = quality.classify(documents(spark, sf_dir).select("doc_id", "text"), read_table(spark, sf_dir, "labels"), 0.7)
    return scored.select("doc_id", "held_out", "score", "predicted")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 ids, each document ended by id 0."""
    packed = packing.pack(documents(spark, sf_dir), public_tokenizers.path(BYTE_BPE), 2048, 0)
    return packed.select("doc_id", "piece", "start", "length", F.crc32("token_ids").alias("ids_crc32"), "sequence_id", "offset")


def op4_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I-Match fingerprints of all documents and of their edited texts."""
    return imatch.fingerprints(documents(spark, sf_dir))


def op5_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in a mix of 150 % of their words, ordered by their time in training."""
    planned = curriculum.by_position(curriculum.plan(documents(spark, sf_dir)))
    return planned.select("doc_id", "size", "source_size", "target", "taken", "position", "again")


def op6_wavelet_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids (each ended by id 2), written as wavelet shards and read back."""
    path = wavelet.write_shards(documents(spark, sf_dir), scratch_path(spark, "wavelet"), public_tokenizers.path(WORD_BPE), 2)
    return wavelet.read_shards(spark, path, ids_crc32=F.crc32("token_ids"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents: the base patterns' spans and owner-specific keys besides."""
    found = secret_scan.scan(documents(spark, sf_dir))
    base = F.col("base")
    return found.select(
        "doc_id", *(secret_scan.count_of(base, k).alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.sha2(secret_scan.written(base), 256).alias("base_sha256"),
        secret_scan.written(F.array_sort(F.concat("base", "added"))).alias("spans"), "n_example", "n_live_base")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the later copies of line runs of 50 words or more."""
    return line_dedup.dedup_lines(documents(spark, sf_dir), 50).select("doc_id", "n_lines", "n_deleted", "deleted", "text")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: 4-word shingles, at most 4 differing bits."""
    found = simhash.near_duplicates(documents(spark, sf_dir), 4, 4, 42)
    return found.select(F.col("id").alias("doc_id"), simhash.hex_fingerprint().alias("fingerprint"), "component_id")


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best rows for each vector whose id is divisible by 20, against all rows."""
    return topk.top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20, 64)


def op11_ffd_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents (each ended by id 2) in sequences of at most 4096 ids, none of them padded."""
    packed = ffd_packing.pack(documents(spark, sf_dir), public_tokenizers.path(WORD_BPE), 4096, 2)
    return packed.select("doc_id", "start", "length", F.crc32("token_ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's first 2000 phrases of two to three words that occur ten times or more."""
    return collocations.collocations(documents(spark, sf_dir), 10, 3, 50, 2000)


def op13_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors: 8 parts, 16 entries, 6 rounds."""
    coded = ball_kmeans.compress(read_table(spark, sf_dir, "embeddings"), 8, 16, 6, 4096)
    return coded.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


OP10_SQL = """
WITH v AS (SELECT DISTINCT vec_id, [floor(64 * x::DOUBLE)::HUGEINT for x in embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
e AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM v),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, sum(q.x * c.x)::BIGINT AS score
  FROM e q JOIN e c ON q.i = c.i AND q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""

def _sql_pattern(kind: str) -> str:
    """The pattern with either case of the keywords' letters spelled out."""
    def both(word: str) -> str:
        return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
    pattern = secret_scan.LONG.get(kind, secret_scan.KINDS[kind][0]).replace("'", "''")
    head, words, tail = re.match(r"^(\(?)(?:\(\?i:(.*?)\))?(.*)$", pattern, re.S).groups()
    return pattern if words is None else head + "|".join(map(both, words.split("|"))) + tail


def _op7_sql() -> str:
    found = []
    for place, (kind, (_, group, least)) in enumerate(secret_scan.KINDS.items()):
        pat = _sql_pattern(kind)
        found.append(
            f"SELECT doc_id, source, {place} AS place, '{kind}' AS kind, unnest(list_transform(hits, lambda x, i: {{'start': "
            "list_sum(list_transform(gaps[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda y: length(y))), 0), "
            f"'len': length(x), 'value': vals[i]}})) AS m, {least} AS least FROM (SELECT doc_id, source, "
            f"string_split_regex(t, '{pat}') AS gaps, regexp_extract_all(t, '{pat}') AS hits, regexp_extract_all(t, '{pat}', {group}) AS vals FROM d)")
    return f"""WITH d AS (SELECT doc_id, coalesce(source, chr(1)) AS source, coalesce(text, '') AS t FROM documents),
f AS ({" UNION ALL ".join(found)}),
s AS (SELECT doc_id, source, place, kind, CAST(m.start AS BIGINT) AS a, CAST(m.start + m.len AS BIGINT) AS z, m.value AS v
  FROM f WHERE length(m.value) >= least AND (kind <> 'key' OR (regexp_matches(m.value, '[0-9]') AND regexp_matches(m.value, '[A-Za-z]')))),
k AS (SELECT * FROM s WHERE kind <> 'key' OR NOT EXISTS (SELECT 1 FROM s b WHERE b.doc_id = s.doc_id AND b.kind <> 'key' AND b.a <= s.a AND s.z <= b.z)),
o AS (SELECT v, count(DISTINCT source) >= 3 AND count(DISTINCT doc_id) >= 5 AS shared FROM k GROUP BY v),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
  count(*) FILTER (kind = 'hex') AS n_hex, string_agg(concat(kind, ':', a, ':', z), ',' ORDER BY a, place) FILTER (kind <> 'key') AS base,
  string_agg(concat(kind, ':', a, ':', z), ',' ORDER BY a, place) FILTER (kind <> 'key' OR NOT shared) AS spans,
  count(*) FILTER (kind <> 'key' AND shared) AS n_example, count(*) FILTER (kind <> 'key' AND NOT shared) AS n_live_base
  FROM k JOIN o USING (v) GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_example, 0) AS n_example,
  coalesce(n_live_base, 0) AS n_live_base
FROM d LEFT JOIN g USING (doc_id)"""

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
OP12_SQL = f"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}') AS t FROM documents),
p AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w
  FROM (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d)),
g AS (SELECT lang, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS phrase
  FROM p, (VALUES (1), (2), (3)) AS k(n) WHERE len(w) >= n),
f AS MATERIALIZED (SELECT lang, n, phrase, count(*)::HUGEINT AS f FROM g GROUP BY ALL HAVING count(*) >= 10),
c AS (SELECT lang, n, phrase, f AS a, unnest(range(1, n)) AS k, string_split(phrase, ' ') AS w FROM f WHERE n > 1),
s AS (SELECT c.lang, c.n, c.phrase, c.a, c.k, l.f AS l, r.f AS r, (1000000::HUGEINT * c.a * c.a) // (l.f * r.f) AS score FROM c
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(w[1:k], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(w[k + 1:], ' ')
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, c.k) = 1),
i AS (SELECT lang, phrase, max(f) AS longer FROM (SELECT lang, f, unnest([array_to_string(string_split(phrase, ' ')[1:2], ' '),
  array_to_string(string_split(phrase, ' ')[2:3], ' ')]) AS phrase FROM f WHERE n = 3) GROUP BY ALL),
t AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
o AS (SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) AS rank
  FROM s LEFT JOIN i ON s.n = 2 AND i.lang = s.lang AND i.phrase = s.phrase WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, t.n AS n, score::BIGINT AS score
FROM o JOIN t USING (lang) WHERE rank <= 2000"""


def _op13_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Every round is a pair of steps: nearest entries, then floors of their members' means."""
    def near(r):
        return (f"a{r} AS MATERIALIZED (SELECT row, p, k, d FROM (SELECT e.row, e.p, b.k, sum((e.x - b.c) * (e.x - b.c)) AS d "
                f"FROM e JOIN b{r} b USING (p, j) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY row, p ORDER BY d, k) = 1)")
    steps = [near(0)]
    for r in range(rounds):
        steps += [f"b{r + 1} AS MATERIALIZED (SELECT b.p, b.k, b.j, coalesce((s - ((s % n) + n) % n) // n, b.c) AS c FROM b{r} b "
                  f"LEFT JOIN (SELECT e.p, a.k, e.j, sum(x) AS s, count(*) AS n FROM e JOIN a{r} a USING (row, p) GROUP BY ALL) m USING (p, k, j))",
                  near(r + 1)]
    return f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::HUGEINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
w AS (SELECT (max(len(v)) + {parts - 1}) // {parts} AS w FROM v),
e AS MATERIALIZED (SELECT row, (i - 1) // w AS p, (i - 1) % w AS j, coalesce(v[i], 0) AS x
  FROM (SELECT row, v, w, unnest(range(1, {parts} * w + 1)) AS i FROM v, w)),
f AS (SELECT row, row_number() OVER (ORDER BY vec_id, v) - 1 AS k FROM v QUALIFY k < {entries}),
b0 AS MATERIALIZED (SELECT p, k, j, x AS c FROM e JOIN f USING (row)), {", ".join(steps)},
r AS (SELECT vec_id, label, string_agg(printf('%02x', k::INTEGER), '' ORDER BY p) AS code, sum(d)::BIGINT AS error
  FROM a{rounds} JOIN v USING (row) GROUP BY row, vec_id, label)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY p, k, j)) FROM b{rounds}) AS codebooks_sha256 FROM r"""


QUERIES = {f.__name__: f for f in (
    op1_token_counts, op2_quality, op3_best_fit_packing, op4_imatch, op5_curriculum, op6_wavelet_files, op7_secrets,
    op8_line_dedup, op9_simhash, op10_exact_top_k, op11_ffd_packing, op12_collocations, op13_ball_kmeans)}
ORACLES = {"op7_secrets": _op7_sql(), "op10_exact_top_k": OP10_SQL, "op12_collocations": OP12_SQL, "op13_ball_kmeans": _op13_sql()}
