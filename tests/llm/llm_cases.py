"""Rows and fixtures that the operators' tests share."""

import re

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, d string, th int, fp string, score string, t int, digest int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")

LONG = " ".join(f"w{i % 977}" for i in range(60_000))
EDGES = [(3, "some plain words here, twice."), (1, None), (2, ""), (3, "some plain words here, twice."),
         (None, "a text without an id"), (5, LONG), (6, "tie"), (7, "tie"), (8, "\n\n \n"), (9, "one\r\ntwo\tthree  four"),
         (10, "ünï 漢字 🙂 <|endoftext|> x"), (11, "SHOUT!! SHOUT!!\nSHOUT!!"), (12, " lead and trail ")]


def frame(spark, rows):
    """Documents with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", None if i is None else f"src{i % 3}", None if t is None else len(t),
                                   7, "d", 1, "f", "s", 2, 3) for i, t in rows], SCHEMA)


@pytest.fixture(scope="session")
def edges(spark):
    return frame(spark, EDGES)


@pytest.fixture(scope="session")
def nothing(spark):
    return frame(spark, [])


@pytest.fixture(scope="session")
def sample(spark):
    """The smallest driver table and its rows as Python has them."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    return df, sorted((r.doc_id, r.text, r.source) for r in df.collect())
