import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    return SF


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, columns whose names clash with the operators' own."""
    long = " ".join(f"word{i % 7919} and of" for i in range(30_000))
    rows = [(1, ""), (2, None), (None, "a null id with some words in it"), (None, None), (3, "a b c"), (3, "a b c"), (4, long), (5, long),
            (6, long + " tail"), (7, " \t\n "), (8, "One. Two, three!"), (3, "a different text of the same id"), (9, "ÀÉ “x”   y")]
    extra = "size long, source_size long, target string, taken int, copies int, score double, tail double, expected_grade int, start int, tie int, rep int, c int, a int, b int, rank int, n int, unit int"
    source = ["x", None, "x", "y", "y", "y", "x", "x", "é", None, "z", "z", None]
    return spark.createDataFrame([(*r, s, "en" if k % 2 else None, None, *_fill(extra, k)) for k, (r, s) in enumerate(zip(rows, source))],
                                 f"doc_id long, text string, source string, lang string, n_chars long, {extra}")


def _fill(extra, k):
    kinds = {"long": k, "int": k, "double": float(k), "string": "t"}
    return [None if k % 3 == 0 else kinds[f.split()[1]] for f in extra.split(", ")]


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def doc_rows(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
