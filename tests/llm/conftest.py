import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF = "/root/testdata/sf0.001"
#: names that operators use inside, as further columns of their inputs
CLASHING = ["k", "n", "size", "score", "bytes", "shard", "_stats", "_score", "h", "component_id", "kept", "spans", "_k", "pos", "id"]


@pytest.fixture(scope="session")
def docs_rows():
    """Nulls in any column, empty and long texts, repeated rows and ids, ties."""
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega "
    rows = [(1, base * 2, "en", "a"), (2, base * 2, "en", "a"), (3, base * 2 + "one more word", None, "b"), (4, "", "en", "b"),
            (5, None, "en", None), (6, " \t\n ", "en", "b"), (7, long, "en", "c"), (8, "x" * 120_000, "en", "c"), (9, "é ü 漢字 😀 " * 60, "de", "a"),
            (10, "one two", "en", "a"), (11, "one two", "en", "a"), (11, "one two", "en", "a"), (12, "same id", "en", "b"), (12, "other text " * 30, "en", "b"),
            (None, base, "en", "c"), (13, "line one\nline two\nline three\n" * 20, "en", "c"), (14, "line one\nline two\nline three\n" * 20, "en", None),
            (15, "a" * 400, "en", "b"), (16, "the the the the the " * 50, "en", "d"), (17, "mail a@b.co or +1 (555) 555-0100 now", "en", "d")]
    return rows


@pytest.fixture(scope="session")
def docs(spark, docs_rows):
    import corpus_pipeline  # noqa: F401  the pipeline and the queries import from the repository's top
    from pyspark.sql import functions as F
    from textlab.llm import queries

    queries._importable(spark)
    d = spark.createDataFrame(docs_rows, "doc_id long, text string, lang string, source string").repartition(3, "doc_id")
    return d.select("*", F.length("text").cast("long").alias("n_chars"), *[F.lit(i).alias(c) for i, c in enumerate(CLASHING)])


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
