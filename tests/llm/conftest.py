from __future__ import annotations

import pytest

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside or for their results.
CLASH = [
    "key", "fp", "component", "size", "n", "target", "taken", "source_size", "doc", "row", "words",
    "n_words", "n_hit", "items", "lang_pred", "score", "bucket", "shard", "slot", "number", "block",
    "a", "b", "first", "text_crc32", "held_out", "scan", "p", "d",
]


def odd_rows():
    long = "very long text about nothing much " * 30_000
    return [
        (1, "alpha beta gamma delta", "en", "s1", 22),
        (1, "alpha beta gamma delta", "en", "s1", 22),
        (2, "alpha beta gamma delta", None, None, None),
        (3, None, "en", "s1", 0),
        (4, "", "en", "s2", 0),
        (5, " \t\n ", "de", "s2", 4),
        (None, "no id here at all", "de", "s2", 17),
        (None, None, None, None, None),
        (6, long, "de", "s1", len(long)),
        (7, long, "de", None, len(long)),
        (8, "1234 5678 !!", "fr", "s3", 12),
        (9, "Ünïcode wörds ÀÉ \U0001f600 end", "fr", "s3", 25),
        (10, "word", "xx", "s3", 4),
    ]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCUMENT)


@pytest.fixture(scope="session")
def odd_wide(odd):
    from pyspark.sql import functions as F

    return odd.select("*", *[F.lit(f"extra {c}").alias(c) for c in CLASH])


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCUMENT)


@pytest.fixture(scope="session")
def benchmark_rows(spark):
    rows = [(1, "alpha beta gamma"), (2, None), (3, ""), (None, "1234 5678"), (4, "about nothing much very long text " * 8)]
    return spark.createDataFrame(rows, "item_id long, text string")
