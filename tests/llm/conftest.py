import random

import pytest
from pyspark.sql import types as T

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(1, 9)))
    long = " ".join(word() for _ in range(30_000))
    rows = [
        (1, "The quick brown fox jumps over the lazy dog again and again.", "en", "a", 10),
        (2, "The quick brown fox jumps over the lazy dog again and again.", "en", None, 10),
        (2, "The quick brown fox jumps over the lazy dog again and again.", "en", None, 10),
        (3, None, None, "b", None),
        (4, "", "de", "b", 0),
        (5, " \t\n ", None, None, 4),
        (None, "mail me at someone@example.com or +1 (555) 123-4567 now", "en", "c", 1),
        (7, long, "fr", "a", len(long)),
        (8, "x" * 300_000, None, "c", 300_000),
        (9, "1 " * 5000, None, "c", 10_000),
        (10, "日本語 текст ñandú 😀 " * 20, "es", "d", 1),
        (11, "12345 !!! ???", None, "d", 13),
        (12, "ab\ud7ff\x00\x1f<|endoftext|>", None, "d", 5),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(spark, odd):
    """The same rows with columns named like those that operators make."""
    from pyspark.sql import functions as F

    names = ("fp", "label", "score", "size", "taken", "words", "text_", "base", "extra", "spans", "n_words", "block", "key", "part", "uid", "copies", "n_bytes", "media", "host", "shape", "trusted", "start", "length")
    return odd.select("*", *(F.lit("z").alias(n) for n in names))


@pytest.fixture(scope="session")
def clashing_pages(spark):
    from pyspark.sql import functions as F

    names = ("host", "path", "rule", "verdict", "hit", "words", "word", "n", "name", "buckets", "class", "count", "known")
    return spark.createDataFrame(PAGES, "page_id long, url string, html string").select("*", *(F.lit("z").alias(n) for n in names))


PAGES = [
    (1, "http://www.CheapPills.example.com/en/5", "<p>cheap pills cheap pills</p>"),
    (2, None, None),
    (3, "no scheme", ""),
    (4, "x://example.net/en/1?q#f", "<b>x"),
    (5, "https://a.b.org", "x"),
    (5, "https://a.b.org", "x"),
    (6, "https://été.example.org/fr/a", "long " * 200_000),
    (None, "http://", "y"),
]


@pytest.fixture(scope="session")
def small(tmp_path_factory, spark, odd):
    """A folder of tables with odd documents and pages, and empty labels."""
    path = str(tmp_path_factory.mktemp("odd"))
    odd.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (4, 0, 0), (4, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(PAGES, "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    return path


@pytest.fixture(scope="session")
def empty(tmp_path_factory, spark, none):
    path = str(tmp_path_factory.mktemp("none"))
    none.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    assert T is not None
    return path
