import pytest

LONG = "lorem ipsum dolor sit amet " * 8000


@pytest.fixture(scope="session")
def nasty(spark):
    """Documents with nulls in every column, empty and very long texts, ties, repeated rows, odd characters, and names that clash."""
    copy = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, " \n\t ", "en", "s", 4), (4, "word", "en", "s", 4), (5, copy, "en", "s", 9), (6, copy, "en", "s", 9), (6, copy, "en", "s", 9), (7, copy + " more", "de", "s", 9), (8, copy.upper(), "de", None, 9), (9, LONG, "fr", "s", 9), (10, "漢字 テスト ½ İ <|endoftext|> a\x00b\x1cc", "es", "s", 9), (None, copy, "es", "s", 9), (None, None, None, None, None), (-5, "the of and to idiot", "en", "s", 3)]
    t = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clash = ["score", "predicted", "rank_score", "label", "sid", "n", "key", "rate", "digest", "kept", "keep_id", "part", "ids", "sketch", "held", "held_out", "domain", "tokens", "posterior", "margin", "language", "range", "order", "locator", "root", "next_text"]
    from pyspark.sql import functions as F

    return t.withColumns({c: F.lit("x") for c in clash})


@pytest.fixture(scope="session")
def empty(spark, nasty):
    return spark.createDataFrame([], nasty.schema)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(2, 1, 0), (5, 1, 0), (5, 1, 0), (7, 0, 1), (10, 0, 1), (-5, 0, 1), (None, 1, 0), (9, None, None), (99, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def data():
    return "/root/testdata/sf0.001"
