import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, shard int, size string, score double, h bigint, u bigint, copies int, spans string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows and ids, and columns named like the operators' own."""
    long = " ".join(f"word{i % 977} filler{i % 31}" for i in range(60_000))
    rows = [(1, "one two three four five six", "en", "a", 27), (2, "one two three four five six", "en", "a", 27),
            (3, None, "en", "b", None), (4, "", None, "b", 0), (5, "   \n\t ", "en", None, 6), (6, long, "en", "c", len(long)),
            (7, "ONE two three four five six", "de", "c", 27), (None, "no id here at all", "en", "a", 17), (None, None, None, None, None),
            (8, "repeated row", "en", "a", 12), (8, "repeated row", "en", "a", 12), (9, "same id first text", "en", "a", 18),
            (9, "same id second text", "en", "b", 19), (10, "größe ñandú élève 東京 \U0001f600 end", "de", "é", 20)]
    return spark.createDataFrame([(*r, 5, "x", 0.5, 1, 2, 3, "s") for r in rows], DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def sf001(spark):
    from matchspark.plans.registry import ship_package
    ship_package(spark)
    return "/root/testdata/sf0.001"
