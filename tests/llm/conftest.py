"""Small document tables with the cases every operator must stand: see ``odd_docs``."""

import pytest

LONG = " ".join(f"word{i % 977} the of" for i in range(20000))
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_rows():
    base = "the quick brown fox of the north and the lazy dog is in a house by the river"
    return [
        (1, base, "en", "a", 10), (2, base, "en", "a", 10), (2, base, "en", "a", 10), (3, base + " again", None, "a", None), (4, None, "en", None, None), (5, "", "fr", "b", 0),
        (6, " \n\t ", None, "b", 3), (7, "le chat est dans la maison et les oiseaux de la rue", "fr", "b", 1), (None, "no id here at all", "en", "c", 1), (9, LONG, "en", "c", len(LONG)),
        (10, "日本語 😀 ▁ text \x00 with\x85odd", "en", "c", 2), (11, "12345 67 %%%", "de", "c", 2), (12, "der hund ist in dem haus und die katze nicht", "de", "c", 2)]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    """Nulls everywhere, empty and very long texts, repeated rows, and columns with clashing names."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(odd_rows, COLUMNS)
    clashing = ["score", "fp", "h", "word", "key", "rep", "hashes", "ids", "predicted", "lang_pred", "paragraph", "findings", "component_id", "_k", "size"]
    return df.select("*", *[F.lit(f"x{i}").alias(c) for i, c in enumerate(clashing)])


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], COLUMNS)
