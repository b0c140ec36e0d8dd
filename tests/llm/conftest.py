import pytest

LONG = "lorem ipsum dolor sit amet " * 4000


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, ties, a repeated id, clashing column names."""
    rows = [
        (1, None, "en"), (2, "", None), (None, "the cat sat on the mat and purred all day long", "en"), (None, None, None), (3, LONG, "en"), (4, LONG, "de"), (4, LONG, "de"), (5, "le chat est sur la table", "fr"),
        (5, "un autre texte avec le meme numero", "fr"), (6, "the cat sat on the mat and purred all day long", "en"), (7, " \t\n ", None), (8, "1234 5678 !!", "en"), (9, "a", "en"), (10, "\x00 ñandú 中文 \U0001f600", "es"),
    ]
    out = spark.createDataFrame([(*r, "s", None, 1, "x", b"y", 2.0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, d int, seed string, runs binary, fp double")
    return out.repartition(3)


@pytest.fixture(scope="session")
def empty(spark, odd):
    return spark.createDataFrame([], odd.schema)
