"""Small tables with every odd case the operators define a result for."""

import pytest

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """NULLs in every column, empty and long texts, repeated rows, clashing extra columns."""
    base = " ".join(f"word{i}" for i in range(80))
    rows = [(1, base, "en", "src0"), (2, base, "en", "src0"), (2, base, "en", "src0"), (3, None, "en", "src1"), (4, "", None, None),
            (5, " \n\t ", "de", "src0"), (6, LONG, "en", "src2"), (None, base, "en", "src0"), (8, base.upper(), "en", "src0"),
            (9, base.replace("word40", "other"), "en", None), (10, "one two three", "fr", "src1"), (11, "123 456 !!", "fr", "src1"),
            (12, "\n".join(["same line here again"] * 30), "en", "src1"), (13, base + " tail", "en", "src3")]
    more = [(i, t, l, s, len(t or ""), 1, "x", 2, "y") for i, t, l, s in rows]
    return spark.createDataFrame(more, "doc_id long, text string, lang string, source string, n_chars long, "
                                       "node long, label string, n_words long, kept string")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
