"""Shared fixtures: odd documents and an empty table."""

import pytest

SF_SMALL = "/root/testdata/sf0.001"

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, row string, id string, key int, size double, label string, "
          "class string, norm string, digest string, copies int, block int, kept boolean, mark string, nth int, copy string, m string")


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and extra columns with clashing names."""
    words = "the quick brown fox jumps over the lazy dog and runs away from all of them today".split()
    prose = " ".join(words[(i * 7 + i // 5) % len(words)] + ("." if i % 9 == 8 else "") for i in range(120))
    extra = ("r", "i", 1, 2.0, "l", "c", "n", "d", 7, 8, True, "k", 9, "y", "m")
    rows = [(1, prose, "en", "a", len(prose)), (2, prose.upper(), "en", "a", 0), (3, prose, "en", None, 0), (3, prose, "en", None, 0),
            (4, None, None, None, None), (5, "", "en", "b", 0), (6, " \n\t ", None, "b", 0), (None, prose + " one more", "en", "b", 0),
            (7, "word " * 30_000, "en", "c", 0), (8, "x" * 60_000, "fr", "c", 0), (9, "jim@mail.example.org +1 (705) 555-7016", "en", "c", 0),
            (10, "one two three", "en", "c", 0), (11, "ONE two three", "en", "c", 0), (12, "été 日本 😀 \x00 <|endoftext|> </s>", "fr", "d", 0)]
    full = [r + extra for r in rows]
    full[5] = rows[5] + (None,) * len(extra)
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="session")
def stored_odd_documents(spark, odd_documents):
    from hazardframe.llm.common import spool
    return spool(odd_documents, "odd-documents")


@pytest.fixture(scope="session")
def no_documents(spark):
    from hazardframe.llm.common import spool
    return spool(spark.createDataFrame([], SCHEMA), "no-documents")
