import pytest

#: Columns whose names the operators use themselves.
CLASHING = "doc_id long, text string, lang string, source string, n_chars long, size long, rank int, h string, content string, component string, bucket int, score double, kept boolean, target double, whole long, upto long, source_size long, plan_source string, lang_pred string"


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows):
        """rows: (doc_id, text[, lang[, source]]) as documents with clashing extra columns."""
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s1", 1, 7, 1, "x", "y", "z", 3, 0.5, False, 1.5, 1, 2, 3, "p", "q") for r in rows]
        return spark.createDataFrame(full, CLASHING).repartition(3)

    return make


ODD = [(1, None), (2, ""), (3, "  \t\n "), (4, "a"), (5, "word " * 9000), (5, "word " * 9000), (None, "no id here"), (6, "a  b\tc"), (7, "a b c"), (8, "<|endoftext|> x"), (9, "Ünï çødé ñ"), (10, "a b\u00a0c")]


@pytest.fixture
def odd(make_docs):
    return make_docs(ODD)


@pytest.fixture
def odd_rows():
    return ODD
