import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text[, lang, source]) with further, clashing columns."""

    def make(rows, parts=3):
        full = [(r[0], r[1], *(list(r[2:]) + [None, None])[:2], None) for r in rows]
        df = spark.createDataFrame(full, SCHEMA).repartition(parts)
        return df.selectExpr("*", "doc_id as fp", "'x' as component_id", "1 as size", "text as _key", "'y' as shard", "0 as n", "'z' as block")

    return make


#: Nulls in any column, empty and blank texts, a long text, ties and repeated rows.
ODD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one two"), (6, "one two three four five six"), (6, "one two three four five six"),
    (None, "one two three four five six"), (7, "é ü 漢字 " * 40), (8, "long " * 30000), (9, None, "en", "a"), (None, None, None, "a"),
    (10, "Same words in here, all of them the same.", "en", "b"), (11, "Same words in here, all of them the same.", "en", "b"), (12, "²³ 123 -- !", "de", None),
]


@pytest.fixture(scope="session")
def odd(make_docs):
    return make_docs(ODD)


@pytest.fixture(scope="session")
def no_docs(make_docs):
    return make_docs(ODD).limit(0)
