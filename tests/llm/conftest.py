import pytest

from meibo.llm.ship import ship


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


#: Column names that the operators use inside, beside those of documents.
CLASHES = "id long, row long, digest string, heavy_digest string, best string, size int, class binary, label int, got string, page string, host string, key string, `a b` string"


@pytest.fixture
def documents(spark):
    """Documents from (doc_id, text[, lang]) rows, with extra columns whose names clash."""

    def make(rows):
        full = [(d, t, (x or ["en"])[0], "s", None) for d, t, *x in rows]
        docs = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
        return docs.selectExpr("*", *[f"cast(null as {c.rsplit(' ', 1)[1]}) as {c.rsplit(' ', 1)[0]}" for c in CLASHES.split(", ")])

    return make


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
