import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

DOCS = StructType(
    [
        StructField("doc_id", LongType()),
        StructField("text", StringType()),
        StructField("lang", StringType()),
        StructField("source", StringType()),
        StructField("n_chars", LongType()),
    ]
)


@pytest.fixture
def docs(spark):
    """A documents table of (doc_id, text) pairs or (doc_id, text, lang, source)."""

    def make(*rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, r[3] if len(r) > 3 else "s", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture
def odd(docs):
    """Nulls in every column, empty and blank texts, a repeated row, a very long text, and extra columns with clashing names."""
    df = docs(
        (1, None), (2, ""), (3, " \n\t "), (None, "some words without an id here"), (4, "one"), (4, "one"),
        (5, "long text " * 60_000), (6, "ÅÄÖ 数字 \U0001f600 mixed"), (7, "no source", None, None),
    )
    for name in ("signature", "digest", "key", "score", "ids", "chunk", "begin", "node", "component", "_base", "_spans", "h", "id"):
        df = df.selectExpr("*", f"'x' AS {name}")
    return df


@pytest.fixture
def none(docs):
    return docs().limit(0)
