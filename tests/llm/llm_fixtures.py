"""Document fixtures of the training-data tests (imported by name; a second conftest would hide the first)."""

import pytest

from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)
# names that the operators use inside
CLASHING = ["fp", "root", "node", "a", "b", "n", "size", "shard", "_w", "_doc", "_h", "_gone", "_lost", "kept_text", "n_lines", "score", "anchor"]


@pytest.fixture
def make_docs(spark):
    def make(pairs, clash=False):
        rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in pairs]
        df = spark.createDataFrame(rows, DOCS)
        if clash:
            from pyspark.sql import functions as F

            df = df.select("*", *[F.lit(f"x{i}").alias(c) for i, c in enumerate(CLASHING)])
        return df

    return make


EDGES = [
    (1, None),
    (2, ""),
    (3, " \t\n "),
    (4, "one"),
    (5, "é ü 漢字   x"),
    (6, "same text here, again and again"),
    (7, "same text here, again and again"),
    (7, "same text here, again and again"),
    (None, "a row without an id"),
    (None, None),
]


@pytest.fixture
def edges(make_docs):
    return make_docs(EDGES, clash=True)
