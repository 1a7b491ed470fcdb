import pytest
from pyspark.sql import types as T

#: Columns of documents, and one whose name an operator might use itself.
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("score", T.StringType())])


@pytest.fixture(scope="session")
def frame(spark):
    """texts -> documents; a text may be (doc_id, text)."""

    def make(texts):
        rows = [(t if isinstance(t, tuple) else (i, t)) for i, t in enumerate(texts)]
        return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x") for i, t in rows], SCHEMA).repartition(3)

    return make


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
