import pytest
from pyspark.sql import types as T

#: Columns whose names clash with those that operators use inside.
CLASHING = ["node", "row", "training", "bands", "key", "h", "id", "runs", "words", "lines", "bad", "y"]


@pytest.fixture(scope="session")
def documents(spark):
    """Builds documents from ``(doc_id, text)`` with further columns of clashing names."""
    schema = T.StructType(
        [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
        + [T.StructField(c, T.StringType()) for c in CLASHING]
    )

    def build(rows):
        rows = [(i, t, None if t is None else len(t), *["z"] * len(CLASHING)) for i, t in rows]
        return spark.createDataFrame(rows, schema)

    return build


@pytest.fixture(scope="session")
def labels(spark):
    def build(rows, name):
        return spark.createDataFrame(rows, f"doc_id long, {name} int")

    return build
