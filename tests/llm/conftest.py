import pytest
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small(spark):
    return lambda name: spark.read.parquet(f"{SMALL}/{name}.parquet")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and extra columns with names that operators use."""
    rows = [
        (1, "A first text. It says a little."), (2, "A first text. It says a little."), (2, "A first text. It says a little."), (3, None), (4, ""), (5, "   \n\t "),
        (6, "x" * 30_000), (7, "word " * 20_000), (8, "é漢字😀 ▁ <s>  end"), (None, "no id"), (9, "one"), (10, "A FIRST text. It says a little."), (11, None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    names = ("blob", "hash", "fp", "n", "ids", "row", "shard", "component_id", "score", "findings", "lang", "_id", "chunk", "_sha", "_blob", "_findings", "id", "no_id", "sha", "salt", "low", "root", "g", "side", "node", "key", "keys", "sketch", "block", "kept", "keep_id", "text_sha256", "clean", "path", "a.b")
    extra = {c: F.lit("extra") for c in names}
    return docs.withColumns(extra)


@pytest.fixture(scope="session")
def unchanged(odd_docs):
    """Whether a stage's rows have the columns of ``odd_docs``, its extra values among them."""

    def test(found):
        return found.columns == odd_docs.columns and all(v == "extra" for r in found.collect() for v in list(r)[2:])

    return test


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
