import pytest
from llm_cases import SCHEMA, odd_rows


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(odd):
    """The same with columns named like the operators' own, and repeated rows."""
    from pyspark.sql import functions as F

    more = odd.union(odd.where("doc_id in (1, 6)"))
    for name in ("block", "payload", "src", "dest", "kind", "n", "d1", "rep", "root", "set", "words", "hash", "score", "item_id", "n_tokens", "Text2"):
        more = more.withColumn(name, F.lit("x"))
    return more
