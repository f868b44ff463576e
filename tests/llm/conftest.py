import pytest
from llm_fixtures import CLASHING, edge_rows


@pytest.fixture(scope="session")
def edge(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(edge_rows(), "doc_id long, text string, lang string, source string, n_chars long")
    return df.repartition(3).withColumns({c: F.lit("x") for c in CLASHING})


@pytest.fixture(scope="session")
def nothing(edge):
    return edge.filter("false")
