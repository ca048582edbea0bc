import pytest

from pagegrain.llm import store
from tests_llm_rows import ROWS


@pytest.fixture(scope="session", autouse=True)
def _ready(spark):
    store.ready(spark)


@pytest.fixture(scope="session")
def odd(spark):
    cols = "doc_id long, text string, h long, id long, key long, th long, words string, n int, g long, spans string"
    return spark.createDataFrame([(i, t, None, 1, 2, 3, "w", 4, 5, "s") for i, t in ROWS], cols)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return [tuple(r) for r in docs.select("doc_id", "text").collect()]
