import os
import sys

import pytest
from pyspark.sql import types as T

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # Names that operators use inside: they must not clash.
        T.StructField("label", T.StringType()),
        T.StructField("key", T.LongType()),
        T.StructField("words", T.ArrayType(T.StringType())),
    ]
)


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(texts, ids=None, langs=None):
        rows = []
        for k, text in enumerate(texts):
            doc_id = k if ids is None else ids[k]
            rows.append((doc_id, text, langs[k] if langs else "en", "src", None, "extra", 7, ["x"]))
        return spark.createDataFrame(rows, DOCS).repartition(3)

    return make


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def corpus(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    return sorted((r.doc_id, r.text or "") for r in rows)
