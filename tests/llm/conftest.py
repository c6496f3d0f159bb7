import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) pairs, with columns whose names operators use inside."""

    def build(rows, clash=False):
        df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)
        if clash:
            from pyspark.sql import functions as F

            for name in ("_th", "key", "row", "n", "name", "word", "hits", "_id", "_t", "_drop", "_to", "_cell", "_at", "_before", "fp", "block", "n_words", "toxic", "digest"):
                df = df.withColumn(name, F.lit("x"))
        return df

    return build
