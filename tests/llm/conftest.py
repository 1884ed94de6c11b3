import pytest
from pyspark.sql import types as T

from tests.llm import data


@pytest.fixture(scope="session")
def rows():
    return data.documents()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, data.DOC_SCHEMA).repartition(4)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], data.DOC_SCHEMA)


@pytest.fixture(scope="session")
def labels(spark, rows):
    made = [(r[0], 1 if i % 3 else 0, 0) for i, r in enumerate(rows)] + [(10 ** 9, 1, 0), (1, None, None), (None, 1, 0)]
    return spark.createDataFrame(made, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def clashing():
    """A function that adds columns with names that operators use."""
    from pyspark.sql import functions as F

    names = ["ids", "bytes", "size", "shard", "slot", "kept", "n_words", "fingerprint", "copies", "target",
             "host", "rule", "N_Removed", "n_bytes", "base_failed", "source_size", "a column",
             "whole", "need", "_last", "_before", "_end", "_source", "_place", "_range", "_id", "_t1", "_t2", "_n",
             "_stratum", "_stratum_of", "_first", "_cut_long_words", "_quality", "_keys", "_key", "_allow", "_copy",
             "word", "words", "code", "output", "labels", "place", "of", "range", "end", "last", "before", "upto"]
    return lambda df: df.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names) if n.lower() not in
                                       [c.lower() for c in df.columns]])


@pytest.fixture(scope="session")
def struct():
    return T
