import pytest

DOCS = "doc_id long, text string"


@pytest.fixture(scope="module")
def docs_of(spark):
    """DataFrame of (doc_id, text) rows with extra columns whose names clash with the operators' own."""
    def make(rows, extra=True):
        df = spark.createDataFrame([tuple(r) for r in rows], DOCS)
        if extra:
            from pyspark.sql import functions as F
            for c in ("kind", "hash", "n", "start", "features", "label", "rep", "ids", "score"):
                df = df.withColumn(c, F.lit("x"))
        return df
    return make
