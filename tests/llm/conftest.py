import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents of (id, text) pairs, with extra columns whose names operators might use themselves."""

    def make(rows, extra=True):
        df = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCS)
        if extra:
            for name in ("key", "sig", "node", "bucket", "kinds", "spans", "length", "rank", "sequence_id", "row", "c0", "__key", "__id", "toxic", "score"):
                from pyspark.sql import functions as F

                df = df.withColumn(name, F.lit("x"))
        return df

    return make
