import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """documents(rows of (doc_id, text)): with the other columns, and extra ones whose names the operators use too."""

    def make(rows, extra=True):
        df = spark.createDataFrame([(i, t, "en", "src", None if t is None else len(t)) for i, t in rows], DOCS)
        if extra:
            from pyspark.sql import functions as F

            df = df.withColumns({"n_lines": F.lit("mine"), "kept": F.lit("mine"), "spans": F.lit(1), "start": F.lit(1.5), "h1": F.lit(0)})
        return df

    return make
