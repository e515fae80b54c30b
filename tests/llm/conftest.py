import pytest


@pytest.fixture()
def frame(spark):
    """A frame of documents with an extra column whose name clashes with what operators use inside."""

    def make(rows, schema="doc_id long, text string", extra=True):
        df = spark.createDataFrame(rows, schema)
        if extra:
            for name in ("id", "token", "component", "kept", "n"):
                if name not in df.columns:
                    df = df.selectExpr("*", f"'clash' as {name}")
        return df

    return make
