import pytest

SF = "/root/testdata/sf0.001"
ODD = [(90001, None), (90002, ""), (90003, "ab " * 200), (90004, "a" * 400), (90005, "a" * 300 + "b" * 20), (90006, "x " * 34), (90007, "x " * 36 + "\n\ty"), (90008, "é" * 120), (90009, "A b"), (90010, "a B"), (90011, "Same text, twice."), (90012, "Same text, twice.")]


@pytest.fixture(scope="session")
def docs(spark):
    """The smallest table with odd rows, out of order, and extra columns that clash with the operators' own names."""
    from pyspark.sql import functions as F

    base = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    all_ = base.unionByName(spark.createDataFrame(ODD, base.schema))
    extra = {"score": F.lit("s"), "fp": F.lit(1), "label": F.lit(None).cast("string"), "run": F.lit("r"), "base": F.lit(2.0), "kept": F.lit(True), "n": F.lit(0)}
    return all_.withColumns(extra).repartition(5).cache()


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.where("false")
