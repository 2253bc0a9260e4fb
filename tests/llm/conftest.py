import pytest

from escalade.llm import common as C

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    """The small documents table as {doc_id: text}."""
    return {r["doc_id"]: r["text"] for r in C.table(spark, SF, "documents").select("doc_id", "text").collect()}


@pytest.fixture(scope="session")
def table(spark, tmp_path_factory):
    """Rows as a written table (the operators read their input more than once)."""
    def make(rows, schema="doc_id long, text string", parts=3):
        path = str(tmp_path_factory.mktemp("t") / "t.parquet")
        spark.createDataFrame(rows, schema).repartition(parts).write.parquet(path)
        return spark.read.parquet(path)
    return make
