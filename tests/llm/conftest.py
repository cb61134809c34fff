import duckdb
import pytest

SF_MED = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def med_docs():
    """(doc_id, text) of every document of the middle test set."""
    return duckdb.sql(f"select doc_id, text from '{SF_MED}/documents.parquet' order by 1").fetchall()
