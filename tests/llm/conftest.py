import duckdb
import pytest

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def rows():
    """Rows of a test table as dicts."""
    def get(name, folder=SMALL):
        cur = duckdb.execute(f"select * from '{folder}/{name}.parquet'")
        names = [d[0] for d in cur.description]
        return [dict(zip(names, r, strict=True)) for r in cur.fetchall()]

    return get


@pytest.fixture
def docs(spark):
    """A documents table from (doc_id, text) or (doc_id, text, lang, source)."""
    def make(found):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or "")) for r in found]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")

    return make
