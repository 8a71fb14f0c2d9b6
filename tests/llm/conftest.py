import os

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def corpus(spark, tmp_path):
    """Writes rows of (doc_id, text, source) as a documents table and returns its folder."""

    def make(rows, **tables):
        docs = [(i, t, "en", s, len(t) if t is not None else None) for i, t, s in rows]
        spark.createDataFrame(docs, SCHEMA).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return make


def pytest_configure():
    os.environ.setdefault("OMP_NUM_THREADS", "1")
