import pytest


@pytest.fixture
def documents(spark, tmp_path):
    """Writes a documents table (and others) to a folder and returns the folder."""

    def write(rows, **others):
        schema = "doc_id long, text string, lang string, source string, n_chars long"
        full = [(i, t, "en", "src0", None if t is None else len(t)) for i, t in rows]
        spark.createDataFrame(full, schema).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        for name, df in others.items():
            df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write
