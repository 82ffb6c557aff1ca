import pytest

from edge_docs import DOC_SCHEMA, EDGE_DOCS


@pytest.fixture()
def tables(spark, tmp_path):
    """Writes document rows (and labels, embeddings) as a table folder and returns its path."""
    def write(docs=EDGE_DOCS, labels=(), vectors=(), extra=False):
        df = spark.createDataFrame(list(docs), DOC_SCHEMA)
        if extra:  # more columns, with names that operators use for their own
            for c in ("size", "n_words", "kept", "fp", "shard", "score", "_text", "_doc", "rate", "spans", "copies", "a.b", "key", "place"):
                df = df.withColumn(c, df["source"])
        df.write.parquet(str(tmp_path / "documents.parquet"))
        more = spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int")
        (more.withColumns({c: more["quality"] for c in ("text", "fold", "n.m")}) if extra else more).write.parquet(
            str(tmp_path / "labels.parquet"))
        more = spark.createDataFrame(list(vectors), "vec_id long, embedding array<float>, label int")
        (more.withColumns({c: more["label"] for c in ("shard", "dim", "queries", "cluster", "n.m")}) if extra else more).write.parquet(
            str(tmp_path / "embeddings.parquet"))
        return str(tmp_path)
    return write
