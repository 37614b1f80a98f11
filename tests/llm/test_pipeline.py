"""The pipeline's stages, each on what its predecessor kept, and the registered queries beside their SQL."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.oracle_check import compare, connect
from widemargin.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, sf_dir, name):
    assert compare(QUERIES[name](spark, sf_dir), connect(sf_dir), SQL[name]) is None


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, sf_dir)
        assert out.columns == columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        counts.append(docs.count())
    bad = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 0").count()
    assert counts[0] - counts[1] >= 0.7 * bad and counts[2] < counts[1] and counts[3] <= counts[2] and counts[4] == counts[3]
    assert not docs.where(F.col("text").rlike("[a-z0-9]@[a-z0-9-]+[.][a-z]")).count()
    mixed = corpus_pipeline.run(spark, sf_dir)
    assert 0 < mixed.count() <= counts[4] and mixed.where("copies < 1 OR copies > 3").count() == 0
