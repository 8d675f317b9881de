"""Every query and the pipeline over tables without rows."""

import pytest

import corpus_pipeline
from renewscope.llm import registry


@pytest.fixture(scope="module")
def empty_dir(spark, sf_dir, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "labels", "embeddings"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.mark.parametrize("name", [*registry.load()[0], "pipeline"])
def test_no_rows_in_no_rows_out(spark, empty_dir, name):
    query = {**registry.load()[0], "pipeline": corpus_pipeline.run}[name]
    assert query(spark, empty_dir).count() == 0
