from pathlib import Path

import pytest

import corpus_pipeline
from arrowleaf.llm.queries import table

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")
def test_stages(spark):
    docs = table(spark, SF, "documents")
    before = {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        rows = [r.doc_id for r in out.collect()]
        assert len(rows) == len(set(rows)) and set(rows) <= before and len(rows) > 0.6 * len(before), name
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
