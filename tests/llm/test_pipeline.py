import corpus_pipeline
from siftwise.llm import pii
from tests.llm.helpers import DATA, real


def test_stages_one_by_one(spark):
    docs = real(spark)
    columns, before = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, DATA)
        if k + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == columns
        rows = docs.count()
        if name in ("quality", "simhash_dedup"):
            assert 0 < rows < before
        if name == "pii":
            assert rows == before and docs.filter(~pii.no_personal_data(docs["text"])).count() == 0
        before = rows


def test_run(spark):
    done = corpus_pipeline.run(spark, DATA)
    assert done.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert all(r["offset"] + r["length"] <= 4096 for r in done.collect())
