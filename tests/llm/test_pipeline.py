"""The pipeline's stages on one small input, and that every corpus query is registered."""

import corpus_pipeline
from pyspark.sql import functions as F

from leafmill.llm import common, queries

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_run_agrees_with_them(spark):
    docs = common.table(spark, SF, "documents")
    first, columns = docs.count(), docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after, _ = common.stage(stage(spark, docs, SF), name)
        assert after.columns == columns and after.count() <= docs.count()
        assert after.join(docs, "doc_id", "left_anti").count() == 0
        docs = after
    assert 0.5 * first < docs.count() <= first
    got = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == {r.doc_id for r in docs.select("doc_id").collect()}
    assert all(got[r.doc_id] == 0 for r in docs.where(F.length("text") == 0).collect())


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash", "decontaminate", "bpe"]
