"""The pipeline end to end: each stage's decisions hold, and its rows stay documents."""

import corpus_pipeline
from tracewright.llm import common


def test_stages(spark, sf):
    docs = common.table(spark, sf, "documents")
    columns, counts = docs.columns, [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = common.settle(stage(spark, docs, sf))
        counts.append(docs.count())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    assert counts[0] > counts[1] > counts[2] == counts[3] and counts[4] == counts[5]
    assert docs.where("not round_trip").count() == 0 and docs.where("n_tokens > 0").count() > 0


def test_odd_documents(spark, sf):
    rows = [(1, None, "en", None, None, "a"), (1, None, "en", None, None, "a"), (None, "", None, "s", 0, "b"), (3, "long words. " * 30_000, "en", "s", 9, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size string")
    for given in (docs.drop("size"), docs.drop("size").limit(0)):
        out = given
        for _, stage in corpus_pipeline.STAGES:
            out = common.settle(stage(spark, out, sf))
        assert out.count() <= 2 * given.count()
