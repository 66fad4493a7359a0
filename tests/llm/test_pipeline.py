"""The pipeline against its stages' single decisions, and on odd and empty tables."""

import corpus_pipeline
from asofspark.llm import decontaminate, quality, secrets, simhash
from asofspark.llm.common import table

from .test_operators import empty, odd  # noqa: F401

SF = "/root/testdata/sf0.001"


def test_stage_by_stage(spark):
    docs = table(spark, SF, "documents")
    left = {r["doc_id"]: r["text"] for r in docs.collect()}
    s = {r["doc_id"]: r["_score"] for r in quality.score(docs.select("doc_id", "text"), quality.train(docs, table(spark, SF, "labels"))).collect()}
    left = {k: v for k, v in left.items() if s[k] >= quality.REJECT_BELOW}
    frame = lambda: spark.createDataFrame(list(left.items()), "doc_id long, text string")
    comp = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(frame()).collect()}
    left = {k: v for k, v in left.items() if comp[k] == k}
    hits = {r["doc_id"]: r["_n_hit"] for r in decontaminate.overlaps(frame(), table(spark, SF, "benchmark")).collect()}
    left = {k: v for k, v in left.items() if not hits[k]}
    left = {r["doc_id"]: r["text"] for r in secrets.masked(frame(), secrets.forest(secrets.derived_findings(spark))).collect()}
    got = corpus_pipeline.run(spark, SF).collect()
    assert got and all(left[r["doc_id"]] == r["text"] for r in got)
    assert {r["doc_id"] for r in got} <= set(left) and len({(r["doc_id"], r["copy"]) for r in got}) == len(got)


def test_stages_keep_the_columns(spark):
    docs = table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns


def test_clashing_columns_come_through(spark, odd):  # noqa: F811
    docs = table(spark, odd, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, odd)
        assert got.columns == docs.columns
        assert {r["_c"] for r in got.collect()} == {"clash"}


def test_odd_and_empty(spark, odd, empty):  # noqa: F811
    assert corpus_pipeline.run(spark, odd).count() >= 1
    assert corpus_pipeline.run(spark, empty).count() == 0
