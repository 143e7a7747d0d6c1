from collections import Counter

import corpus_pipeline
from bibspark.llm import decontaminate, simhash

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = [docs.count()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = stage(spark, before, SF).persist()
        seen.append(docs.count())
        if i < 4:
            assert docs.columns == columns
        if i == 1:
            left = [simhash.fingerprint(r.text) for r in docs.collect()]
            assert all((a ^ b).bit_count() > 3 for k, a in enumerate(left) for b in left[k + 1 :])
        if i == 2:
            assert decontaminate.contaminated(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
        if i == 3:
            assert max(Counter(r.doc_id for r in docs.collect()).values()) <= 2
    assert seen[0] >= seen[1] >= seen[2] >= seen[3] and seen[5] == seen[4]
    rows = docs.orderBy("start").collect()
    assert rows[-1].start + rows[-1].n_tokens == sum(r.n_tokens for r in rows)


def test_run_and_odd_rows(spark, odd_documents, no_documents, monkeypatch):
    real = corpus_pipeline.table
    for docs, least in ((odd_documents, 1), (no_documents, 0)):
        monkeypatch.setattr(corpus_pipeline, "table", lambda s, d, name, docs=docs: docs if name == "documents" else real(s, d, name))
        got = corpus_pipeline.run(spark, SF)
        assert got.columns == ["doc_id", "start", "n_tokens", "tokens"]
        rows = sorted(got.collect(), key=lambda r: r.start)
        assert (len(rows) > 0) == bool(least)
        assert sum(r.n_tokens for r in rows) == sum(len(r.tokens) for r in rows)
