import corpus_pipeline


def test_stages_on_the_smallest_corpus(spark):
    path = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, kept = docs.columns, {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = step(spark, docs, path).cache()
        assert docs.columns == columns, name
        now = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert now and now <= kept
        kept = now
    out = corpus_pipeline.STAGES[-1][1](spark, docs, path)
    assert sorted(r[0] for r in out.select("decoded").collect()) == sorted(r[0] or "" for r in docs.select("text").collect())


def test_names_and_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "jaccard_join", "suffix_dedup", "mix_sources", "bpe"] and corpus_pipeline.ORACLE_SQL is None
