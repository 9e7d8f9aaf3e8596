import corpus_pipeline
from tests.llm import cases
from tests.llm.test_decontamination import brute as contaminated
from tests.llm.test_near_copies import brute_kept
from tests.llm.test_sharding import jump


def test_stages_one_after_the_other(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    names = docs.columns
    at = {}
    for name, stage in corpus_pipeline.STAGES:
        at[name] = [r for r in docs.collect()]
        docs = stage(spark, docs, sf_dir)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == names
    last = docs.collect()
    good, one_each, clean, mixed = (at[n] for n in list(at)[1:])
    assert sorted(r.doc_id for r in one_each) == brute_kept([(r.doc_id, r.text) for r in good])
    hit = {r[0] for r in contaminated([(r.doc_id, r.text) for r in one_each], bench) if r[5]}
    assert {r.doc_id for r in clean} == {r.doc_id for r in one_each} - hit
    assert {r.doc_id for r in mixed} <= {r.doc_id for r in clean}
    assert {(r.doc_id, r.shard) for r in last} == {(r.doc_id, jump(r.doc_id, 8)) for r in mixed}
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(tuple, last))


def test_stages_on_an_empty_table(spark, sf_dir):
    docs = cases.empty(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.count() == 0
