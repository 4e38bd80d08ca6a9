"""The pipeline against its operators' brute-force meaning."""

import corpus_pipeline
from corpusloom.llm import decontaminate, minhash, toxicity


def test_stages_do_their_work(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = docs
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, rows, sf_dir)
        assert out.columns == docs.columns, name
        rows = spark.createDataFrame(out.collect(), docs.schema)
        seen.append({r.doc_id: r.text for r in rows.collect()})
    texts = {r.doc_id: r.text for r in docs.collect()}
    clean, lined, single, last = seen
    scores = {r.doc_id: r.toxicity for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    assert set(clean) == {d for d, s in scores.items() if s < toxicity.THRESHOLD} < set(texts)
    # lines only go, in order
    for d, text in lined.items():
        left = iter(clean[d].split("\n"))
        assert all(any(line == other for other in left) for line in text.split("\n"))
    # nothing near is left, and only near copies went
    again = minhash.near_duplicates(rows)
    assert again.where("not kept").count() == 0
    assert set(single) < set(lined)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    assert decontaminate.contaminated(rows, items).count() == 0
    out = corpus_pipeline.STAGES[-1][1](spark, rows, sf_dir).collect()
    assert {r.doc_id: r.decoded for r in out} == last


def test_stages_on_odd_rows(spark, sf_dir):
    """Null, empty, repeated and very long rows, extra columns, and no rows at all."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(30)
    long = " ".join(f"word{i}" for i in range(30_000))
    extra = [(9001, None), (9002, ""), (9003, " \n"), (9004, long), (9004, long), (None, "no id of its own here"), (None, None)]
    odd = spark.createDataFrame([(i, t, None, None, None) for i, t in extra], docs.schema)
    every = docs.union(odd).selectExpr("*", "1 as n", "'x' as words", "2 as component", "3 as _toxicity")
    for rows in (every, every.limit(0)):
        rows = spark.createDataFrame(rows.collect(), every.schema)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, rows, sf_dir)
            assert out.columns == every.columns, name
            rows = spark.createDataFrame(out.collect(), every.schema)
        left = [r.doc_id for r in rows.where("source is null").collect()]
        coded = corpus_pipeline.STAGES[-1][1](spark, rows, sf_dir).collect()
        assert len(coded) == rows.count()
        if coded:
            assert {9001, 9002, 9003, 9004, None} <= set(left)
            assert all(r.decoded == "" for r in coded if r.doc_id in (9001, 9002))


def test_batches_only_get_smaller(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        for given, then in (("64m", str(corpus_pipeline.BATCH_BYTES)), ("1m", "1m"), ("1024k", "1024k")):
            spark.conf.set(key, given)
            corpus_pipeline.small_batches(spark)
            assert spark.conf.get(key) == then
    finally:
        spark.conf.set(key, before)
