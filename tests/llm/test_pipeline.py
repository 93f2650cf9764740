import pyarrow.parquet as pq
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from leafmill.llm import toxicity
from tests.llm import brute


def test_stages_as_by_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [r["text"] for r in pq.read_table(f"{sf}/benchmark.parquet").to_pylist()]
    scores = toxicity.scores(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()
    toxic = {r.doc_id for r in scores if r.predicted}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id not in toxic]
    rows = [(d, t) for d, t, gone, _ in brute.without_lines(rows) if not gone or t.strip()]
    found = brute.classes(rows)
    rows = [(d, t) for d, t in rows if found[t][2] == d]
    rows = [(d, t) for d, t in rows if not any(brute.holds(t, i) for i in items)]
    encoder = Tokenizer.from_file(pipeline.VOCABULARY)
    want = {d: (encoder.encode(t, add_special_tokens=False).ids, t) for d, t in rows}
    got = {r.doc_id: r for r in pipeline.run(spark, sf).collect()}
    assert set(got) == set(want)
    for d, (ids, text) in want.items():
        assert got[d].n_tokens == len(ids) and got[d].decoded == text
        assert bytes(got[d].ids) == b"".join(i.to_bytes(4, "little") for i in ids)


def test_stages_keep_odd_rows_and_columns(spark, sf, odd_docs):
    docs, _ = odd_docs
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), sf).count() == 0, name
        assert 0 < out.count() <= docs.count(), name


def test_long_lists_pass_the_benchmark_stage(spark, tmp_path):
    item = "which of the boxes that the driver left in the yard on his way home was the heaviest one"
    lists = ["names of" + " Tom Anna" * 5_000, "numbers 1" + ",23" * 10_000]
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([*enumerate(lists), (2, f"{lists[0]} and {item}"), (3, None)], "doc_id long, text string")
    kept = dict(pipeline.STAGES)["decontamination"](spark, docs, str(tmp_path)).collect()
    assert {(r.doc_id, r.text) for r in kept} == {(0, lists[0]), (1, lists[1]), (3, None)}
